"""Quality rules as a short-circuit cascade.

Each rule's cost (CPU time) and selectivity (share rejected) are estimated on a sample of texts;
the rules then run in order of rejection per cost, and a text that one rejects meets no further
rule. The verdict is the conjunction of all rules, so it doesn't depend on the order.
"""

from __future__ import annotations

import time
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import fields, map_rows, texts

SYMBOLS = b"#*$%&|<>"
#: ASCII white space parts words: bytes.split() takes exactly these.
SPACES = b" \t\n\x0b\x0c\r"

#: Texts of the sample on which rules are ordered, and the longest such text in bytes.
SAMPLE, SAMPLE_BYTES = 400, 20_000


class Text:
    """A text whose measures are computed when a rule first asks for them."""

    def __init__(self, text: str):
        self.text = text
        self.raw = text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that some 3-word window covers which occurs twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        known = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        v = len(known)
        ids = np.fromiter(map(known.__getitem__, self.words), np.int64, n)
        pair = ids[:-1] * v + ids[1:]
        if v > 2_000_000:  # else three ids fit into 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * v + ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(n, bool)
        hit = np.concatenate((order[1:][same], order[:-1][same]))
        for k in range(3):
            twice[hit + k] = True
        return int(np.count_nonzero(twice))

    @cached_property
    def letter_words(self) -> int:
        return sum(w[:1].isalpha() or w[0] > 127 for w in self.words)


#: name, test that rejects. The first two are the base rules.
RULES = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "duplicate_lines": lambda t: 10 * t.n_dup_lines > 3 * len(t.lines),
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "letters": lambda t: 2 * t.letter_words < t.n_words,
}
BASE = ("few_words", "repeated_words")


def rule_order(sample: list[str], rules=RULES) -> list[str]:
    """Rules by rejection per cost, best first; ties by name. An empty sample keeps the given order."""
    if not sample:
        return list(rules)
    worth = {}
    for name, rejects in rules.items():
        began = time.process_time_ns()
        hits = sum(bool(rejects(Text(t))) for t in sample)  # each on fresh measures
        worth[name] = (hits / len(sample)) / max(1, time.process_time_ns() - began)
    return sorted(rules, key=lambda n: (-worth[n], n))


def first_rejection(t: Text, order: list[str], rules=RULES) -> str | None:
    return next((n for n in order if rules[n](t)), None)


def sampled(df: DataFrame, text_col: str = "text", n: int = SAMPLE) -> list[str]:
    """At most `n` texts of SAMPLE_BYTES or fewer, those of the smallest hashes of the whole table, from
    which costs are estimated; the rules themselves meet every row."""
    rows = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    return [r["text"] for r in rows.orderBy(F.xxhash64("text"), "text").limit(n).collect()]


def cascade(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None, measures: bool = True) -> DataFrame:
    """The verdict on every whole text: doc_id, kept, and, with `measures`, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null texts are empty, and an empty text fails few_words. Repeated rows give repeated results, an
    empty table none; a very long text takes memory in proportion to itself. Other columns are not read.
    `order` overrides the sampled one. With `measures` off a rejected text pays only for the rules it met.
    """
    order = order or rule_order(sampled(df, text_col))
    counts = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    more = "".join(f", {n} bigint" for n in counts) + ", base_failed boolean" if measures else ""
    schema = fields(f"doc_id {df.schema[id_col].dataType.simpleString()}, kept boolean{more}")

    def make():
        def step(cols):
            out = {n: [] for n in schema.fieldNames()} | {"doc_id": cols["doc_id"]}
            for text in cols["text"].to_pylist():
                t = Text(text)
                out["kept"].append(first_rejection(t, order) is None)
                if measures:
                    for n in counts:
                        out[n].append(getattr(t, n))
                    out["base_failed"].append(any(RULES[n](t) for n in BASE))
            return out

        return step

    return map_rows(texts(df, id_col, text_col), schema, make)

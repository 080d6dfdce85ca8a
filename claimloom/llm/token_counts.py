"""Token counts under edits: a segment tree over each document's pre-tokens, kept in a table.

A leaf holds a pre-token, or after an edit a run of them, with its length and its number of tokens;
inner nodes hold the sums. `trees` encodes every text once; its rows (the text and its leaves) are
what is kept for each document. An edit finds its leaf by descending on lengths, splits anew only the
edited region with the context that could change (back to the first pre-token that ends within one
code point before the edit; forward to the first old boundary behind it that the new split meets
again), encodes these pre-tokens and updates the sums on the paths of the leaves it touched. Neither
the rest of the text nor its counts are looked at again, and documents without edits don't reach Python.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.bpe import SPLIT, load
from claimloom.llm.common import fields, map_rows, written

#: Pre-tokens whose counts a Python worker remembers, in each of two generations.
CACHE = 150_000


class Counter:
    """Tokens of single pre-tokens. Strings of special tokens count as ordinary text."""

    def __init__(self, ranks: bytes, cache: int = CACHE):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(SPLIT)
        self.most, self.young, self.old = cache, {}, {}

    def of(self, piece: str) -> int:
        got = self.young.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                got = len(self.own._encode_single_piece(piece)) if len(piece) < 4096 else len(self.own.encode_ordinary(piece))
            if len(piece) < 64:
                if len(self.young) >= self.most:
                    self.old, self.young = self.young, {}
                self.young[piece] = got
        return got


class Tree:
    """Sums of lengths and of token counts over the leaves of one text.

    `changed` holds the runs of leaves that edits replaced; every other leaf is its part of `source`.
    """

    def __init__(self, source: str, lens: np.ndarray, counts: np.ndarray, counter: Counter):
        self.c, self.source, self.n = counter, source, len(lens)
        self.size = 1 << max(0, self.n - 1).bit_length()
        at, rows = self.size, np.zeros((2, 2 * self.size), np.int64)
        rows[0, at : at + self.n], rows[1, at : at + self.n] = lens, counts
        self.place = np.concatenate(([0], np.cumsum(rows[0, at : at + self.n])))
        while at > 1:
            rows[:, at // 2 : at] = rows[:, at : 2 * at : 2] + rows[:, at + 1 : 2 * at : 2]
            at //= 2
        self.rows, self.changed, self.encoded = rows, {}, 0

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        """A text's tree, every pre-token of it encoded."""
        found = counter.split.findall(text)
        young = counter.young.get
        counts = np.fromiter((counter.of(p) if (n := young(p)) is None else n for p in found), np.int64, len(found))
        return cls(text, np.fromiter(map(len, found), np.int64, len(found)), counts, counter)

    @property
    def tokens(self) -> int:
        return int(self.rows[1, 1])

    @property
    def chars(self) -> int:
        return int(self.rows[0, 1])

    def run(self, leaf: int) -> list[str]:
        """The pre-tokens of a leaf."""
        if leaf in self.changed:
            return self.changed[leaf]
        return [self.source[self.place[leaf] : self.place[leaf + 1]]] if leaf < self.n else []

    def _stretches(self):
        """(first, last) of the leaves between changed ones, and (leaf, None) for each of these."""
        at = 0
        for leaf in sorted(self.changed):
            if leaf > at:
                yield at, min(leaf, self.n)
            yield leaf, None
            at = leaf + 1
        if at < self.n:
            yield at, self.n

    @property
    def text(self) -> str:
        return "".join("".join(self.changed[a]) if b is None else self.source[self.place[a] : self.place[b]] for a, b in self._stretches())

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Length and tokens of every pre-token."""
        parts = [[np.zeros((2, 0), np.int64)]]
        for a, b in self._stretches():
            run = self.changed.get(a, []) if b is None else None
            parts.append([self.rows[:, self.size + a : self.size + b] if run is None else np.array([[*map(len, run)], [*map(self.c.of, run)]], np.int64).reshape(2, -1)])
        return tuple(np.concatenate([p[0] for p in parts], axis=1))

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The first leaf that ends behind `place`, and where it starts; behind the text the last position."""
        rows, node, start = self.rows[0], 1, 0
        while node < self.size:
            node *= 2
            if start + rows[node] <= place:
                start += int(rows[node])
                node += 1
        return node - self.size, start

    def put(self, leaf: int, run: list[str], tokens: int) -> None:
        self.changed[leaf] = run
        node = leaf + self.size
        self.rows[0, node], self.rows[1, node] = sum(map(len, run)), tokens
        node //= 2
        while node:
            self.rows[:, node] = self.rows[:, 2 * node] + self.rows[:, 2 * node + 1]
            node //= 2

    def edit(self, start: int, gone: int, new: str) -> None:
        """Replace `gone` code points from `start` by `new`; both are cut to what the text has."""
        start = min(max(start, 0), self.chars)
        end = min(start + max(gone, 0), self.chars)
        first, at = self.leaf_at(max(0, start - 2)) if self.chars else (0, 0)
        shift = len(new) - (end - start)
        taken, ahead = first, at  # old leaves up to `taken`, which starts at `ahead`, are in `local`
        local, step = "", 4

        def more() -> str:
            nonlocal taken, ahead, step
            out = []
            while taken < self.size and (ahead < end or step):
                step -= ahead >= end
                out += self.run(taken)
                ahead += int(self.rows[0, self.size + taken])
                taken += 1
            step = min(4096, 2 * (taken - first) + 4)
            return "".join(out)

        local = more()
        local = local[: start - at] + new + local[end - at :]
        last, fixed = first, at  # old leaves from `first` on; `fixed` is where leaf `last` starts
        found, here = [], 0
        while True:
            while last < self.size and (fixed < end or fixed + shift < at + here):
                fixed += int(self.rows[0, self.size + last])
                last += 1
            if fixed >= end and fixed + shift == at + here and at + here >= start + len(new):
                break
            m = self.c.split.match(local, here)
            # a split is sure once two code points behind it are known
            if taken < self.size and (m is None or m.end() > len(local) - 2):
                local += more()
                continue
            if m is None:
                last = self.size
                break
            found.append(m[0])
            here = m.end()
        self.encoded += len(found)
        tokens = sum(map(self.c.of, found))
        if last == first:
            if not found:
                return
            found, tokens = found + self.run(first), tokens + int(self.rows[1, self.size + first])
        for leaf in range(first + 1, min(last, self.size)):
            if self.rows[0, self.size + leaf]:
                self.put(leaf, [], 0)
        self.put(first, found, tokens)


@lru_cache(maxsize=1)
def counter(ranks: bytes) -> Counter:
    return Counter(ranks)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0)]).astype(np.int32)))


def _unlisted(column: pa.Array):
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


_LEAVES = "text string, lens array<int>, counts array<int>, n_tokens bigint"


def trees(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """What is kept for each document: doc_id, text, lens and counts (code points and tokens of every
    pre-token) and n_tokens; with `edits_col` also that column, as edits.

    Null texts are empty and have no leaves; repeated rows give repeated rows, a very long text one row
    with more leaves, an empty table none. Other columns are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(load(ranks))
    kind = lambda c: df.schema[c].dataType.simpleString()
    schema = fields(f"doc_id {kind(id_col)}, {_LEAVES}" + (f", edits {kind(edits_col)}" if edits_col else ""))

    def make():
        c = counter(sent.value)

        def step(cols):
            made = [Tree.of(t, c) for t in cols["text"].to_pylist()]
            out = {n: cols[n] for n in ("doc_id", "text", "edits") if n in cols}
            rows = [m.rows[:, m.size : m.size + m.n] for m in made]
            return out | {"lens": _lists([r[0] for r in rows]), "counts": _lists([r[1] for r in rows]), "n_tokens": [m.tokens for m in made]}

        return step

    more = [df[edits_col].alias("edits")] if edits_col else []
    return map_rows(df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *more), schema, make)


def edited(kept: DataFrame, ranks: str, with_trees: bool = True) -> DataFrame:
    """Kept trees after the edits that stand beside them (`edits`, in their order).

    `edits` is array<struct<start, gone, new>> in code points of the text as the edits before left it;
    null means none; edits are cut to the text; null members count as 0 or ''. Returns doc_id,
    n_tokens_before, n_pieces (before), n_tokens, n_reencoded (pre-tokens encoded anew for all edits),
    n_chars and, with `with_trees`, text, lens and counts as `trees` gives them for the edited text.
    """
    sent = kept.sparkSession.sparkContext.broadcast(load(ranks))
    more = ", text string, lens array<int>, counts array<int>" if with_trees else ""
    schema = fields(f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens_before bigint, n_pieces bigint, n_tokens bigint, n_reencoded bigint, n_chars bigint{more}")

    def make():
        c = counter(sent.value)

        def step(cols):
            out = {n: [] for n in schema.fieldNames()} | {"doc_id": cols["doc_id"]}
            for text, lens, counts, edits in zip(cols["text"].to_pylist(), _unlisted(cols["lens"]), _unlisted(cols["counts"]), cols["edits"].to_pylist(), strict=True):
                tree = Tree(text, lens, counts, c)
                out["n_tokens_before"].append(tree.tokens)
                out["n_pieces"].append(tree.n)
                for e in edits or ():
                    if e:
                        tree.edit(e["start"] or 0, e["gone"] or 0, e["new"] or "")
                out["n_tokens"].append(tree.tokens)
                out["n_reencoded"].append(tree.encoded)
                out["n_chars"].append(tree.chars)
                if with_trees:
                    out["text"].append(tree.text)
                    for n, x in zip(("lens", "counts"), tree.leaves(), strict=True):
                        out[n].append(x)
            return out | ({n: _lists(out[n]) for n in ("lens", "counts")} if with_trees else {})

        return step

    return map_rows(kept.select("doc_id", "text", "lens", "counts", "edits"), schema, make)


def updated(kept: DataFrame, log: DataFrame, ranks: str) -> DataFrame:
    """Kept trees after an edit log (doc_id, seq, start, gone, new): trees again.

    Only documents that the log names are edited, and of these only the touched regions are encoded;
    the others' rows pass as they are. Edits of unknown ids change nothing.
    """
    rows = kept.join(collected_edits(log), "doc_id", "left").select("doc_id", "text", "lens", "counts", "n_tokens", "edits")
    names = ["doc_id", "text", "lens", "counts", "n_tokens"]
    return rows.where("edits is null").select(*names).unionByName(edited(rows.where("edits is not null"), ranks).select(*names))


def counts_after_edits(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Token counts of every whole text before and after its edits: trees are made and written, and
    then edited as `edited` does, without a second encoding.

    Returns doc_id, n_tokens (before), n_tokens_edited, n_pieces (before), n_reencoded and
    n_chars_edited, a row for each row. Other columns are not read.
    """
    kept = written(trees(df, ranks, id_col, text_col, edits_col), "trees", "zstd")
    out = edited(kept, ranks, with_trees=False)
    return out.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_pieces", "n_reencoded", F.col("n_chars").alias("n_chars_edited"))


def collected_edits(edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """An edit log (doc_id, seq, start, gone, new) as one ordered array for each document.

    An array holds one document's edits only. Ties of seq go by start, gone and new.
    """
    rows = F.sort_array(F.collect_list(F.struct("seq", "start", "gone", "new")))
    return edits.groupBy(F.col(id_col).alias("doc_id")).agg(F.transform(rows, lambda e: F.struct(e["start"].alias("start"), e["gone"].alias("gone"), e["new"].alias("new"))).alias("edits"))

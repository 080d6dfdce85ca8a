"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts: one on windows of ordinary text, one on
those passages of toxic text whose byte n-grams are more frequent there (a dictionary trained on whole
toxic texts is filled with what both kinds share and tells nothing). Before the toxic dictionary's
content stands the ordinary one's, so the two differ in these passages only. A text is cut into
windows, each window is compressed with either dictionary, and the bytes saved by the toxic one are
its evidence. Both thresholds are calibrated on labelled texts that trained no dictionary: the saving
from which a window is a hit, so that few ordinary windows are, and a logistic curve over a text's
evidence, whose value is its score.

Null and empty texts have one empty window, which saves nothing; a very long text only has more
windows, of which all count.
"""

from __future__ import annotations

import pickle
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import fields, map_rows, texts
from claimloom.llm.hashing import shingles

#: Labelled texts of each class in the training sample, half for dictionaries, half for the curve; and
#: the longest such text in bytes. Every other count and every score covers all rows.
SAMPLE, SAMPLE_BYTES = 2000, 20_000
WINDOW = 128
GRAM = 6
SHARED, OWN = 24_576, 16_384
#: Standard errors by which an n-gram's share of toxic texts must exceed its share of ordinary ones.
CLEAR = 5.0
#: A score from which a text counts as toxic.
REJECT = 0.7
#: The largest share of ordinary windows that may be hits.
ORDINARY_HITS = 0.005
#: Lengths of the segments and of the n-grams by which zstandard trains the toxic dictionary.
SEGMENT, MER = 64, 6


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def _grams(raw: bytes) -> set[bytes]:
    return {raw[i : i + GRAM] for i in range(len(raw) - GRAM + 1)}


def unlike(texts: list[bytes]) -> list[bytes]:
    """`texts` without those of which 0.3 of the five-word shingles, or more, stood in texts before:
    what a group of copies repeats is no sign of its class."""
    seen: set[int] = set()
    out = []
    for t in texts:
        own = shingles(t, 5)
        own = set(own[own % np.uint64(4) == 0].tolist())  # a quarter of them, by their hash
        if len(own & seen) < 0.3 * len(own) or not own:
            out.append(t)
        seen |= own
    return out


def marked_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Runs of toxic text whose n-grams occur in a larger share of toxic than of ordinary texts."""
    often, seldom = Counter(), Counter()
    for t in toxic:
        often.update(_grams(t))
    for t in ordinary:
        seldom.update(g for g in _grams(t) if g in often)
    a, b = len(toxic), len(ordinary)

    def clear(n: int, m: int) -> bool:
        p = (n + m) / (a + b)
        return n / a - m / b > CLEAR * (p * (1 - p) * (1 / a + 1 / b)) ** 0.5

    strong = {g for g, n in often.items() if n >= 4 and clear(n, seldom[g])}
    out = []
    for t in toxic:
        hit = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - GRAM + 1):
            if t[i : i + GRAM] in strong:
                hit[i + 1 : i + 1 + GRAM] = 1
        turn = np.diff(hit)
        out += [whole_words(t[s:e]) for s, e in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]
    return [p for p in out if p]


def whole_words(run: bytes) -> bytes:
    """A run from the space before its first whole word to the one behind its last; the beginning of a
    word if it holds no more, and nothing if it only ends one."""
    starts = [i for i, c in enumerate(run) if c in b" \t\n\r"]
    if not starts:
        return b""
    return run[starts[0] : starts[-1] + 1] if starts[-1] > starts[0] + 3 else run[starts[0] :]


def most_frequent(samples: list[bytes], size: int) -> bytes:
    """`size` bytes of the samples at most, each once, the most frequent last, where they are cheapest to refer to."""
    often = Counter(samples)
    return b"\n".join(sorted(often, key=lambda s: (often[s], s)))[-size:]


def trained(samples: list[bytes], size: int, **how) -> bytes:
    """A zstandard dictionary's content; samples too few to train on are taken as they are."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return most_frequent(samples, size)


class Model:
    """Two dictionaries and two calibrated thresholds. It is small and pickles whole."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self.parts = trained([w for t in ordinary for w in windows(t)], SHARED), trained(marked_passages(toxic, ordinary), OWN, k=SEGMENT, d=MER)
        self.hit = 1
        self.curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def sizers(self):
        import zstandard

        shared, own = self.parts
        out = []
        for content in (shared, own + shared):
            raw = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(compression_level=5, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
            raw.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress)
        return out

    @staticmethod
    def saved(raw: bytes, sizers) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window of a text."""
        plain, toxic = sizers
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(raw)] or [0], np.float64)

    def calibrate(self, ordinary: list[bytes], sizers) -> None:
        """The smallest saving that at most ORDINARY_HITS of the windows of ordinary texts reach."""
        found = np.sort(np.concatenate([self.saved(t, sizers) for t in ordinary]))
        self.hit = max(1, int(found[min(len(found) - 1, int(len(found) * (1 - ORDINARY_HITS)))]) + 1)

    def evidence(self, raw: bytes, sizers) -> np.ndarray:
        """Of a text: bytes saved in a window on average, in its best three, share and number of hit windows, bytes saved in all."""
        saved = self.saved(raw, sizers)
        hits = float((saved >= self.hit).sum())
        return np.array([saved.mean(), np.sort(saved)[-3:].mean(), hits / len(saved), np.log1p(hits), np.log1p(np.maximum(saved, 0).sum())])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Weighted logistic regression by Newton steps, with a light ridge."""
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
        b = np.zeros(z.shape[1])
        ridge = np.diag([1e-6, *[0.05] * x.shape[1]])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ b)
            b += step
            if np.abs(step).max() < 1e-9:
                break
        self.curve = b, mean, spread

    def score(self, raw: bytes, sizers) -> float:
        b, mean, spread = self.curve
        z = b[0] + ((self.evidence(raw, sizers) - mean) / spread) @ b[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fitted(rows: list[tuple[int, bytes]], shares: tuple[int, int]) -> Model | float:
    """A model from (label, text) in a stable order; `shares`: how many ordinary and toxic texts there are.

    Without both classes: the constant share of toxic texts.
    """
    by = [unlike([t for y, t in rows if y == k]) for k in (0, 1)]
    if min(map(len, by)) < 4:
        return shares[1] / max(1, sum(shares))
    model = Model(by[1][::2], by[0][::2])
    sizers = model.sizers()
    model.calibrate(by[0][1::2], sizers)
    rest = [(k, t) for k in (0, 1) for t in by[k][1::2]]
    y = np.array([k for k, _ in rest], np.float64)
    weight = np.where(y == 1, shares[1] / y.sum(), shares[0] / (len(y) - y.sum())) * len(y) / sum(shares)
    model.fit(np.array([model.evidence(t, sizers) for _, t in rest]), y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | float:
    """A model from a bounded sample of `labels` (id, 0 or 1): the `sample` ids of each class with the
    smallest hashes, of texts up to SAMPLE_BYTES bytes. An id labelled more than once is toxic if any
    label says so; null labels and ids don't count.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    shares = known.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).head()
    order = F.xxhash64("doc_id")
    picked = None
    for k in (0, 1):
        part = known.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # `sample` rows of each class at most: small enough to send to every task
    rows = texts(docs, id_col, text_col).where(F.octet_length("text").between(1, SAMPLE_BYTES)).join(F.broadcast(picked), "doc_id")
    # an id with many texts counts with the one of the smallest hash: at most 2 * sample rows are collected
    rows = rows.groupBy("label", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    found = sorted((r["label"], r["doc_id"], r["text"]) for r in rows.select("label", "doc_id", "t.text").collect())
    return fitted([(y, t.encode()) for y, _, t in found], tuple(shares))


@lru_cache(maxsize=1)
def _ready(raw: bytes):
    model = pickle.loads(raw)
    return model, (model.sizers() if isinstance(model, Model) else None)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every whole text. Null texts are empty;
    repeated rows give repeated results; columns other than the id and the text are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = fields(f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")

    def make():
        m, sizers = _ready(sent.value)

        def step(cols):
            raw = (t.as_buffer().to_pybytes() for t in cols["text"])
            return {"doc_id": cols["doc_id"], "score": [m if sizers is None else m.score(t, sizers) for t in raw]}

        return step

    return map_rows(texts(docs, id_col, text_col), schema, make)


def without_toxic(docs: DataFrame, model: Model | float, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """`docs`, all columns, without the rows whose text scores `reject` or more. Null texts are scored as
    empty ones; repeated rows go or stay together; columns of any name pass unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = docs.columns

    def make():
        m, sizers = _ready(sent.value)

        def step(cols):
            raw = (b"" if t is None else t.encode() for t in cols[text_col].to_pylist())
            stay = np.array([i for i, t in enumerate(raw) if (m if sizers is None else m.score(t, sizers)) < reject], np.int64)
            return {n: cols[n].take(stay) for n in names}

        return step

    return map_rows(docs, docs.schema, make)

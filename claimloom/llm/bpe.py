"""BPE encoding and decoding: a segment tree over adjacent pair ranks.

Each pre-token's adjacent pairs are the leaves of a minimum tree whose values order by (rank,
position), so the root is the leftmost pair of lowest rank. A merge changes three leaves, each in
logarithmic time, until no pair can be merged. A pre-token of n bytes takes O(n log n), whatever
its length.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from claimloom.llm.common import fields, map_rows, texts

#: Fixed value: the byte-level pre-tokenizer's published split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens that a Python worker remembers, in each of two generations (about 0.2 kB each).
CACHE = 150_000

_NONE = 1 << 62


def byte_chars() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file of the tokenizers library, as tables."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)
        pre, dec = model["pre_tokenizer"] or {}, model["decoder"] or {}
        if model["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or dec.get("type") != "ByteLevel" or model["normalizer"] or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        ids = model["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.first = [ids[c] for c in chars]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[a] << 24 | ids[b]] = r
            self.made.append(ids[a + b])
        added = [x for x in model["added_tokens"]]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("added tokens that strip or match words only are not supported")
        self.added = {x["content"]: x["id"] for x in added}
        names = ids | self.added
        self.bytes_of: list[bytes] = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_of[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = regex.compile(SPLIT)

    def merge(self, ids: list[int]) -> list[int]:
        """`ids` with every merge applied: leftmost of lowest rank first."""
        m = len(ids)
        n = m - 1
        if n < 1:
            return ids
        rank, made = self.rank.get, self.made
        shift = n.bit_length()
        mask = (1 << shift) - 1
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        tree = [_NONE] * (2 * size)
        a = ids[0]
        for i in range(n):
            b = ids[i + 1]
            r = rank(a << 24 | b)
            if r is not None:
                tree[size + i] = r << shift | i
            a = b
        for i in range(size - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if x < y else y
        after, before = list(range(1, m + 1)), list(range(-1, m - 1))
        root = tree[1]
        while root < _NONE:
            i = root & mask
            gone = after[i]
            ids[i] = new = made[root >> shift]
            k = after[i] = after[gone]
            changed = []
            if gone < n:
                changed.append((size + gone, _NONE))
            if k < m:
                before[k] = i
                r = rank(new << 24 | ids[k])
                changed.append((size + i, _NONE if r is None else r << shift | i))
            else:
                changed.append((size + i, _NONE))
            p = before[i]
            if p >= 0:
                r = rank(ids[p] << 24 | new)
                changed.append((size + p, _NONE if r is None else r << shift | p))
            for at, value in changed:
                if tree[at] == value:
                    continue
                tree[at] = value
                at >>= 1
                while at:
                    x, y = tree[2 * at], tree[2 * at + 1]
                    if y < x:
                        x = y
                    if tree[at] == x:
                        break
                    tree[at] = x
                    at >>= 1
            root = tree[1]
        out, i = [], 0
        while i < m:
            out.append(ids[i])
            i = after[i]
        return out

    def piece(self, text: str) -> list[int]:
        first = self.first
        return self.merge([first[b] for b in text.encode()])


class Encoder:
    """Whole texts to ids and back. Pre-tokens' ids are remembered in two generations of bounded size."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.v, self.most = vocabulary, cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _packed(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            ids = self.v.piece(text)
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) < 64:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[text] = got
        return got

    def packed(self, text: str) -> bytes:
        """The ids of `text` as little-endian unsigned 32-bit integers."""
        v, out, at = self.v, [], 0
        if v.marks is None:
            return self._plain(text)
        for m in v.marks.finditer(text):
            out += [self._plain(text[at : m.start()]), struct.pack("<I", v.added[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])]) if out else self._plain(text)

    def _plain(self, text: str) -> bytes:
        out = []
        for p in self.v.split.findall(text):
            got = self.young.get(p)
            out.append(self._packed(p) if got is None else got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.packed(text)).cast("I")) if text else []

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        names = self.v.bytes_of
        return b"".join([names[i] for i in memoryview(packed).cast("I")]).decode("utf-8", "replace") if packed else ""


@lru_cache(maxsize=1)
def encoder(raw: bytes) -> Encoder:
    """A worker's encoder; it outlives the task, so later tasks find the pre-tokens remembered."""
    return Encoder(Vocabulary(raw))


def load(path: str) -> bytes:
    """A vocabulary file's bytes, read once by the driver."""
    with open(path, "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """Every row's text encoded whole and decoded again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, as asked, ids (little-endian unsigned
    32-bit integers) and decoded. A null or empty text has no tokens and
    decodes to ''. Repeated rows give repeated results, an empty table none; a very long text, or
    pre-token, takes n log n steps. Other columns are not read. The vocabulary file (its size is fixed,
    about 1.5 MB) is read by the driver and sent to the tasks.
    """
    spark: SparkSession = df.sparkSession
    sent = spark.sparkContext.broadcast(load(vocabulary))
    more = ", ids binary" * with_ids + ", decoded string" * with_decoded
    schema = fields(f"doc_id {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")

    def make():
        coder = encoder(sent.value)

        def step(cols):
            out = {n: [] for n in schema.fieldNames()} | {"doc_id": cols["doc_id"]}
            for text in cols["text"].to_pylist():
                packed = coder.packed(text)
                decoded = coder.decode(packed)
                out["n_tokens"].append(len(packed) // 4)
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(packed)
                if with_decoded:
                    out["decoded"].append(decoded)
            return out

        return step

    return map_rows(texts(df, id_col, text_col), schema, make)

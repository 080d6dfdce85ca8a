"""Suffix-array dedup: depth-limited radix passes over the suffixes of all texts, as bytes.

Suffixes are ordered only through the threshold of T bytes, and only where one can be repeated:

1. First digit. Of the T - K + 1 grams of K bytes in each window of T bytes the smallest hash is
   picked (all of them on ties). Equal windows pick the same grams, so every repeated window holds a
   picked gram, an anchor, that occurs twice or more; about 2 / (T - K + 2) of all positions are
   anchors. Positions are dealt by this digit; anchors that occur once go.
2. Occurrences that are equal in all bytes that windows over the anchor can reach (its context) are
   repeated in all these windows; one of them stands for the others from here on.
3. Most-significant-digit passes of eight bytes each order an anchor's contexts, once forward from the
   anchor through T bytes and once backward through T - K; after each pass what stands alone in its
   group goes no further. The passes leave the common prefix of neighbours in either order. A window
   that starts s bytes before the anchor is a suffix of T bytes: contexts of one group through depth s
   backward and through depth T - s forward hold the same one, and groups of two or more are exactly
   the repeated windows. Bytes are compared, not hashes.
4. An anchor with more than GROUP contexts is dealt by its next digit: a window over an anchor holds
   half of T - K bytes on its left or on its right, so contexts are grouped by either half, and each
   such group is ordered as in step 3. Groups that are larger still are compared as windows, dealt to
   all tasks and counted there by hashes within the anchor.

A text is read in segments of SEGMENT bytes, so a very long one needs no more memory than these and
its own bytes (about eighty times a segment). Offsets are 32-bit: a text ends below 2 GiB, as any
string in Spark does. A row is known by its id and text through a 128-bit digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_limits, dropped, fields, map_rows, written
from claimloom.llm.hashing import BASE, TABLE, Rolled, U, mixed

K = 32
#: Contexts of one group that one task orders (about 1 kB each), and contexts that it takes at once.
GROUP, CHUNK = 16_384, 4096
#: Bytes of a text in which anchors are sought at once.
SEGMENT = 1 << 20


def slid(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over each window of w values, in linear time."""
    n = len(x)
    wide = np.full(-(-n // w) * w, fill, x.dtype)
    wide[:n] = x
    rows = wide.reshape(-1, w)
    upto = op.accumulate(rows, axis=1).ravel()
    fro = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(fro[: n - w + 1], upto[w - 1 : n])


def anchors(raw: bytes, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, gram hash, context hash and context end of every anchor of one text."""
    if len(raw) < t:
        return (np.zeros(0, np.int64),) * 4
    out = []
    for low in range(0, len(raw), SEGMENT):
        # whether a position is an anchor, and its context, depend on the t bytes on either side only
        skip = min(low, 2 * t)
        at, gram, context, stop = _anchors(raw[low - skip : low + SEGMENT + 2 * t], t)
        own = (at >= skip) & (at < skip + SEGMENT)
        out.append((at[own] + (low - skip), gram[own], context[own], stop[own] + (low - skip)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(raw: bytes, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(raw, np.uint8)
    n, w = len(buf), t - K + 1
    if n < t:
        return (np.zeros(0, np.int64),) * 4
    rolled = Rolled(buf)
    grams = rolled.windows(K)
    low = slid(grams, w, np.minimum, np.iinfo(np.uint64).max)
    wide = np.zeros(len(low) + 2 * (w - 1), np.uint64)
    wide[w - 1 : w - 1 + len(low)] = low
    at = np.flatnonzero(slid(wide, w, np.maximum, 0) == grams)
    start, end = np.maximum(at - (t - K), 0), np.minimum(at + t, n)
    with np.errstate(over="ignore"):
        context = mixed(rolled.ranges(start, end) + (at - start).astype(np.uint64) * U(0x9E3779B97F4A7C15) + (end - at).astype(np.uint64))
    return at, grams[at].view(np.int64), context.view(np.int64), end


def digits(rows: list[bytes], depth: int) -> np.ndarray:
    """The rows as numbers of eight bytes, the most significant first, filled with zeros to `depth`."""
    size = -(-depth // 8) * 8
    wide = np.frombuffer(b"".join(r[:depth].ljust(size, b"\0") for r in rows), ">u8")
    return wide.reshape(len(rows), size // 8).astype(np.uint64)


def radix_order(groups: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered inside their groups by most-significant-digit passes.

    `groups` is sorted. Returns the order and, for each place in it, the bytes that its row has in
    common with the row before, -1 where a group begins. Rows alone in their group meet no further pass.
    """
    n, m = numbers.shape
    order, common, group = np.arange(n), np.full(n, 8 * m), np.zeros(n, np.int64)
    begins = np.ones(n, bool)
    begins[1:] = groups[1:] != groups[:-1]
    common[begins] = -1
    group[:] = np.cumsum(begins)
    left = np.arange(n)[np.bincount(group)[group] > 1]
    for j in range(m):
        if not len(left):
            break
        g, d = group[left], numbers[order[left], j]
        by = np.lexsort((d, g))
        order[left], d = order[left][by], d[by]
        other = d[1:] != d[:-1]
        parted = other & (g[1:] == g[:-1])
        x = d[1:][parted] ^ d[:-1][parted]
        common[left[1:][parted]] = 8 * j + sum(((x >> U(64 - 8 * k)) == 0).astype(np.int64) for k in range(1, 8))
        new = np.cumsum(np.concatenate(([True], other | (g[1:] != g[:-1]))))
        stay = np.bincount(new)[new] > 1
        left = left[stay]
        group[left] = new[stay]
    return order, common


def _aligned(contexts: list[bytes], left: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts as columns, their anchors one below another, and their sizes."""
    span = t - K
    wide = np.zeros((len(contexts), span + t), np.uint8)
    for i, c in enumerate(contexts):
        at = span - left[i]
        wide[i, at : at + len(c)] = np.frombuffer(c, np.uint8)
    return np.ascontiguousarray(wide.T), np.array([len(c) for c in contexts], np.int64)


def shifted_windows(contexts: list[bytes], left: np.ndarray, t: int):
    """For each shift s of 0..t-K: the hashes of the windows that start s bytes before the anchors,
    and which contexts hold theirs."""
    wide, sizes = _aligned(contexts, left, t)
    table, base, span = TABLE, BASE, t - K
    with np.errstate(over="ignore"):
        top = U(pow(int(base), t - 1, 1 << 64))
        now = np.zeros(len(contexts), np.uint64)
        for c in range(span + t - 1, span - 1, -1):
            now = now * base + table[wide[c]]
        for s in range(span + 1):
            if s:
                now = (now - table[wide[span + t - s]] * top) * base + table[wide[span - s]]
            yield mixed(now), (s <= left) & (t - s <= sizes - left)


def twice_in(groups: np.ndarray, contexts: list[bytes], left: np.ndarray, t: int) -> np.ndarray:
    """Which windows (contexts x shifts) are equal to another of the same group and shift; `groups` is sorted."""
    n, span = len(contexts), t - K
    out = np.zeros((n, span + 1), bool)
    sides, most = [], []
    for depth, rows in ((t, [c[a:] for c, a in zip(contexts, left, strict=True)]), (span, [c[:a][::-1] for c, a in zip(contexts, left, strict=True)])):
        order, common = radix_order(groups, digits(rows, depth))
        near = np.maximum(common, np.append(common[1:], -1))
        best = np.empty(n, np.int64)
        best[order] = near
        sides.append((order, common))
        most.append(best)
    sizes = np.array([len(c) for c in contexts], np.int64)
    forward, backward = np.minimum(most[0], sizes - left), np.minimum(most[1], left)
    for s in range(span + 1):
        at = np.flatnonzero((s <= backward) & (t - s <= forward))
        if len(at) < 2:
            continue
        keys = np.zeros(n, np.int64)
        for (order, common), depth in zip(sides, (t - s, s), strict=True):
            own = np.empty(n, np.int64)
            own[order] = np.cumsum(common < depth)
            keys = keys * (n + 1) + own
        keys = keys[at]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        out[at[order[1:][same]], s] = True
        out[at[order[:-1][same]], s] = True
    return out


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as maximal runs."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return s[new], e[np.concatenate((new[1:] - 1, [len(s) - 1]))]


def _anchor_table(docs: DataFrame, t: int) -> DataFrame:
    schema = fields("key binary, at int, gram bigint, context bigint, stop int")

    def make():
        def step(cols):
            found = [anchors(x.as_buffer().to_pybytes(), t) for x in cols["text"]]
            keys = cols["key"].take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
            at, gram, context, stop = (np.concatenate([f[i] for f in found]) for i in range(4))
            return {"key": keys, "at": at.astype(np.int32), "gram": gram, "context": context, "stop": stop.astype(np.int32)}

        return step

    return map_rows(docs, schema, make)


def _contexts(docs: DataFrame, wanted: DataFrame, t: int) -> DataFrame:
    """gram, big, key, at, left and the context's bytes for the anchors in `wanted`."""
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "big", "at")).alias("asked"))
    schema = fields("gram bigint, big boolean, key binary, at int, left int, bytes binary")

    def make():
        def step(cols):
            out = {n: [] for n in schema.fieldNames()}
            for key, text, asked in zip(cols["key"].to_pylist(), cols["text"], cols["asked"].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for x in asked:
                    start = max(0, x["at"] - (t - K))
                    out["gram"].append(x["gram"])
                    out["big"].append(x["big"])
                    out["key"].append(key)
                    out["at"].append(x["at"])
                    out["left"].append(x["at"] - start)
                    out["bytes"].append(raw[start : x["at"] + t])
            return out

        return step

    return map_rows(docs.join(asked, "key").select("key", "text", "asked"), schema, make)


def _sorted_groups(contexts: DataFrame, t: int) -> DataFrame:
    """Repeated runs (key, start, stop) of groups that one task can order. contexts: gram (the group), key, at, left, bytes."""
    rows = contexts.select("gram", "key", "at", "left", "bytes").repartition("gram").sortWithinPartitions("gram")
    arrow_limits(contexts.sparkSession)
    schema = fields("key binary, start int, stop int")

    def found(grams, keys, at, left, raw):
        hit = twice_in(grams, raw, left, t)
        for low in range(0, len(hit), CHUNK):  # a row's windows become a few runs before the next rows unfold
            row, shift = np.nonzero(hit[low : low + CHUNK, ::-1])  # by start
            if len(row):
                start = at[low + row] - (t - K - shift)
                cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + t))))
                last = np.concatenate((cut[1:] - 1, [len(row) - 1]))
                columns = [keys[low + k] for k in row[cut]], start[cut].astype(np.int32), (start[last] + t).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *map(pa.array, columns[1:])], names=["key", "start", "stop"])

    def run(batches):
        kept: list = [[], [], [], [], []]

        def take(upto):
            part = [k[:upto] for k in kept]
            kept[:] = [k[upto:] for k in kept]
            return found(np.array(part[0], np.int64), part[1], np.array(part[2], np.int64), np.array(part[3], np.int64), part[4])

        for b in batches:
            for k, c in zip(kept, b.columns, strict=True):
                k.extend(c.to_pylist())
            while len(kept[0]) >= 2 * CHUNK:  # whole groups only: a group has GROUP rows at most
                upto = CHUNK
                while upto < len(kept[0]) and kept[0][upto] == kept[0][upto - 1]:
                    upto += 1
                if upto == len(kept[0]):
                    break
                yield from take(upto)
        if kept[0]:
            yield from take(len(kept[0]))

    return rows.mapInArrow(run, schema)


def _halves(contexts: DataFrame, t: int) -> DataFrame:
    """Contexts by the half on their anchor's left and by the one on its right: group, part (a hash of the
    group and the half) and n, the contexts of that part; those alone in theirs are left out."""
    half = (t - K) // 2
    schema = fields("gram bigint, key binary, at int, left int, bytes binary, part bigint")

    def make():
        def step(cols):
            out = {n: [] for n in schema.fieldNames()}
            for gram, key, at, left, raw in zip(*(cols[n].to_pylist() for n in ("gram", "key", "at", "left", "bytes")), strict=True):
                for side, part in enumerate((raw[max(0, left - half) : left], raw[left + K : left + K + half])):
                    if len(part) == half:
                        own = hashlib.blake2b(b"%d %d " % (gram, side) + part, digest_size=8).digest()
                        for n, x in zip(out, (gram, key, at, left, raw, int.from_bytes(own, "big", signed=True)), strict=True):
                            out[n].append(x)
            return out

        return step

    rows = written(map_rows(contexts.select("gram", "key", "at", "left", "bytes"), schema, make), "halves")
    counts = rows.groupBy("part").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(counts, "part")


def _dealt_groups(contexts: DataFrame, t: int) -> DataFrame:
    """The same for larger groups: a row for each window, counted after partial sums."""
    schema = fields("gram bigint, shift int, window bigint, key binary, start int")

    def make():
        def step(cols):
            left, at, gram = (cols[n].to_numpy().astype(np.int64) for n in ("left", "at", "gram"))
            out = {n: [] for n in ("gram", "shift", "window", "row", "start")}
            for s, (hashes, held) in enumerate(shifted_windows(cols["bytes"].to_pylist(), left, t)):
                parts = gram[held], np.full(held.sum(), s, np.int32), hashes[held].view(np.int64), np.flatnonzero(held), (at[held] - s).astype(np.int32)
                for n, x in zip(out, parts, strict=True):
                    out[n].append(x)
            out = {n: np.concatenate(x) for n, x in out.items()}
            return out | {"key": cols["key"].take(pa.array(out["row"]))}

        return step

    rows = map_rows(contexts.select("gram", "key", "at", "left", "bytes"), schema, make)
    twice = rows.groupBy("gram", "shift", "window").count().where("count > 1").drop("count")
    return rows.join(twice, ["gram", "shift", "window"]).select("key", "start", (F.col("start") + t).alias("stop"))


def remove_repeats(df: DataFrame, threshold: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Removes every byte covered by a `threshold`-byte string that also starts anywhere else.

    Every whole text counts as UTF-8 bytes (null: empty); matches don't cross texts, may lie in the
    same text and may overlap; all are judged on the input. Repeated rows are repeats of each other.
    Texts under `threshold` bytes lose nothing; an empty table gives no rows. Other columns are not read.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    `with_text`, removed (array of start, stop in bytes) and kept (binary; cuts may part a code point).
    """
    t = threshold
    if t < K:
        raise ValueError(f"the threshold must be {K} bytes or more")
    docs = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), F.col("text")))))
    plain = docs.select("key", "text")

    first = written(_anchor_table(plain.where(F.octet_length("text") >= t), t), "anchors")
    # written, not joined as an aggregate: then a gram of very many occurrences can be split over tasks
    grams = written(first.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    second = written(first.join(grams, "gram"), "again")
    dropped(first, grams)
    counted = second.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    counted = written(counted.select("gram", "context", "n", "one.key", "one.at"), "counted")
    whole = second.join(counted.where("n > 1").select("gram", "context"), ["gram", "context"]).select("key", F.greatest(F.col("at") - (t - K), F.lit(0)).alias("start"), "stop")
    whole = written(whole, "whole")
    dropped(second)

    several = written(counted.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > GROUP).alias("big")), "several")
    contexts = written(_contexts(plain, counted.join(several, "gram").select("gram", "big", "key", "at"), t), "contexts")
    dropped(counted, several)
    part = written(_sorted_groups(contexts.where("not big"), t), "part")
    cuts = whole.unionByName(part)
    if not contexts.where("big").isEmpty():
        parts = written(_halves(contexts.where("big"), t), "parts")
        by_half = parts.where(F.col("n") <= GROUP).select(F.col("part").alias("gram"), "key", "at", "left", "bytes")
        cuts = cuts.unionByName(written(_sorted_groups(by_half, t), "part"))
        if not parts.where(F.col("n") > GROUP).isEmpty():
            rest = parts.where(F.col("n") > GROUP).select("gram", "key", "at", "left", "bytes").distinct()
            cuts = cuts.unionByName(written(_dealt_groups(rest, t), "part"))
        dropped(parts)
    dropped(contexts)
    cuts = written(cuts.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")), "cuts")
    dropped(whole, part)

    kind = df.schema[id_col].dataType.simpleString()
    more = ", removed array<struct<start:int,stop:int>>, kept binary" if with_text else ""
    schema = fields(f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}")

    def make():
        def step(cols):
            out = {n: [] for n in schema.fieldNames()} | {"doc_id": cols["doc_id"]}
            for text, cuts in zip(cols["text"], cols["cuts"].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                spans = []
                if cuts:
                    s, e = runs(np.array([c["start"] for c in cuts]), np.array([c["stop"] for c in cuts]))
                    spans = list(zip(s.tolist(), e.tolist(), strict=True))
                edges = [0, *(x for span in spans for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["removed"].append([{"start": a, "stop": b} for a, b in spans])
                    out["kept"].append(kept)
            return out

        return step

    return map_rows(docs.join(cuts, "key", "left").select("doc_id", "text", "cuts"), schema, make)

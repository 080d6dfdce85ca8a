"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation.

1. Each text becomes its set of hashed word shingles, a signature of 128 minima and a 128-bit digest of
   the set. Texts with equal sets are one class from here on, so exact copies cost nothing more. A
   class is known by half of its digest; where the other half shows that two classes share it, they
   get numbers of their own.
2. 32 bands of four minima make buckets (a pair at the threshold of 0.85 shares none with a chance
   of 5e-11). Each member is paired with its bucket's first: as many pairs as members.
3. A pair's signatures are compared in batches of 16 minima. After each batch the pair goes if the
   posterior probability that its similarity reaches the threshold, after the matches so far and a
   uniform prior, falls below MISS.
4. Survivors are confirmed on their full sets; only these links count.
5. A bucket of more than SPLIT whose members are not all in one component yet is split by every other
   band, and steps 2 to 4 are taken in each part. That joins most near copies at little cost; it decides
   nothing, since step 6 still covers the bucket.
6. Every bucket, of any size, whose members are still not all in one component is compared whole, in
   blocks of bounded size, pair against pair across components: first by signatures alone; only texts
   with a surviving partner are then sent to the exact confirmation. Confirmed links join components at
   once, so a block of n texts yields under n links.
7. Components come from alternating large-star and small-star steps, each written to the shared folder.

Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_limits, dropped, fields, map_rows, written
from claimloom.llm.hashing import shingles

BANDS, ROWS, BATCH = 32, 4, 16
HASHES = BANDS * ROWS
#: The chance, at each batch, that a pair at the threshold is dropped.
MISS = 1e-9
#: Texts and bytes of text at most (beyond one text) in a block of an unresolved bucket. Each member is
#: sent once for every block, so beyond FEW blocks they are made wider, up to WIDE texts.
BLOCK, BLOCK_BYTES = 1024, 16_000_000
FEW, WIDE = 8, 16_384
#: Members that are compared with one another by early() first.
MANY = 256
#: Members from which an unresolved bucket is joined through the other bands before it is compared in blocks.
#: It changes the cost only: the same links count on either side.
SPLIT = 65_536
#: Pairs that one copy of a popular text serves.
SPREAD = 64

_RNG = np.random.default_rng(77)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """128 minima of `items`, 32 bits each."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(items), 512):
            np.minimum(best, (items[at : at + 512, None] * _A + _B).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def digest(items: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit digest of a sorted set."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(items.tobytes()))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For each batch, the fewest matches after it with which a pair stays.

    After m matches in n minima under a uniform prior the similarity has a Beta(m + 1, n - m + 1)
    posterior, and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out, t = [], percent / 100
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the rows of the signature arrays a and b that no batch drops."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i, least in enumerate(least_matches(percent)):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[alive, cut] == b[alive, cut]).sum(axis=1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def signed(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, bytes, set_id, mate (the digest's halves) and signature of every text."""
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = fields(f"doc_id {df.schema[id_col].dataType.simpleString()}, text_key bigint, n_shingles bigint, bytes bigint, set_id bigint, mate bigint, signature binary")

    def make():
        def step(cols):
            out = {n: [] for n in schema.fieldNames()} | {"doc_id": cols["doc_id"], "text_key": cols["text_key"]}
            for text in cols["text"]:
                raw = text.as_buffer().to_pybytes()
                items = shingles(raw, words)
                own, mate = digest(items) if len(items) else (None, None)
                out["n_shingles"].append(len(items))
                out["bytes"].append(len(raw))
                out["set_id"].append(own)
                out["mate"].append(mate)
                out["signature"].append(signature(items).tobytes() if len(items) else None)
            return out

        return step

    return map_rows(rows, schema, make)


def told_apart(base: DataFrame) -> DataFrame:
    """`base` with a set_id of its own for each class: those whose halves differ under one set_id are numbered anew."""
    shared = base.groupBy("set_id").agg(F.min("mate").alias("low"), F.max("mate").alias("high")).where("low <> high")
    shared = written(shared.select("set_id", F.lit(True).alias("apart")), "apart")
    if shared.isEmpty():
        return base
    rows = base.join(shared, "set_id", "left")
    return rows.withColumn("set_id", F.when(F.col("apart"), F.xxhash64("set_id", "mate")).otherwise(F.col("set_id"))).drop("apart")


def _pruned(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures pass all batches."""
    of = lambda x: sets.select(F.col("set_id").alias(x), F.col("signature").alias(f"signature_{x}"))
    rows = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "signature_a", "signature_b")

    def make():
        def step(cols):
            wide = [np.frombuffer(b"".join(cols[f"signature_{x}"].to_pylist()), np.uint32).reshape(-1, HASHES) for x in "ab"]
            stay = surviving(*wide, percent)
            return {x: cols[x].take(stay) for x in "ab"}

        return step

    return map_rows(rows, fields("a bigint, b bigint"), make)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked on their full sets. `texts`: set_id, text."""
    dealt = pairs.join(pairs.groupBy("a").count(), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / SPREAD))).select("a", "b", "part")
    right = dealt.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
    left = dealt.select("a", "part").distinct().join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = right.join(left, ["a", "part"]).select("a", "b", "text_a", "text_b")

    def make():
        last: list = [None, None]

        def step(cols):
            keep = []
            for i, a in enumerate(cols["a"].to_pylist()):
                if last[0] != a or last[1] is None:
                    last[:] = a, shingles(cols["text_a"][i].as_buffer().to_pybytes(), words)
                if linked(last[1], shingles(cols["text_b"][i].as_buffer().to_pybytes(), words), percent):
                    keep.append(i)
            return {x: cols[x].take(np.array(keep, np.int64)) for x in "ab"}

        return step

    return map_rows(rows, fields("a bigint, b bigint"), make)


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` (the smallest node reachable) for every node of `edges` (a, b: bigint).

    Large-star and small-star in turn until the edges no longer change. Every step is written, so a
    lost executor costs one step at most.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        last, now = now, written(small, "edges")
        dropped(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if mark == seen:
            break
        seen = mark
    if seen[0] == 0:
        return spark.createDataFrame([], "node bigint, root bigint")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _units(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Units of work inside buckets: bucket, i, j (a pair of blocks, or one with itself), set_id, root, block.

    `members`: bucket, set_id, root. A bucket is cut into blocks of BLOCK to WIDE texts and BLOCK_BYTES.
    """
    m = members.join(sets.select("set_id", "bytes"), "set_id")
    share = F.greatest(F.least(F.count("*") / BLOCK, F.lit(float(FEW))), F.count("*") / WIDE, F.sum("bytes") / BLOCK_BYTES)
    # dealt by hash, not by a window over the bucket: no task needs a whole bucket
    blocks = m.groupBy("bucket").agg((F.ceil(share) - 1).cast("int").alias("last"))
    m = m.join(blocks, "bucket").select("bucket", "set_id", "root", F.pmod(F.xxhash64("set_id"), F.col("last") + 1).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    return m.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set_id", "root", "block")


class _Unit:
    """The members of one unit: rows of (set_id, root, block, signature), by block."""

    def __init__(self, head: tuple, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.parts = np.unique(np.array([r[1] for r in rows], np.int64), return_inverse=True)[1]
        #: where the second of two blocks begins: members of the first meet those from there on
        self.second = sum(r[2] == head[1] for r in rows) if head[1] != head[2] else None
        self.wide = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, HASHES)
        self.tall = np.ascontiguousarray(self.wide[:, : 2 * BATCH].T) if len(rows) > MANY else None

    def partners(self, n: int, percent: int) -> np.ndarray:
        """Later members of another component (and another block) whose signature passes against n's."""
        first = n + 1 if self.second is None else self.second if n < self.second else len(self.ids)
        apart = self.parts[first:] != self.parts[n]
        if len(apart) > MANY:
            apart &= self.early(n, first, percent)
        rest = first + np.flatnonzero(apart)
        return rest[surviving(self.wide[rest], np.broadcast_to(self.wide[n], (len(rest), HASHES)), percent)] if len(rest) else rest

    def early(self, n: int, first: int, percent: int) -> np.ndarray:
        """Whether the first two batches keep each member from `first` on against n: one minimum of all
        of them at a time, so that nothing is gathered for pairs that go at once."""
        same, stay = np.zeros(len(self.ids) - first, np.uint8), np.ones(len(self.ids) - first, bool)
        for i, least in enumerate(least_matches(percent)[:2]):
            for k in range(i * BATCH, (i + 1) * BATCH):
                same += self.tall[k, first:] == self.tall[k, n]
            stay &= same >= least
        return stay

    def join(self, n: int, k: int) -> None:
        self.parts[self.parts == self.parts[k]] = self.parts[n]


def _by_unit(rows: DataFrame, schema: str, make) -> DataFrame:
    """Rows of units (bucket, i, j, ...), whole units at a time, through make(head, rows) -> lists for `schema`."""
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "set_id")
    arrow_limits(rows.sparkSession)
    kind = fields(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(kind)
        head, group = None, []

        def out():
            found = make(head, group) if group else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kinds.field(i).type) for i in range(len(kinds))], schema=kinds) if found else None

        for b in batches:
            heads = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            rest = [b.column(i) for i in range(3, b.num_columns)]
            rest = [[x.as_buffer().to_pybytes() for x in c] if pa.types.is_string(c.type) or pa.types.is_binary(c.type) else c.to_pylist() for c in rest]
            for own, row in zip(heads, zip(*rest, strict=True), strict=True):
                if own != head:
                    if (got := out()) is not None:
                        yield got
                    head, group = own, []
                group.append(row)
        if (got := out()) is not None:
            yield got

    return rows.mapInArrow(run, kind)


def _blocks(members: DataFrame, sets: DataFrame, texts_of, words: int, percent: int) -> DataFrame:
    """Links across components inside unresolved buckets. `members`: bucket, set_id, root;
    `texts_of` gives (set_id, text) for a column of sets."""
    units = written(_units(members, sets), "units")

    def promising(head, rows):
        unit, hit = _Unit(head, rows), np.zeros(len(rows), bool)
        for n in range(len(rows)):
            found = unit.partners(n, percent)
            hit[found] = True
            hit[n] |= len(found) > 0
        return [(*head, *rows[k]) for k in np.flatnonzero(hit)]

    signed_ = units.join(sets.select("set_id", "signature"), "set_id").select("bucket", "i", "j", "set_id", "root", "block", "signature")
    left = written(_by_unit(signed_, "bucket bigint, i int, j int, set_id bigint, root bigint, block int, signature binary", promising), "promising")
    dropped(units)
    texts = written(texts_of(left.select("set_id")), "texts")

    def confirmed(head, rows):
        unit = _Unit(head, rows)
        have = [shingles(r[4], words) for r in rows]
        out = []
        for n in range(len(rows)):
            for k in unit.partners(n, percent):
                if unit.parts[k] != unit.parts[n] and linked(have[n], have[k], percent):
                    unit.join(n, k)
                    out.append((unit.ids[n], unit.ids[k]))
        return out

    rows = left.join(texts, "set_id").select("bucket", "i", "j", "set_id", "root", "block", "signature", "text")
    links = written(_by_unit(rows, "a bigint, b bigint", confirmed), "links")
    dropped(left, texts)
    return links


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links texts whose sets of `words`-word shingles have 100 * intersection >= percent * union.

    A-Z are lowered; words are runs without ASCII white space; a text with fewer words is one shingle;
    a text without words (null and empty included) is linked with nothing.

    Returns for every row doc_id, n_shingles, component_id (the smallest doc_id reachable, itself
    included) and kept (doc_id is component_id, null-safe). Rows with null ids take part; they are
    never the smallest. Repeated rows share a component. A very long text is one set like any other;
    tasks hold few of them at once. An empty table gives no rows. Other columns are not read.
    """
    rooted = _rooted(df, words, percent, id_col, text_col)
    smallest = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(smallest, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df`, all columns, with one row of each component: that of the smallest id (a null id only where
    there is no other; ties go by a hash of the text, and of repeated rows one stays). Texts without
    words are linked with nothing, so all of them stay. Columns of any name pass unchanged."""
    rooted = written(_rooted(df, words, percent, id_col, text_col).select("doc_id", "text_key", "root"), "rooted")
    best = rooted.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("s"))
    # a row is named by its id and its text's hash; what names several rows is cut to one of them
    times = rooted.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"), F.bool_or(F.col("root").isNull()).alias("bare"))
    stay = best.select(F.col("s.doc_id").alias("doc_id"), F.col("s.text_key").alias("text_key"), F.lit(True).alias("first"))
    same = F.col("n.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("n.text_key") == F.col("f.text_key"))
    named = times.alias("n").join(stay.alias("f"), same, "left").where("bare or first").select("n.doc_id", "n.text_key", ((F.col("times") > 1) & ~F.col("bare")).alias("several"))
    rows = df.select(F.struct("*").alias("row"), df[id_col].alias("doc_id"), F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))).alias("text_key"))
    same = F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.text_key") == F.col("n.text_key"))
    found = rows.alias("r").join(named.alias("n"), same).select("r.row", "r.doc_id", "r.text_key", "n.several")
    one = found.where("several").groupBy("doc_id", "text_key").agg(F.any_value("row").alias("row")).select("row")
    return found.where("not several").select("row").unionByName(one).select("row.*")


def _rooted(df: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id and root (the smallest set of the component; null without words) of every row."""
    base = told_apart(written(signed(df, words, id_col, text_col), "signed"))
    real = base.where("n_shingles > 0")
    sets = written(real.select("set_id", "bytes", "signature").dropDuplicates(["set_id"]), "sets")

    # one row's text for each set that is still needed
    source = real.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("s")).select("set_id", "s.doc_id", "s.text_key")
    docs = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))

    def texts_of(needed: DataFrame) -> DataFrame:
        keys = source.join(needed.distinct(), "set_id").select("set_id", F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
        found = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
        return found.select("set_id", "text").dropDuplicates(["set_id"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass all batches and then hold on the full sets."""
        close = written(_pruned(pairs, sets, percent), "close")
        texts = written(texts_of(close.select(F.explode(F.array("a", "b")).alias("set_id"))), "texts")
        links = written(_confirmed(close, texts, words, percent), "links")
        dropped(close, texts)
        return links

    def in_stars(buckets: DataFrame) -> DataFrame:
        """(bucket, band, set_id, pivot) for buckets of two or more, the pivot's own row left out."""
        # sums before the shuffle and a join that can be split, not a window: a bucket may hold a third of all sets
        pivots = buckets.groupBy("bucket").agg(F.min("set_id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot")
        return buckets.join(pivots, "bucket").where("set_id <> pivot")

    def still_open(m: DataFrame, found: DataFrame) -> DataFrame:
        """Members (bucket, band, set_id, root, n) of buckets of three or more in more than one component, one for each membership."""
        m = m.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        once = m.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("mark"))
        once = once.where("n > 2 and low <> high").groupBy("n", "low", "high", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
        return written(m.join(once, "bucket").select("bucket", "band", "set_id", "root", "n"), "open")

    banded = lambda rows, *more: rows.select(*more, "set_id", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "signature")
    value = F.substring("signature", F.col("band") * (ROWS * 4) + 1, F.lit(ROWS * 4))
    stars = written(in_stars(banded(sets).select("set_id", "band", F.xxhash64("band", value).alias("bucket"))), "stars")
    links = confirmed(stars.select(F.col("pivot").alias("a"), F.col("set_id").alias("b")).distinct())
    found = components(links)
    members = stars.select("bucket", "band", "set_id").unionByName(stars.select("bucket", "band", F.col("pivot").alias("set_id")).distinct())
    open_ = still_open(members, found)
    dropped(stars)

    large = open_.where(F.col("n") > SPLIT)
    if not large.isEmpty():
        wide = large.select("bucket", F.col("band").alias("own"), "set_id", "root").join(sets.select("set_id", "signature"), "set_id")
        parts = banded(wide, "bucket", "own", "root").where("band <> own").select("set_id", "band", F.xxhash64("bucket", "band", value).alias("bucket"))
        stars = written(in_stars(parts), "stars")
        rooted = found.withColumnRenamed("node", "set_id")
        ends = stars.join(rooted, "set_id", "left").join(rooted.select(F.col("set_id").alias("pivot"), F.col("root").alias("pivot_root")), "pivot", "left")
        apart = F.coalesce("root", "set_id") != F.coalesce("pivot_root", "pivot")
        more = confirmed(ends.where(apart).select(F.col("pivot").alias("a"), F.col("set_id").alias("b")).distinct())
        links, last = written(links.unionByName(more), "links"), links
        dropped(last, more)
        found = components(links)
        # the whole buckets, not their parts: a pair may share no band but the bucket's own
        before, open_ = open_, still_open(open_.select("bucket", "band", "set_id"), found)
        dropped(stars, before)

    if not open_.isEmpty():
        more = _blocks(open_.select("bucket", "set_id", "root"), sets, texts_of, words, percent)
        if not more.isEmpty():
            found = components(links.unionByName(more))
        dropped(more)
    dropped(links, open_, sets)

    return base.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").select("doc_id", "text_key", "n_shingles", "set_id", F.coalesce("root", "set_id").alias("root"))

"""Benchmark decontamination with DataFrame operations only.

1. Words are runs of letters and digits, lowered; five of them make a shingle, known by a 58-bit hash
   whose low six bits hold its weight: its length in code points, 63 at most.
2. An item's seeds are its rarest shingles (by the number of items that hold them) of just more than
   1 - T of its weight. Whatever reaches similarity T shares at least T of the item's weight, and so a
   seed; a shingle that many items share is a seed of few. One pass over all texts finds the pairs of
   a text and an item that share one.
3. Item-sized windows of such a text (the whole text if that is shorter), at every start. What a
   window shares with the item is at most the weight of its places with a shingle of that item;
   running sums over these places bound it for all starts. Starts, and then windows by their own
   weight, that this bound keeps below the threshold are left out. No other is.
4. Each different window gets a 64-bit SimHash of its weighted shingles, and so does each item.
5. Fingerprints are cut into RADIUS + 1 blocks. Two that differ in RADIUS bits at most agree in one
   block, so joining on (item, block, bits) finds all of them. The item is part of the key: no window
   meets an item whose seeds its text lacks, so windows x items is never formed.
6. These candidates are confirmed by exact weighted similarity: the sum over shingles of the smaller
   weighted count against the sum of the larger.

A pair at similarity 0.8 differs in about 10 of 64 bits, with a deviation of 3, so a radius of 23
misses one in about 10^5 of the pairs at the threshold. At this distance no set of blocks is both
sure to find all within the radius and selective against unlike pairs; that is the seeds' part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import written

RADIUS = 23
WORD = "[\\p{L}\\p{N}]+"
#: Shingles of all items that may be broadcast (about 50 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
_LANE = 21


def shingle_codes(text: Column, words: int) -> Column:
    """Hash and weight of every shingle in order; empty where there are fewer words.

    The words are bound as a lambda's variable: named twice as an expression they would be cut anew
    for every shingle.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.transform(F.array(found), lambda w: F.when(F.size(w) >= words, _codes(w, words)).otherwise(F.array().cast("array<bigint>")))[0]


def _codes(w: Column, words: int) -> Column:
    spelled = F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.array_join(F.slice(w, i, words), " "))
    return F.transform(spelled, lambda s: F.xxhash64(s).bitwiseAND(F.lit(-64)).bitwiseOR(F.least(F.char_length(s), F.lit(63)).cast("long")))


def _weight(code: str | Column) -> Column:
    return (F.col(code) if isinstance(code, str) else code).bitwiseAND(F.lit(63))


def _total(codes: str) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + _weight(x))


def _seeds(contents: DataFrame, percent: int) -> DataFrame:
    """(content, code): the rarest shingles of each item whose weight is just above 1 - T of the item's."""
    each = contents.select("content", "total", F.explode("codes").alias("code")).groupBy("content", "total", "code").agg((F.count("*") * F.first(_weight("code"))).alias("own"))
    spread = each.groupBy("code").agg(F.count("*").alias("items"))
    before = Window.partitionBy("content").orderBy("items", "code").rowsBetween(Window.unboundedPreceding, -1)  # one item's shingles
    ranked = each.join(spread, "code").withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    return ranked.where(100 * F.col("before") <= (100 - percent) * F.col("total")).select("content", "code")


def _starts(hits: DataFrame, words: int, percent: int) -> DataFrame:
    """Every start at which an item-sized window can share enough with its item.

    A hit counts for all windows that hold its place; `bound` sums their weights. Rows that repeat
    raise the bound, which leaves no start out.
    """
    hits = hits.withColumn("width", F.least(F.col("size") - (words - 1), F.col("n")))
    first, after = F.greatest(F.col("place") - F.col("width") + 1, F.lit(0)), F.least(F.col("place"), F.col("n") - F.col("width")) + 1
    steps = F.explode(F.array(F.struct(first.alias("at"), _weight("code").alias("step")), F.struct(after.alias("at"), (-_weight("code")).alias("step"))))
    key = ["doc_id", "text", "content", "width", "item_total"]
    each = hits.select(*key, steps.alias("e")).groupBy(*key, "e.at").agg(F.sum("e.step").alias("step"))
    w = Window.partitionBy("doc_id", "text", "content").orderBy("at")
    runs = each.select(*key, "at", F.sum("step").over(w).alias("bound"), F.lead("at").over(w).alias("next"))
    runs = runs.where((100 * F.col("bound") >= percent * F.col("item_total")) & (F.col("next") > F.col("at")) & (F.col("bound") > 0))
    return runs.select(*key, "bound", F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("at"))


def _fingerprints(rows: DataFrame, *key: str) -> DataFrame:
    """SimHash of `codes` for each key: three 21-bit sums share a long."""
    each = rows.select(*key, F.explode("codes").alias("code")).withColumn("g", F.xxhash64("code"))
    bit = lambda b: F.shiftrightunsigned("g", b).bitwiseAND(F.lit(1))
    lanes = [sum((bit(b) * F.lit(1 << (_LANE * k)) for k, b in enumerate(range(j, min(j + 3, 64)))), F.lit(0)) for j in range(0, 64, 3)]
    sums = each.groupBy(*key).agg(F.sum(_weight("code")).alias("total"), *(F.sum(_weight("code") * lane).alias(f"s{j}") for j, lane in enumerate(lanes)))
    part = lambda b: F.shiftrightunsigned(f"s{b // 3}", _LANE * (b % 3)).bitwiseAND(F.lit((1 << _LANE) - 1))
    print_ = F.lit(0).cast("long")
    for b in range(64):
        print_ = print_.bitwiseOR(F.when(2 * part(b) > F.col("total"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(F.lit(0)).cast("long"))
    return sums.select(*key, "total", print_.alias("print"))


def _blocks(radius: int) -> Column:
    """(block, bits) of `print` for radius + 1 blocks of nearly equal width."""
    n, at, out = radius + 1, 0, []
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        out.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("print", at).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")))
        at += width
    return F.array(*out)


def leaks(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Items that texts hold, at weighted similarity >= percent / 100 of an item-sized window.

    Returns for each (doc_id, item_id) found: similarity (of the best window of all starts), at (its
    first word, from 0; the earliest of equals) and n_words (of the item). Null and empty texts, and
    texts or items of fewer than `words` words, hold nothing and are held by nothing. Repeated rows
    are found once for an id; null ids are found like others. A very long text only has more places:
    no step holds more of it than its own row. Empty tables give no rows. Other columns are not read.
    """
    if not 0 <= radius < 64:
        raise ValueError("the radius must be from 0 to 63")
    own = items.select(items[item_col].alias("item_id"), shingle_codes(F.coalesce(items[text_col].cast("string"), F.lit("")), words).alias("codes")).where(F.size("codes") > 0)
    own = written(own.select("item_id", "codes", (F.size("codes") + (words - 1)).alias("size"), F.xxhash64(F.col("codes")).alias("content")), "items")
    contents = own.select("content", "size", _total("codes").alias("item_total"), "codes").dropDuplicates(["content"])

    seeds = written(_seeds(contents.withColumnRenamed("item_total", "total"), percent), "seeds")
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    row = [docs[id_col].alias("doc_id"), shingle_codes(F.coalesce(docs[text_col].cast("string"), F.lit("")), words).alias("codes")]
    # an outer explode: a filter for empty arrays would be pushed below and cut the words twice
    first = docs.select(*row).select("doc_id", F.xxhash64("codes").alias("text"), F.explode_outer("codes").alias("code")).join(seeds, "code")
    pairs = written(first.select("doc_id", "text", "content").distinct(), "pairs")

    # only texts with such a pair are cut into words again
    some = pairs.select(F.col("doc_id").alias("_held")).distinct()
    texts = docs.join(some, docs[id_col].eqNullSafe(some["_held"]), "left_semi").select(*row).withColumn("text", F.xxhash64("codes"))
    asked = pairs.join(contents.select("content", "size", "item_total", F.explode(F.array_distinct("codes")).alias("code")), "content")
    places = texts.select("doc_id", "text", F.size("codes").alias("n"), F.posexplode_outer("codes").alias("place", "code"))
    hits = places.alias("t").join(asked.alias("a"), F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t.text") == F.col("a.text")) & (F.col("t.code") == F.col("a.code")))
    hits = hits.select("t.doc_id", "t.text", "content", "size", "item_total", "n", "place", "t.code")
    starts = written(_starts(hits, words, percent), "starts")

    cut = texts.alias("t").join(starts.alias("s"), (F.col("t.text") == F.col("s.text")) & F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")))
    cut = cut.select("t.doc_id", "content", "at", "bound", "item_total", F.slice("codes", F.col("at") + 1, F.col("width")).alias("codes"))
    cut = cut.where((100 + percent) * F.col("bound") >= percent * (_total("codes") + F.col("item_total"))).select("doc_id", "content", "at", "codes").withColumn("window", F.xxhash64("codes"))
    found = written(cut.dropDuplicates(["doc_id", "content", "at", "window"]), "windows")

    windows = found.select("content", "window", "codes").dropDuplicates(["content", "window"])
    theirs = _fingerprints(windows, "content", "window").select("content", "window", "total", "print", F.explode(_blocks(radius)).alias("b")).select("*", "b.block", "b.bits").drop("b")
    ours = _fingerprints(contents, "content").select("content", F.col("total").alias("item_total"), F.col("print").alias("item_print"), F.explode(_blocks(radius)).alias("b")).select("content", "item_total", "item_print", "b.block", "b.bits")
    near = theirs.join(ours, ["content", "block", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.select("content", "window", "total", "item_total").distinct()

    count = lambda df, *key: df.select(*key, F.explode("codes").alias("code")).groupBy(*key, "code").agg(F.count("*").alias("n"))
    shared = near.join(count(windows, "content", "window"), ["content", "window"]).join(count(contents, "content").withColumnRenamed("n", "item_n"), ["content", "code"])
    shared = shared.groupBy("content", "window", "total", "item_total").agg(F.sum(F.least("n", "item_n") * _weight("code")).alias("both"))
    union = F.col("total") + F.col("item_total") - F.col("both")
    sure = shared.where(100 * F.col("both") >= percent * union).select("content", "window", (F.col("both") / union).alias("similarity"))

    out = found.select("doc_id", "content", "at", "window").join(sure, ["content", "window"])
    best = out.groupBy("doc_id", "content").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "at")).alias("b"))
    best = best.join(own.select("item_id", "content", "size"), "content")
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.at").cast("long").alias("at"), F.col("size").cast("long").alias("n_words"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs`, all columns, without the rows whose id holds an item. Rows that hold none stay as they
    are, null and empty texts and repeated rows included; of an empty table nothing is left to remove."""
    held = leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, docs[id_col].eqNullSafe(held["_held"]), "left_anti")

"""Open triangles: pairs that a hub connects and no link does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scoring import basis_weight
from claimloom.sources.shared import setting, spread, written
from claimloom.vocabulary import DEGREE_CAP, GAP_CAP, GAP_CEILING, ROUTE_BONUS, SHARED_PAPER


def best_links(links: DataFrame) -> DataFrame:
    """The strongest link of each pair of nodes a < b; of equals the last by (src, how, dst)."""
    if "id" not in links.columns:
        links = links.withColumn("id", F.concat_ws("|", "src", "how", "dst"))
    pair = links.where("src <> dst").select("*", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    w = Window.partitionBy("a", "b").orderBy(F.desc("overall"), F.desc("src"), F.desc("how"), F.desc("dst"))
    return spread(pair, "a", "b").withColumn("rank", F.row_number().over(w)).where("rank = 1").select("a", "b", F.col("id").alias("link"), "overall", "basis", "papers")


def linked_pairs(links: DataFrame) -> DataFrame:
    """a, b: each pair of nodes a < b that a link joins, once. For counts that ask nothing of the link."""
    pair = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return spread(pair, "a", "b").distinct()


def both_ways(best: DataFrame) -> DataFrame:
    """Pairs (a, b) as hub and end, both ways round."""
    rest = [c for c in best.columns if c not in ("a", "b")]
    ends = F.explode(F.array(F.struct(F.col("a").alias("hub"), F.col("b").alias("end")), F.struct(F.col("b").alias("hub"), F.col("a").alias("end"))))
    return best.select(ends.alias("e"), *rest).select("e.*", *rest)


def undirected_edges(links: DataFrame) -> DataFrame:
    """The strongest link of each pair of nodes, both ways round."""
    return both_ways(best_links(links))


def capped(edges: DataFrame, degree: int = DEGREE_CAP) -> DataFrame:
    """At most `degree` neighbours of each hub, the first by id: a hub yields a bounded number of pairs."""
    w = Window.partitionBy("hub").orderBy("end")
    # dealt by hub first: the rows are sorted once, not on both sides of the shuffle
    return spread(edges, "hub").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= degree).drop("rank")


#: Hubs that one task gathers before it falls back to sorting.
GATHERED = 1_000_000


def near_lists(edges: DataFrame, degree: int = DEGREE_CAP) -> DataFrame:
    """hub, near: its neighbours under the cap in order, each with the other columns of `edges`; written.

    The same as `capped`, gathered by hash: sorting all edges took most of the time. A task holds the
    edges of its hubs, of which `spread` keeps it few, and all of a hub's.
    """
    rest = [c for c in edges.columns if c not in ("hub", "end")]
    lists = spread(edges, "hub").groupBy("hub").agg(F.slice(F.array_sort(F.collect_list(F.struct("end", *rest))), 1, degree).alias("near"))
    with setting(edges.sparkSession, spark__sql__objectHashAggregate__sortBased__fallbackThreshold=str(GATHERED)):
        return written(lists, "near")


def _paired(lists: DataFrame, *keep: str) -> DataFrame:
    """x, y: any two neighbours of a list, the first by id first. Made where the list is: nothing is joined."""
    each = lists.select(*keep, "near", F.posexplode("near").alias("_i", "x"))
    return each.select(*keep, "x", F.explode(F.slice("near", F.col("_i") + 2, F.size("near"))).alias("y"))


def _met(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """a, c, routes, linked: in how many lists a pair stands together, and whether an edge joins it.

    Pairs and edges are summed together, which is partial before the shuffle; no pair of a hub is sorted
    or joined.
    """
    pairs = _paired(lists.select(F.transform("near", lambda n: n["end"]).alias("near"))).select(F.col("x").alias("a"), F.col("y").alias("c"), F.lit(1).cast("long").alias("routes"), F.lit(0).alias("linked"))
    joined = edges.where("hub < end").select(F.col("hub").alias("a"), F.col("end").alias("c"), F.lit(0).cast("long").alias("routes"), F.lit(1).alias("linked"))
    return pairs.unionByName(joined).groupBy("a", "c").agg(F.sum("routes").alias("routes"), F.max("linked").alias("linked"))


def route_counts(edges: DataFrame, degree: int = DEGREE_CAP) -> DataFrame:
    """a, c, routes: the pairs that some hub connects and no edge joins. `edges` holds both directions, uncapped."""
    return _met(near_lists(edges.select("hub", "end"), degree), edges).where("routes > 0 and linked = 0").drop("linked")


def resolved_pairs(known: DataFrame, edges: DataFrame, degree: int = DEGREE_CAP) -> DataFrame:
    """a, c: pairs open among the edges `known`, of which `edges` are all, that are not open among all."""
    ends = lambda e: near_lists(e.select("hub", "end"), degree).select(F.transform("near", lambda n: n["end"]).alias("near"))
    pairs = lambda e, tag: _paired(ends(e)).select(F.col("x").alias("a"), F.col("y").alias("c"), F.lit(tag).alias("tag"))
    joined = lambda e, tag: e.where("hub < end").select(F.col("hub").alias("a"), F.col("end").alias("c"), F.lit(tag).alias("tag"))
    tags = pairs(known, 1).unionByName(joined(known, 2)).unionByName(pairs(edges, 4)).unionByName(joined(edges, 8))
    met = tags.groupBy("a", "c").agg(F.bit_or("tag").alias("tag"))
    has = lambda tag: F.col("tag").bitwiseAND(tag) > 0
    return met.where(has(1) & ~has(2) & ~(has(4) & ~has(8))).select("a", "c")


def hubs(edges: DataFrame, degree: int = DEGREE_CAP) -> DataFrame:
    """hub, near, closed (its pairs under the cap that an edge joins: a, c), fan (how many no edge joins).

    Which pairs are closed is found once for all hubs. A closed pair finds its hubs by the end that has
    fewer of them, so that a node in very many pairs is not met by all of its own hubs.
    """
    lists = near_lists(edges, degree)
    shut = written(_met(lists, edges).where("routes > 0 and linked = 1").select("a", "c"), "closed")
    n = F.size("near")
    if shut.isEmpty():
        return lists.select("*", F.lit(None).cast("array<struct<a:string,c:string>>").alias("closed"), (n * (n - 1) / 2).cast("long").alias("fan"))
    many = shut.select(F.explode(F.array("a", "c")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    sized = shut.join(many.select(F.col("x").alias("a"), F.col("n").alias("_a")), "a").join(many.select(F.col("x").alias("c"), F.col("n").alias("_c")), "c")
    first = F.col("_a") <= F.col("_c")
    sized = sized.select(F.when(first, F.col("a")).otherwise(F.col("c")).alias("end"), F.when(first, F.col("c")).otherwise(F.col("a")).alias("other"))
    flat = lists.select("hub", F.explode(F.transform("near", lambda x: x["end"])).alias("end"))
    found = flat.join(sized, "end").join(flat.withColumnRenamed("end", "other"), ["hub", "other"], "left_semi")
    closed = found.groupBy("hub").agg(F.collect_list(F.struct(F.least("end", "other").alias("a"), F.greatest("end", "other").alias("c"))).alias("closed"))
    return lists.join(closed, "hub", "left").withColumn("fan", (n * (n - 1) / 2 - F.coalesce(F.size("closed"), F.lit(0))).cast("long"))


def fan_outs(edges: DataFrame, degree: int = DEGREE_CAP) -> DataFrame:
    """hub, fan: how many open pairs each hub connects."""
    return hubs(edges.select("hub", "end"), degree).where("fan > 0").select("hub", "fan")


def wedges(edges: DataFrame, degree: int = DEGREE_CAP) -> DataFrame:
    """Pairs a < c around a hub that no edge joins. `edges` holds both directions, uncapped."""
    return _opened(hubs(edges, degree), "hub").select("hub", F.col("x.end").alias("a"), F.col("y.end").alias("c"))


def _opened(around: DataFrame, *keep: str) -> DataFrame:
    """The open pairs of each row of `hubs`."""
    pairs = _paired(around, "closed", *keep)
    return pairs.where(F.col("closed").isNull() | ~F.array_contains("closed", F.struct(F.col("x.end").alias("a"), F.col("y.end").alias("c"))))


#: How many times the asked number of gaps are kept in view while scores are known up to rounding.
SPARE = 20
#: What two scores may differ by where rounding made them equal.
CLOSE = 1e-8


def ranked_gaps(links: DataFrame, cap: int = GAP_CAP, degree: int = DEGREE_CAP) -> DataFrame:
    """The `cap` best gaps. `links`: src, how, dst, overall, basis, papers and, if
    gaps are to name the links that imply them, id.

    For each pair the best route counts (of equals the first hub by id), then a bonus for the number
    of routes; rank goes by score, then pair. The confidence is capped, the rank is not.

    Routes are made where their hub's list is and summed by pair, never sorted: the best rounded score
    and their number. Only pairs whose score can be among the best are then looked at route by route.
    """
    best = best_links(links).withColumns({"weight": basis_weight(F.col("basis"))}).drop("basis")
    best = written(best, "best-links")
    around = written(hubs(both_ways(best), degree).where("fan > 0"), "hubs")
    apart = (F.size("x.papers") > 0) & (F.size("y.papers") > 0) & ~F.arrays_overlap("x.papers", "y.papers")
    score = F.least("x.overall", "y.overall") * F.col("x.weight") * F.col("y.weight") * F.when(apart, 1.0).otherwise(SHARED_PAPER) * (1 / F.sqrt("fan"))
    routes = _opened(around, "hub", "fan").select("hub", F.col("x.end").alias("a"), F.col("y.end").alias("c"), F.array_sort(F.array("x.link", "y.link")).alias("implied_by"), score.alias("score"))
    bonus = lambda c: F.round(F.col(c) * (1 + ROUTE_BONUS * F.log2(F.col("routes").cast("double"))), 10)
    pairs = routes.groupBy("a", "c").agg(F.count("*").alias("routes"), F.max(F.round("score", 10)).alias("top")).withColumn("about", bonus("top"))
    few = written(pairs.orderBy(F.desc("about"), "a", "c").limit(cap * SPARE), "few")
    seen = sorted((r["about"] for r in few.select("about").collect()), reverse=True)  # at most cap x SPARE numbers
    floor = seen[cap - 1] - CLOSE if len(seen) >= cap else None
    # ties beyond those in view: all that reach the last place
    more = len(seen) == cap * SPARE and seen[-1] >= floor
    chosen = pairs.where(F.col("about") >= floor) if more else F.broadcast(few if floor is None else few.where(F.col("about") >= floor))
    w = Window.partitionBy("a", "c").orderBy("hub")
    first = routes.join(chosen, ["a", "c"]).where(F.round("score", 10) == F.col("top")).withColumn("rank", F.row_number().over(w)).where("rank = 1")
    note = F.concat(F.lit("both connect to "), F.col("hub"), F.lit("; no direct link reported"), F.when(F.col("routes") > 1, F.concat(F.lit(" (implied via "), F.col("routes").cast("string"), F.lit(" intermediates)"))).otherwise(""))
    top = first.select("a", "c", F.col("hub").alias("via"), "implied_by", "routes", bonus("score").alias("score"), note.alias("note")).orderBy(F.desc("score"), "a", "c").limit(cap)
    return top.withColumn("confidence", F.round(F.least("score", F.lit(GAP_CEILING)), 4))

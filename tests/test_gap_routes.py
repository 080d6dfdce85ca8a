"""Open pairs made inside their hubs' lists, against a plain count; parts that grow with the input."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from claimloom.operators import gaps
from claimloom.sources.shared import SHARE, spread

DEGREE = 4


def plain(pairs):
    edges = pairs | {(b, a) for a, b in pairs}
    near = {h: sorted(b for a, b in edges if a == h)[:DEGREE] for h, _ in edges}
    return [(h, a, c) for h, ends in near.items() for a, c in combinations(ends, 2) if (a, c) not in edges]


def test_counts_are_those_of_the_plain_way(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample([f"n{i:02d}" for i in range(24)], 2))) for _ in range(80)} | {("hub", f"n{i:02d}") for i in range(24)}
    known = {p for p in pairs if not any(x.endswith("7") for x in p)}
    both = lambda rows: gaps.both_ways(spark.createDataFrame(sorted(rows), "a string, b string"))
    routes, before = plain(pairs), plain(known)
    assert len(routes) > 20
    assert {(r.hub, r.fan) for r in gaps.fan_outs(both(pairs), DEGREE).collect()} == {(h, sum(x == h for x, _, _ in routes)) for h, _, _ in routes}
    assert {(r.a, r.c, r.routes) for r in gaps.route_counts(both(pairs), DEGREE).collect()} == {(a, c, sum((x, y) == (a, c) for _, x, y in routes)) for _, a, c in routes}
    assert {tuple(r) for r in gaps.resolved_pairs(both(known), both(pairs), DEGREE).collect()} == {(a, c) for _, a, c in before} - {(a, c) for _, a, c in routes}
    assert sorted(tuple(r) for r in gaps.wedges(both(pairs), DEGREE).collect()) == sorted(routes)


def test_more_ties_than_are_in_view_are_ranked_by_pair(spark):
    ddl = "src string, how string, dst string, overall double, basis string, papers array<string>"
    rows = [(f"h{i}", "x", f"{e}{i:03d}", 0.5, "primary", []) for i in range(90) for e in "ab"]
    got = [(r.a, r.c, r.routes) for r in gaps.ranked_gaps(spark.createDataFrame(rows, ddl), cap=3).collect()]
    assert 90 > 3 * gaps.SPARE and got == [(f"a{i:03d}", f"b{i:03d}", 1) for i in range(3)]


def test_parts_grow_with_the_input(spark, tmp_path):
    spark.range(2 * SHARE).select(F.xxhash64("id").alias("k")).coalesce(1).write.parquet(f"{tmp_path}/t")
    assert spread(spark.read.parquet(f"{tmp_path}/t"), "k").rdd.getNumPartitions() >= 8
    assert spread(spark.range(3), "id").rdd.getNumPartitions() == 4

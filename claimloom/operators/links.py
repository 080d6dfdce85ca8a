"""Claims grouped into scored links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scoring
from claimloom.functions.text import normalize_name

KEY = ["src", "how", "dst"]


def is_own() -> Column:
    """A claim's own result; null is not."""
    return F.coalesce(F.col("is_own_result"), F.lit(False))


def own_results(findings: DataFrame) -> DataFrame:
    return findings.where(is_own())


def with_sources(findings: DataFrame, papers: DataFrame) -> DataFrame:
    """Claims with the quality, the author and the presence of their source, which may be missing."""
    author = normalize_name(F.coalesce(F.nullif(F.col("first_author"), F.lit("")), F.col("id")))
    points = scoring.study_points(F.col("study_type"), F.col("is_preprint"))
    # once for each source, not for each claim
    side = papers.select(F.col("id").alias("paper"), F.lit(True).alias("known"), points.alias("points"), author.alias("author"))
    return findings.join(side, "paper", "left").withColumn("points", F.coalesce("points", F.lit(4000).cast("long")))


#: Parts that a link's claims are dealt to, by author, before they are counted.
PARTS = 16


def link_measures(findings: DataFrame, papers: DataFrame) -> DataFrame:
    """One row for each (src, how, dst): counts, ids by direction, conditions, sums for the scores.

    Claims are summed by (key, part) and then by key. All claims of an author, and so all of a source,
    are in one part: distinct authors and sources add up over the parts, and no task holds more than a
    part of them, however many claims one link has. Lists of ids are made only where they are used.
    """
    own, says = is_own(), F.col("says")
    on = lambda what: own & (says == what)
    ids = lambda what: F.collect_list(F.when(on(what), F.col("id")))
    where = lambda what: F.collect_set(F.when(on(what) & (F.col("setting") != ""), F.col("setting")))
    sums = {"n_findings": F.count("*"), "n_yes": F.count_if(on("yes")), "n_no": F.count_if(on("no")), "n_no_effect": F.count_if(on("no_effect")), "n_own": F.count_if(own), "n_own_hedged": F.count_if(own & F.coalesce(F.col("hedged"), F.lit(False))), "points": F.sum("points"), "n_authors": F.size(F.collect_set(F.when(own, F.col("author")))).cast("long"), "n_papers": F.size(F.collect_set(F.when(own & F.col("known"), F.col("paper")))).cast("long")}
    lists = {"yes": ids("yes"), "no": ids("no"), "no_effect": ids("no_effect"), "yes_where": where("yes"), "no_where": where("no")}
    rows = with_sources(findings, papers).withColumn("_part", F.pmod(F.xxhash64("author"), F.lit(PARTS)))
    parts = rows.groupBy(*KEY, "_part").agg(*(c.alias(n) for n, c in (sums | lists).items()))
    flat = lambda n: F.array_sort(F.flatten(F.collect_list(n)))
    united = {n: F.array_distinct(flat(n)) if n.endswith("where") else flat(n) for n in lists}
    return parts.groupBy(*KEY).agg(*(F.sum(n).alias(n) for n in sums), *(c.alias(n) for n, c in united.items()))


def disagreement(yes_where: Column, no_where: Column) -> Column:
    """Named conditions of both camps, where they don't meet; else null."""
    told = F.concat(F.lit("conditions differ: {"), F.array_join(yes_where, ", "), F.lit("} vs {"), F.array_join(no_where, ", "), F.lit("}"))
    return F.when((F.size(yes_where) > 0) & (F.size(no_where) > 0) & ~F.arrays_overlap(yes_where, no_where), told)


def scored_links(findings: DataFrame, papers: DataFrame) -> DataFrame:
    """Links with state, basis, the three terms, overall score and label; every claim group is a link."""
    m = link_measures(findings, papers)
    points = m.withColumns(
        {
            "agr": scoring.agreement_points(F.col("n_yes"), F.col("n_no")),
            "qual": scoring.quality_points(F.col("points"), F.col("n_findings")),
            "ind": scoring.independence_points(F.col("n_authors"), F.col("n_papers")),
        }
    )
    terms = F.col("agr"), F.col("qual"), F.col("ind")
    return points.select(
        *KEY,
        scoring.state(F.col("n_yes"), F.col("n_no"), F.col("n_no_effect")).alias("state"),
        scoring.basis(F.col("n_own"), F.col("n_own_hedged")).alias("basis"),
        (scoring.overall_points(*terms) / 10000).alias("overall"),
        scoring.label(*terms).alias("label"),
        (F.col("agr") / 10000).alias("agreement"),
        (F.col("qual") / 10000).alias("evidence_quality"),
        (F.col("ind") / 10000).alias("independence"),
        "yes",
        "no",
        "no_effect",
        F.when((F.col("n_yes") > 0) & (F.col("n_no") > 0), disagreement(F.col("yes_where"), F.col("no_where"))).alias("why"),
        "n_findings",
    )


def link_papers(links: DataFrame, findings: DataFrame) -> DataFrame:
    """The sources behind each link's own results: id and a set of papers."""
    ids = links.select("id", F.explode(F.concat("yes", "no", "no_effect")).alias("finding"))
    return ids.join(findings.select(F.col("id").alias("finding"), "paper"), "finding").groupBy("id").agg(F.array_sort(F.collect_set("paper")).alias("papers"))

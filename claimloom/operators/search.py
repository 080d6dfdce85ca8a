"""Searching texts: keywords, lines, flags, budgets, request defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import folded
from claimloom.vocabulary import TIERS


def keyword_hits(texts: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: how many of the query's words a text has, over texts that have any."""
    words = sorted({w for w in query.lower().split() if w})
    have = F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+")
    score = F.transform(F.array(have), lambda x: F.size(F.array_intersect(x, F.array(*map(F.lit, words)))))[0]
    return texts.select(id_col, score.cast("long").alias("score")).where("score > 0")


def top_hits(hits: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    return hits.orderBy(F.desc("score"), id_col).limit(n)


def lines(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "content"))


def grep(texts: DataFrame, needle: str, context: int = 0, ignore_case: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matching lines and `context` lines around them: id, line, content, matched."""
    rows = lines(texts.where(F.contains(F.lower(text_col), F.lit(needle.lower())) if ignore_case else F.contains(F.col(text_col), F.lit(needle))), id_col, text_col)
    hit = F.contains(F.lower("content"), F.lit(needle.lower())) if ignore_case else F.contains(F.col("content"), F.lit(needle))
    around = Window.partitionBy(id_col).orderBy("line").rowsBetween(-context, context)
    return rows.withColumn("matched", hit).withColumn("_near", F.bool_or("matched").over(around)).where("_near").drop("_near")


def bool_grep(texts: DataFrame, needles: list[str], cap: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of texts that hold all needles; with a cap the count is a lower bound."""
    rows = texts.select(id_col, F.lower(text_col).alias("_t"))
    for n in needles:
        rows = rows.where(F.contains("_t", F.lit(n.lower())))
    rows = rows.select(id_col)
    return rows if cap is None else rows.orderBy(id_col).limit(cap)


def head_lines(texts: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return lines(texts, id_col, text_col).where(F.col("line") < n)


def budgeted(hits: DataFrame, depth: str, order: list) -> DataFrame:
    """What a depth's budget of papers lets through, best first, and whether that cut anything off."""
    most = TIERS[depth][0]
    top = hits.orderBy(*order).limit(most + 1)
    w = Window.orderBy(*order)  # at most the budget and one more row
    rows = top.withColumn("_n", F.row_number().over(w))
    return rows.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > most).where(F.col("_n") <= most).drop("_n")


def requests(raw: DataFrame, column: str = "task") -> DataFrame:
    """Requests from JSON or plain text, with defaults; each substitution is noted."""
    j = F.from_json(column, "graph_id string, ask string, target string, depth string, years string, reason string", {"mode": "PERMISSIVE"})
    is_json = F.trim(column).startswith("{")
    got = lambda f: F.when(is_json, F.nullif(F.col("_j")[f], F.lit("")))
    rows = raw.withColumn("_j", j)
    note = lambda f, to: F.when(got(f).isNull(), F.lit(f"{f}: not given, {to} used"))
    return rows.select(
        *raw.columns,
        got("graph_id").alias("graph_id"),
        F.coalesce(got("ask"), F.lit("new_question")).alias("ask"),
        F.when(is_json, F.col("_j.target")).otherwise(F.col(column)).alias("target"),
        F.when(got("depth").isin(*TIERS), got("depth")).otherwise("standard").alias("depth"),
        got("years").alias("years"),
        F.array_compact(F.array(note("ask", "new_question"), note("depth", "standard"), note("years", "no floor"))).alias("defaults_applied"),
    )


def served(texts: DataFrame) -> bool:
    """Whether a source that must have rows returns any, before anything is planned on it."""
    return not texts.limit(1).isEmpty()


def lookup(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose `column` equals `value`, both folded."""
    return rows.where(folded(F.col(column)) == folded(F.lit(value)))


def overlap(left: DataFrame, right: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """How two result sets overlap: n_left, n_right, n_both, jaccard."""
    sides = left.select(id_col).distinct().withColumn("l", F.lit(1)).join(right.select(id_col).distinct().withColumn("r", F.lit(1)), id_col, "full")
    n = sides.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count("*").alias("n"))
    return n.select("n_left", "n_right", "n_both", F.when(F.col("n") > 0, F.col("n_both") / F.col("n")).alias("jaccard"))


def passes(rows: DataFrame, order: list[str], size: int = 5, group: str | None = None) -> DataFrame:
    """Fixed batches of `size` rows in each group's order: pass numbers from 0."""
    w = Window.partitionBy(*([group] if group else [])).orderBy(*order)
    return rows.withColumn("pass", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def absence(counts: DataFrame) -> DataFrame:
    """status for (depth, n): a quick search without rows is empty and truncated, never evidence of absence."""
    empty = F.col("n") == 0
    return counts.withColumns({"status": F.when(empty, "empty").otherwise("complete"), "truncated": empty & (F.col("depth") == "quick"), "may_say_none": empty & (F.col("depth") == "exhaustive")})


def registry_matches(names: DataFrame, registry: DataFrame) -> DataFrame:
    """name, organism -> accession, by normalized name and organism; several hits stay as an ambiguity."""
    from claimloom.functions.text import normalize_name

    key = lambda df: df.withColumns({"_n": normalize_name(F.col("name")), "_o": F.lower(F.trim("organism"))})
    hits = key(names).join(key(registry).select("_n", "_o", "accession").distinct(), ["_n", "_o"], "left").groupBy("name", "organism").agg(F.array_sort(F.collect_set("accession")).alias("found"))
    return hits.select("name", "organism", F.when(F.size("found") == 1, F.col("found")[0]).alias("accession"), F.when(F.size("found") > 1, F.col("found")).otherwise(F.array().cast("array<string>")).alias("ambiguity"))

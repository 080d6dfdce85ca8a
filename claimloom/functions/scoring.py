"""Link scores in integer units of 1/10000, so that every engine rounds alike."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.vocabulary import BASIS_WEIGHT, OTHER_BASIS_WEIGHT, PREPRINT_SHARE, STUDY_QUALITY, UNKNOWN_QUALITY


def _div(top: Column, bottom: Column | int) -> Column:
    """Integer division of non-negative longs."""
    return F.call_function("div", top.cast("long"), (bottom if isinstance(bottom, Column) else F.lit(bottom)).cast("long"))


def lookup(keys: Column, table: dict, default) -> Column:
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.element_at(pairs, F.coalesce(keys, F.lit(""))), F.lit(default))


def study_points(study_type: Column, is_preprint: Column) -> Column:
    """Quality of one source in 1/10000: a source that is missing counts as unknown."""
    share = F.when(F.coalesce(is_preprint, F.lit(False)), PREPRINT_SHARE).otherwise(100)
    return (lookup(study_type, STUDY_QUALITY, UNKNOWN_QUALITY) * share).cast("long")


def agreement_points(yes: Column, no: Column) -> Column:
    """0 without results, half for a single one, else the share that says yes."""
    t = yes + no
    return F.when(t == 0, 0).when(t == 1, 5000).otherwise(_div(20000 * yes + t, 2 * t)).cast("long")


def quality_points(points: Column, n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(_div(2 * points + n, 2 * n)).cast("long")


def independence_points(authors: Column, papers: Column) -> Column:
    spare = papers - 1
    return F.when(papers <= 1, 0).otherwise(_div(20000 * (authors - 1) + spare, 2 * spare)).cast("long")


def overall_points(agreement: Column, quality: Column, independence: Column) -> Column:
    return _div(8 * agreement + 8 * quality + 4 * independence + 10, 20)


def label(agreement: Column, quality: Column, independence: Column) -> Column:
    """By the overall score before it is rounded."""
    raw = 8 * agreement + 8 * quality + 4 * independence
    return F.when(raw >= 140000, "high").when(raw >= 80000, "medium").otherwise("low")


def score_label(overall: Column) -> Column:
    return F.when(overall >= 0.7, "high").when(overall >= 0.4, "medium").otherwise("low")


def state(yes: Column, no: Column, no_effect: Column) -> Column:
    return (
        F.when((yes == 0) & (no == 0) & (no_effect > 0), "no_effect")
        .when((yes > 0) & (no > 0), "disagreed")
        .when((yes >= 2) | (no >= 2), "agreed")
        .otherwise("single_source")
    )


def basis(own: Column, own_hedged: Column) -> Column:
    return F.when(own == 0, "background_only").when(own_hedged == own, "hedged_only").when(own_hedged > 0, "mixed").otherwise("primary")


def basis_weight(b: Column) -> Column:
    return lookup(b, BASIS_WEIGHT, OTHER_BASIS_WEIGHT)

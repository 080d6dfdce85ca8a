"""Audit tables of a graph: derived on demand, never stored.

Functions of a whole graph take its tables by name: things, papers, findings, links, gaps and meta (one
row; columns that it lacks are not recorded). What a consumer reads as a list of ids, of which a graph
may have any number, is a table of pairs here.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import contract
from claimloom.functions import scoring, text
from claimloom.operators import links as linking
from claimloom.operators import quality
from claimloom.vocabulary import GRADES, META, STUDY_GRADE, STUDY_QUALITY


def _rows(df: DataFrame, rows: list[tuple], ddl: str) -> DataFrame:
    """Fixed rows as a table."""
    return df.sparkSession.createDataFrame(rows, ddl)


def _said(form: str, *parts: Column) -> Column:
    """`form` with each %s replaced by a part."""
    out = []
    for piece, part in zip(form.split("%s"), [*parts, None], strict=True):
        out += [F.lit(piece)] + ([] if part is None else [part.cast("string")])
    return F.concat(*out)


def graded(study_type: Column, is_preprint: Column, retracted: Column, quote_verified: Column) -> Column:
    """By study type; a preprint or an unverified quote is LOW at most, a retracted source is unsupported."""
    rank = F.array_position(F.array(*map(F.lit, GRADES)), scoring.lookup(study_type, STUDY_GRADE, "UNSUPPORTED"))
    rank = F.when(F.coalesce(is_preprint, F.lit(False)), F.least(rank, F.lit(2).cast("long"))).otherwise(rank)
    rank = F.when(F.coalesce(retracted, F.lit(False)), 1).otherwise(rank)
    rank = F.when(F.coalesce(quote_verified, F.lit(False)), rank).otherwise(F.least(rank, F.lit(2).cast("long")))
    return F.element_at(F.array(*map(F.lit, GRADES)), rank.cast("int"))


def _named(rows: DataFrame, things: DataFrame, ends=("src", "dst")) -> DataFrame:
    """`rows` with `<end>_name`: the entity's name, the id where there is none."""
    for end in ends:
        rows = rows.join(things.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return rows


def evidence_id(finding: Column) -> Column:
    """A claim's id as the audit tables spell it: legal ids as they are, others with a digest, so that
    no two claims share one."""
    slug = text.slug(finding)
    return F.concat(F.lit("evidence."), F.when(slug == finding, slug).otherwise(F.concat_ws("_", slug, F.substring(F.sha2(finding, 256), 1, 8))))


def evidence_rows(findings: DataFrame, papers: DataFrame, things: DataFrame) -> DataFrame:
    """One row for each claim: its sentence, where it comes from, and how far it carries."""
    p = papers.select(F.col("id").alias("paper"), "doi", "pmid", "study_type", "is_preprint", "retracted")
    rows = _named(findings.join(p, "paper", "left"), things)
    setting = F.col("setting") if "setting" in findings.columns else None
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if c in findings.columns else F.lit(None).cast("string")
    return rows.select(
        "id",
        evidence_id(F.col("id")).alias("evidence_id"),
        text.claim(F.col("src_name"), F.col("how"), F.col("dst_name"), F.col("says"), setting).alias("claim"),
        "paper",
        text.source_type(F.col("is_preprint")).alias("source_type"),
        text.source_id(F.col("doi"), F.col("pmid")).alias("source_id"),
        text.source_reference(F.col("doi"), F.col("pmid")).alias("source_url"),
        blank("section").alias("locator"),
        blank("quote").alias("quote"),
        graded(F.col("study_type"), F.col("is_preprint"), F.col("retracted"), F.col("quote_verified")).alias("grade"),
        F.lit(False).alias("synthetic"),
    )


def quote_summary(findings: DataFrame) -> DataFrame:
    v = F.col("quote_verified")
    return findings.agg(F.count_if(v).alias("verified"), F.count_if(v.isNull() | ~v).alias("unverified"), F.count_if(~v).alias("mismatched"), F.count_if(v.isNull()).alias("unchecked"))


def _meta(graph: dict[str, DataFrame]) -> DataFrame:
    """The graph's one row of meta, null where something is not recorded."""
    one = graph["findings"].sparkSession.range(1).select()
    meta = one.join(graph["meta"], F.lit(True), "left") if "meta" in graph else one
    kinds = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in META.replace("array<struct<q:string,tool:string,search_id:string,n_results:int>>", "array<string>").split(", ")}
    have = dict(meta.dtypes)
    asked = {"queries": F.transform("queries", lambda q: q["q"])} if have.get("queries", "").startswith("array<struct") else {}
    return meta.select(*(asked.get(n, F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in kinds.items()))


def figures(graph: dict[str, DataFrame]) -> DataFrame:
    """One row of all sums that the audit tables need, and the meta row beside them. Each table is summed once."""
    v, blank = F.col("quote_verified"), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    f = graph["findings"].agg(F.count("*").alias("n_findings"), F.count_if(v).alias("n_verified"), F.count_if(~v).alias("n_mismatched"), F.count_if(v.isNull()).alias("n_unchecked"))
    of = lambda state: F.count_if(F.col("state") == state)
    points = lambda c: F.round(F.col(c) * 10000).cast("long")
    li = graph["links"].agg(F.count("*").alias("n_links"), of("disagreed").alias("n_disputed"), of("agreed").alias("n_agreed"), of("single_source").alias("n_single"), of("no_effect").alias("n_no_effect"), F.min(points("overall")).alias("low"), F.max(points("overall")).alias("high"), *(F.sum(points(t)).alias(f"sum_{t}") for t in ("overall", "agreement", "evidence_quality", "independence")))
    mean = lambda t: F.when(F.col("n_links") > 0, F.round(F.col(f"sum_{t}") / (F.col("n_links") * 10000.0), 4))
    li = li.withColumns({f"mean_{t}": mean(t) for t in ("overall", "agreement", "evidence_quality", "independence")}).withColumns({"low": F.col("low") / 10000, "high": F.col("high") / 10000})
    have = graph["papers"].columns
    p = graph["papers"].agg(F.count("*").alias("n_papers"), F.coalesce(F.bool_or("retracted"), F.lit(False)).alias("any_retracted"), F.count_if(F.col("is_preprint").isNull()).alias("n_no_preprint"), F.count_if(blank("first_author")).alias("n_no_author"), (F.count_if(blank("source_sha256")) if "source_sha256" in have else F.count("*")).alias("n_no_hash"))
    t = graph["things"].agg(F.count("*").alias("n_things"), F.count_if(F.col("kind").isin("protein", "gene") & (F.trim(F.coalesce("uniprot_accession", F.lit(""))) == "")).alias("n_proteins"), F.coalesce(F.bool_or(F.col("kind") == "disease"), F.lit(False)).alias("any_disease"))
    g = graph["gaps"].agg(F.count("*").alias("n_gaps"))
    m = _meta(graph).withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("ok")))
    return m.join(f).join(li).join(p).join(t).join(g)


#: The column of `figures` that each metric is, in the order of the contract.
_METRIC_OF = ["found", "read", "used", "n_verified", "n_unchecked", "n_mismatched", "n_links", "n_disputed", "n_agreed", "n_single", "n_no_effect", "n_gaps", "mean_overall", "n_things"]


def metrics(graph: dict[str, DataFrame]) -> DataFrame:
    """The metrics: id, label, value, unit, display, meaning, direction, assumption_ids. What stands
    behind them is in `metric_evidence`."""
    rows = []
    for (mid, label, unit, word, meaning, direction, assumed), column in zip(contract.METRICS, _METRIC_OF, strict=True):
        spelled = text.score_text(F.col(column)) if column == "mean_overall" else F.col(column).cast("string")
        shown = F.coalesce(F.concat(spelled, F.lit(f" {word}")), F.lit("not recorded"))
        rows.append(F.struct(F.lit(mid).alias("id"), F.lit(label).alias("label"), F.col(column).cast("double").alias("value"), F.lit(unit).alias("unit"), shown.alias("display"), F.lit(meaning).alias("meaning"), F.lit(direction).alias("direction"), F.array(*map(F.lit, sorted(assumed))).cast("array<string>").alias("assumption_ids")))
    return figures(graph).select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def metric_evidence(graph: dict[str, DataFrame]) -> DataFrame:
    """(metric, evidence_id): the claims behind each metric that rests on claims."""
    slug = evidence_id(F.col("id"))
    v = F.col("quote_verified")
    of = F.when(v, "metric.findings_verified").when(~v, "metric.findings_quote_mismatch").otherwise("metric.findings_unverified")
    by_quote = graph["findings"].select(of.alias("metric"), slug.alias("evidence_id"))
    names = {"disagreed": "metric.relationships_disputed", "agreed": "metric.relationships_agreed", "single_source": "metric.relationships_single_source", "no_effect": "metric.relationships_no_effect"}
    behind = graph["links"].where(F.col("state").isin(*names)).select(scoring.lookup(F.col("state"), names, "").alias("metric"), F.explode(F.concat("yes", "no", "no_effect")).alias("id")).distinct()
    known = behind.join(graph["findings"].select("id").distinct(), "id", "left_semi")
    return by_quote.unionByName(known.select("metric", slug.alias("evidence_id"))).distinct()


def confidence_profile(findings: DataFrame, low: float = 0.65) -> DataFrame:
    c = F.col("confidence")
    hedged = F.coalesce("hedged", F.lit(False)) & (c > low)
    return findings.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(c < low).alias("below"), F.count_if(hedged).alias("hedged_but_confident"))


def uncertainty(links: DataFrame) -> DataFrame:
    """min, mean and max of the overall scores in 1/10000 as an interval; no row without links."""
    o = F.round(F.col("overall") * 10000).cast("long")
    return links.agg(F.count("*").alias("n"), (F.min(o) / 10000).alias("low"), (F.sum(o) / (F.count("*") * 10000.0)).alias("mean"), (F.max(o) / 10000).alias("high")).where("n > 0")


def _first_ids(df: DataFrame, n: int) -> Column | DataFrame:
    """One row: the first `n` ids in order, as text."""
    few = df.orderBy("id").limit(n)
    return few.agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"))


def limitations(graph: dict[str, DataFrame]) -> DataFrame:
    """code, severity, message, field_path of every limitation that holds, the worst first."""
    f = graph["findings"]
    dangling = quality.dangling_references(f, graph["links"], graph["gaps"], graph["things"], graph["papers"]).select("id").distinct()
    lost = dangling.agg(F.count("*").alias("n_dangling")).join(_first_ids(dangling, 10).withColumnRenamed("ids", "dangling"))
    wrong = _first_ids(f.where(~F.col("quote_verified")).select("id"), 8).withColumnRenamed("ids", "mismatched")
    aimless = quality.interventions_without_target(graph["links"], graph["things"]).agg(F.count("*").alias("n_aimless"))
    one = figures(graph).join(lost).join(wrong).join(aimless)

    c = F.col
    stop = F.nullif("stop_reason", F.lit(""))
    omitted = F.array_join(F.array_sort(F.coalesce("defaults_applied", F.array().cast("array<string>"))), ", ")
    missing = F.array_compact(F.array(*(F.when(c(k).isNull(), F.lit(f"coverage.{k}")) for k in ("found", "read", "used"))))
    unknown_metrics = [F.when(c(k).isNull(), F.lit(m[0])) for m, k in zip(contract.METRICS, _METRIC_OF, strict=True)]
    unknown_steps = [F.when(v.isNull(), F.lit(step[0])) for step, v in zip(contract.STEPS, _step_results(), strict=True)]
    named = F.transform(F.array_sort(F.coalesce("defaults_applied", F.array().cast("array<string>"))), lambda d: F.concat(F.lit("assumption.default."), _default_slug(d)))
    unknown_assumptions = [F.when(c(k).isNull(), F.lit(f"assumption.{n}")) for k, n in (("depth", "depth"), ("max_papers", "limits.max_papers"), ("max_queries", "limits.max_queries"), ("years", "years"))]
    unknown = F.array_sort(F.concat(F.array_compact(F.array(*unknown_metrics, *unknown_steps, *unknown_assumptions)), named))
    untagged = F.array_compact(F.array(F.when(c("n_verified") == 0, F.lit("metric.findings_verified")), F.when(c("n_unchecked") == 0, F.lit("metric.findings_unverified")), F.when(c("n_mismatched") == 0, F.lit("metric.findings_quote_mismatch")), F.lit("metric.entities")))
    some = lambda k: F.coalesce(c(k), F.lit(0)) > 0
    holds = {
        "UNVERIFIED_QUOTE": (some("n_unchecked"), [c("n_unchecked"), c("n_findings")]),
        "QUOTE_MISMATCH": (some("n_mismatched"), [c("n_mismatched"), c("mismatched")]),
        "QUOTES_DISCARDED": (some("no_quote_discarded"), [c("no_quote_discarded")]),
        "EMPTY_EVIDENCE": (c("n_findings") == 0, []),
        "DEPTH_NOT_SPECIFIED": (c("depth").isNull(), []),
        "YEARS_NOT_SPECIFIED": (c("years").isNull(), []),
        "DEFAULTS_APPLIED": (F.size(F.coalesce("defaults_applied", F.array().cast("array<string>"))) > 0, [omitted]),
        "UNTAGGED_VALUE": (F.size(untagged) > 0, [F.array_join(untagged, ", ")]),
        "EMPTY_METRICS": (F.lit(not contract.METRICS), []),
        "HEURISTIC_CONFIDENCE": (F.lit(True), []),
        "TRUNCATED_SEARCH": (c("truncated"), [F.coalesce(stop, F.lit("unrecorded"))]),
        "COVERAGE_INCOMPLETE": (F.coalesce(stop, F.lit("")) != "complete", [F.coalesce(stop, F.lit("not recorded"))]),
        "QUERIES_NOT_RECORDED": (F.size(F.coalesce("queries", F.array().cast("array<string>"))) == 0, []),
        "SINGLE_SOURCE_LINKS": (some("n_single"), [c("n_single"), c("n_links")]),
        "DISPUTED_LINKS": (some("n_disputed"), [c("n_disputed")]),
        "PROTEINS_WITHOUT_ACCESSION": (some("n_proteins"), [c("n_proteins")]),
        "INTERVENTIONS_WITHOUT_TARGET": (some("n_aimless"), [c("n_aimless")]),
        "NO_DISEASE_NODE": ((c("n_things") > 0) & ~c("any_disease"), []),
        "RETRACTED_SOURCE": (c("any_retracted"), []),
        "INTERPRETABILITY_PARTIAL": (some("n_no_hash"), [c("n_no_hash"), c("n_papers")]),
        "ROUND_PARTIAL": (c("status") == "partial", []),
        "ROUND_EMPTY": (c("status") == "empty", []),
        "ROUND_ERROR": (F.coalesce("error", F.lit("")) != "", [text.plain(c("error"))]),
        "COVERAGE_NOT_RECORDED": (F.size(missing) > 0, [F.array_join(missing, ", ")]),
        "LIMITS_NOT_RECORDED": (~some("max_papers"), []),
        "INDEPENDENCE_OVERSTATED": (some("n_no_author"), [c("n_no_author"), c("n_papers")]),
        "DANGLING_REFERENCE": (some("n_dangling"), [c("n_dangling"), c("dangling")]),
        "UNKNOWN_VALUE": (F.size(unknown) > 0, [F.size(unknown), F.array_join(unknown, ", ")]),
        "PREPRINT_STATUS_UNRECORDED": (some("n_no_preprint"), [c("n_no_preprint"), c("n_papers")]),
        "EMPTY_COUNTERFACTUALS": (c("n_links") == 0, []),
    }
    told = lambda code, parts: F.struct(F.lit(code).alias("code"), F.lit(contract.LIMITATIONS[code][0]).alias("severity"), _said(contract.LIMITATIONS[code][2], *parts).alias("message"), F.lit(contract.LIMITATIONS[code][1]).alias("field_path"))
    rows = one.select(F.explode(F.array_compact(F.array(*(F.when(F.coalesce(h, F.lit(False)), told(code, parts)) for code, (h, parts) in holds.items())))).alias("r")).select("r.*")

    severity, path, message = contract.LIMITATIONS["SOURCE_ID_MISSING"]
    p = graph["papers"].select(F.col("id").alias("paper"), text.source_id(F.col("doi"), F.col("pmid")).alias("known"))
    bare = f.select("paper").distinct().join(p, "paper", "left").where("known is null").select("paper").distinct()
    own = lambda form: _said(form, F.coalesce("paper", F.lit("None")))
    bare = bare.select(F.lit("SOURCE_ID_MISSING").alias("code"), F.lit(severity).alias("severity"), own(message).alias("message"), own(path).alias("field_path"))
    return rows.unionByName(bare).orderBy(F.array_position(F.array(*map(F.lit, contract.SEVERITIES)), F.col("severity")), "code", "field_path")


def counterfactuals(graph: dict[str, DataFrame]) -> DataFrame:
    """change, result, meaning: what would move the conclusion, computed by the scores themselves.

    One opposing result by another group for the strongest link, one replication for the strongest
    single-source link, and a search without limits. No row without links. The two links are looked up
    first, and only their claims are scored.
    """
    links_, f, papers = graph["links"], graph["findings"], graph["papers"]
    best = links_.orderBy(F.desc("overall"), "id")
    cases = best.limit(1).withColumn("case", F.lit("no")).unionByName(best.where("state = 'single_source'").limit(1).withColumn("case", F.lit("yes")))
    cases = cases.select("case", "id", "src", "how", "dst", "state", "overall", F.element_at(F.concat("yes", "no", "no_effect", F.array(F.lit(None).cast("string"))), 1).alias("first"))
    claims = linking.own_results(f).join(F.broadcast(cases.select("src", "how", "dst").distinct()), linking.KEY, "left_semi")
    m = linking.link_measures(claims, papers).select("src", "how", "dst", "n_findings", "n_yes", "n_no", "n_no_effect", "points", "n_authors", "n_papers")
    model = f.select(F.col("id").alias("first"), "paper").join(papers.select(F.col("id").alias("paper"), "study_type"), "paper", "left").select("first", F.nullif("study_type", F.lit("")).alias("study_type")).dropDuplicates(["first"])
    rows = cases.join(m, linking.KEY, "left").join(model, "first", "left").withColumn("study_type", F.coalesce("study_type", F.lit("unknown")))
    n = lambda k: F.coalesce(F.col(k), F.lit(0))
    yes, no = n("n_yes") + F.when(F.col("case") == "yes", 1).otherwise(0), n("n_no") + F.when(F.col("case") == "no", 1).otherwise(0)
    agr = scoring.agreement_points(yes, no)
    qual = scoring.quality_points(n("points") + scoring.study_points(F.col("study_type"), F.lit(False)), n("n_findings") + 1)
    ind = scoring.independence_points(n("n_authors") + 1, n("n_papers") + 1)
    after = scoring.overall_points(agr, qual, ind) / 10000
    result = _said(contract.RESCORED, F.col("state"), scoring.state(yes, no, n("n_no_effect")), text.score_text(F.col("overall")), text.score_text(after))
    rows = _named(rows, graph["things"])
    label = text.link_label(F.col("src_name"), F.col("how"), F.col("dst_name"))
    opposed = _said(contract.OPPOSED[0], F.col("study_type"), F.col("id"), label)
    replicated = _said(contract.REPLICATED[0], F.col("id"), label)
    # an opposing result needs claims that it opposes
    rows = rows.where("case = 'yes' or n_findings > 0").select(F.when(F.col("case") == "no", 1).otherwise(2).alias("place"), F.when(F.col("case") == "no", opposed).otherwise(replicated).alias("change"), result.alias("result"), F.when(F.col("case") == "no", contract.OPPOSED[1]).otherwise(contract.REPLICATED[1]).alias("meaning"))
    told = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("not recorded"))
    there = links_.limit(1).select(F.lit(1).alias("there"))
    always = _meta(graph).join(there).select(F.lit(3).alias("place"), F.lit(contract.SEARCHED_ON[0]).alias("change"), _said(contract.SEARCHED_ON[1], told("read"), told("found")).alias("result"), F.lit(contract.SEARCHED_ON[2]).alias("meaning"))
    return rows.unionByName(always).orderBy("place").drop("place")


def ledger(graph: dict[str, DataFrame]) -> DataFrame:
    """id, label, supporting, contradicting, no_effect: each link by name, with the claims on either axis
    under their evidence ids."""
    rows = _named(graph["links"], graph["things"])
    under = lambda axis: F.transform(axis, evidence_id)
    return rows.select("id", text.link_label(F.col("src_name"), F.col("how"), F.col("dst_name")).alias("label"), under("yes").alias("supporting"), under("no").alias("contradicting"), under("no_effect").alias("no_effect"))


def unique_slugs(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """`slug` for each row: x, then x_2, x_3 ... in `order` where it repeats."""
    w = Window.partitionBy("_slug").orderBy(*order)
    rows = df.withColumn("_slug", text.slug(F.col(column))).withColumn("_n", F.row_number().over(w))
    return rows.withColumn("slug", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("_", "_slug", F.col("_n").cast("string")))).drop("_slug", "_n")


def gap_labels(gaps: DataFrame, things: DataFrame) -> DataFrame:
    """A gap's two ends by name, the id where there is none."""
    name = lambda end: things.select(F.col("id").alias(end), F.col("name").alias(f"_{end}"))
    rows = gaps.join(name("a"), "a", "left").join(name("c"), "c", "left")
    return rows.withColumn("label", F.concat(F.coalesce("_a", "a"), F.lit(" ~ "), F.coalesce("_c", "c"))).drop("_a", "_c")


def headline(graph: dict[str, DataFrame]) -> DataFrame:
    """One row: title, result, plain_language, status and basis. A graph without claims is never told as
    evidence of absence."""
    c = F.col
    failed, nothing = c("status") == "failed", c("n_findings") == 0
    lacking = (c("n_verified") < c("n_findings")) | F.coalesce("truncated", F.lit(False)) | (F.coalesce("stop_reason", F.lit("")) != "complete")
    result = F.when(failed, "GRAPH_UNAVAILABLE").when(nothing, "NO_EVIDENCE_FOUND").when(c("n_disputed") > 0, "EVIDENCE_MAPPED_DISPUTED").when((c("n_links") > 0) & (c("n_single") == c("n_links")), "EVIDENCE_MAPPED_SINGLE_SOURCE").otherwise("EVIDENCE_MAPPED")
    status = F.when(failed, "FAILED").when(nothing, "INCONCLUSIVE").when((result != "EVIDENCE_MAPPED") | lacking, "QUALIFIED").otherwise("SUPPORTED")
    synthetic = F.size(F.coalesce("defaults_applied", F.array().cast("array<string>"))) > 0
    basis = F.array_compact(F.array(F.when(~nothing, F.lit("OBSERVED")), F.when(c("n_gaps") > 0, F.lit("INFERRED")), F.when(c("n_links") > 0, F.lit("MODELED")), F.when(synthetic, F.lit("SYNTHETIC"))))
    verb = lambda n, one, many: F.when(c(n) == 1, one).otherwise(many)
    mapped = _said(contract.MAPPED_SENTENCE, F.coalesce(c("used").cast("string"), F.lit("not recorded")), text.counted(c("n_links"), "relationship"), text.counted(c("n_findings"), "quote-backed finding"), c("n_agreed"), verb("n_agreed", "is", "are"), c("n_single"), verb("n_single", "rests", "rest"), c("n_disputed"), verb("n_disputed", "is", "are"))
    why = F.coalesce(F.nullif(text.plain(c("error")), F.lit("")), F.lit(contract.UNSERVED))
    told = F.when(failed, _said(contract.FAILED_SENTENCE, why)).when(nothing, contract.NOTHING_SENTENCE).otherwise(mapped)
    title = F.when(failed, contract.NO_GRAPH_TITLE).otherwise(_said(contract.GRAPH_TITLE, c("n_links"), c("n_papers")))
    return figures(graph).select(title.alias("title"), result.alias("result"), told.alias("plain_language"), status.alias("status"), F.when(F.size(basis) == 0, F.array(F.lit("INFERRED"))).otherwise(basis).alias("basis"))


def _step_results() -> list[Column]:
    """The result of each step over `figures`, in the order of the contract."""
    return [F.col(k).cast("double") for k in ("found", "used", "n_verified", "n_things", "n_links", "mean_agreement", "mean_evidence_quality", "mean_independence", "mean_overall", "n_gaps", "used")]


def steps(graph: dict[str, DataFrame]) -> DataFrame:
    """position, id, label, method, formula, inputs (path, value as JSON text, unit), value, unit and
    assumption_ids of every step."""
    shown = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("null"))
    json_of = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(shown(c))
    c, fixed = F.col, lambda x: F.lit(json.dumps(x, sort_keys=True))
    values = {
        "input.coverage.queries": json_of(F.coalesce("queries", F.array().cast("array<string>"))),
        "input.coverage.limits.max_queries": json_of(c("max_queries")),
        "input.depth": json_of(c("depth")),
        "output.coverage.found": json_of(c("found")),
        "output.coverage.limits.max_papers": json_of(c("max_papers")),
        "input.findings[].quote": json_of(c("n_findings") + F.coalesce("no_quote_discarded", F.lit(0))),
        "input.papers[].source_text": json_of(c("n_papers") - c("n_no_hash")),
        "input.things": json_of(c("n_things")),
        "output.findings": json_of(c("n_findings")),
        "output.links[].yes|no": json_of(c("n_links")),
        "output.papers[].study_type": json_of(c("n_papers")),
        "output.papers[].first_author": json_of(c("n_first_authors")),
        "output.links": json_of(c("n_links")),
        "code.GAP_RANKING_CONSTANTS": fixed(contract.GAP_RANKING_CONSTANTS),
        "output.coverage.stop_reason": json_of(F.nullif("stop_reason", F.lit(""))),
        "output.coverage.truncated": json_of(c("truncated")),
    } | {f"code.CONFIDENCE_WEIGHTS.{k}": fixed(v) for k, v in contract.CONFIDENCE_WEIGHTS.items()}
    rows = []
    for i, ((sid, label, method, formula, inputs, unit, assumed), value) in enumerate(zip(contract.STEPS, _step_results(), strict=True)):
        told = F.concat(F.lit(method), F.coalesce(F.nullif("stop_reason", F.lit("")), F.lit("not recorded"))) if sid == "step.stop" else F.lit(method)
        given = F.array(*(F.struct(F.lit(p).alias("path"), values[p].alias("value"), F.lit(u).cast("string").alias("unit")) for p, u in inputs))
        rows.append(F.struct(F.lit(i + 1).alias("position"), F.lit(sid).alias("id"), F.lit(label).alias("label"), told.alias("method"), F.lit(formula).cast("string").alias("formula"), given.alias("inputs"), value.alias("value"), F.lit(unit).alias("unit"), F.array(*map(F.lit, assumed)).cast("array<string>").alias("assumption_ids")))
    authors = author_count(graph["papers"]).withColumnRenamed("n_authors", "n_first_authors")
    return figures(graph).join(authors).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def lineage(any_table: DataFrame) -> DataFrame:
    """output_path, input_paths, transformation."""
    return _rows(any_table, contract.LINEAGE, "output_path string, input_paths array<string>, transformation string")


def _default_name(note: Column) -> Column:
    """The field of a note on a default: what stands before its colon, or the note."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(note, ":", 1)), F.lit("")), note)


def _default_slug(note: Column) -> Column:
    return text.slug(_default_name(note))


def assumptions(graph: dict[str, DataFrame]) -> DataFrame:
    """id, path, value (JSON text, null if not recorded), unit, basis, synthetic: the fixed ones, then every
    default that was substituted, in order. A round has few defaults."""
    shown = lambda k: F.when(F.col(k).isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col(k).alias("v"))), r'^\{"v":(.*)\}$', 1))
    fixed = {"assumption.confidence_weights": contract.CONFIDENCE_WEIGHTS, "assumption.study_quality_table": {k: v / 100 for k, v in STUDY_QUALITY.items()}, "assumption.preprint_penalty": contract.PREPRINT_PENALTY, "assumption.own_result_only": True, "assumption.gap_ranking": contract.GAP_RANKING_CONSTANTS}
    value = {"assumption.depth": shown("depth"), "assumption.limits.max_papers": shown("max_papers"), "assumption.limits.max_queries": shown("max_queries"), "assumption.years": shown("years")} | {k: F.lit(json.dumps(v, sort_keys=True)) for k, v in fixed.items()}
    rows = [F.struct(F.lit(i).alias("place"), F.lit(a).alias("id"), F.lit(p).alias("path"), value[a].cast("string").alias("value"), F.lit(u).alias("unit"), F.lit(b).alias("basis"), F.lit(False).alias("synthetic")) for i, (a, p, u, b) in enumerate(contract.ASSUMPTIONS)]
    meta = _meta(graph)
    out = meta.select(F.explode(F.array(*rows)).alias("a")).select("a.*")
    notes = meta.select(F.posexplode(F.array_sort(F.coalesce("defaults_applied", F.array().cast("array<string>")))).alias("at", "note"))
    notes = unique_slugs(notes.withColumn("field", _default_name(F.col("note"))), "field", ["at"])
    more = notes.select((F.col("at") + len(rows)).alias("place"), F.concat(F.lit("assumption.default."), "slug").alias("id"), F.concat(F.lit("input."), "field").alias("path"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("unit"), F.concat(F.lit(contract.DEFAULT_BASIS), "note").alias("basis"), F.lit(True).alias("synthetic"))
    return out.unionByName(more).orderBy("place").drop("place")


def uncertainty_block(graph: dict[str, DataFrame]) -> DataFrame:
    """One row: method, the observed range as an interval (null without links) and limitations."""
    told = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("None"))
    first, *rest, last = contract.UNCERTAINTY_LIMITATIONS
    span = F.when(F.col("n_links") > 0, F.struct(F.lit("metric.mean_link_confidence").alias("metric_id"), F.round("low", 4).alias("low"), F.col("mean_overall").alias("central"), F.round("high", 4).alias("high"), F.lit("score").alias("unit"), F.lit(None).cast("double").alias("confidence_level"), F.lit("observed_range").alias("interval_type")))
    return figures(graph).select(F.lit(contract.UNCERTAINTY_METHOD).alias("method"), span.alias("interval"), F.array(_said(first, F.col("n_links")), *map(F.lit, rest), _said(last, told("read"), told("found"))).alias("limitations"))


def quote_verification(graph: dict[str, DataFrame]) -> DataFrame:
    """One row: whether every quote was checked and found, and the counts by verdict. Fails closed."""
    one = figures(graph)
    return one.select(((F.col("n_findings") > 0) & (F.col("n_verified") == F.col("n_findings"))).alias("quote_verified"), F.col("n_verified").alias("verified"), F.col("n_unchecked").alias("unchecked"), F.col("n_mismatched").alias("mismatched"), F.coalesce("no_quote_discarded", F.lit(0)).cast("long").alias("discarded"), F.lit(True).alias("fails_closed"))


def interpretability(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All audit tables of a graph, by name."""
    return {
        "headline": headline(graph),
        "metrics": metrics(graph),
        "metric_evidence": metric_evidence(graph),
        "steps": steps(graph),
        "evidence": evidence_rows(graph["findings"], graph["papers"], graph["things"]).orderBy("id"),
        "assumptions": assumptions(graph),
        "uncertainty": uncertainty_block(graph),
        "limitations": limitations(graph),
        "counterfactuals": counterfactuals(graph),
        "lineage": lineage(graph["findings"]),
        "quote_verification": quote_verification(graph),
        "search": _meta(graph).select("queries", "depth", "max_papers", "max_queries", "found", "read", "used", "figures_read", "truncated", "stop_reason", "years"),
        "relationships": ledger(graph).orderBy("id"),
        "gap_labels": gap_labels(graph["gaps"], graph["things"]),
    }


def rule_checks(findings: DataFrame, papers: DataFrame, things: DataFrame) -> DataFrame:
    """An extraction's self-check: for each claim the rules that it breaks.

    quote_not_in_source: the quote is not in the text of the paper that it names (only where there is
    text); quote_not_contiguous: it is empty or holds an ellipsis or an editor's gap; entity_not_named:
    the quote lacks the name of either end; verb_not_in_quote: it lacks the relationship; not_own_result:
    a review's claim, or one that cites others, as an own result; hedge_mismatch: `hedged` is not what
    the quote's words say; contrast_not_split: a contrasting phrase is still in it. What needs a reader
    (the line it was read at, whether a condition is the sentence's own) is not judged.
    """
    own = text.quote_found(F.col("quote"), F.col("source_text"))
    p = papers.select(F.col("id").alias("paper"), "study_type", "source_text")
    names = lambda end: things.select(F.col("id").alias(end), text.folded(F.col("name")).alias(f"_{end}"))
    rows = findings.join(p, "paper", "left").join(names("src"), "src", "left").join(names("dst"), "dst", "left")
    quote, q = F.coalesce("quote", F.lit("")), text.folded(F.col("quote"))
    verb = F.lower(F.replace(F.coalesce("how", F.lit("")), F.lit("_"), F.lit(" ")))
    says = F.coalesce("is_own_result", F.lit(False))
    broken = {
        "quote_not_in_source": (F.trim(F.coalesce("source_text", F.lit(""))) != "") & ~own,
        "quote_not_contiguous": (F.trim(quote) == "") | quote.rlike(r"…|\.\.\.|\[\s*\.*\s*\]"),
        "entity_not_named": ~(F.contains(q, F.coalesce("_src", F.lower("src"))) & F.contains(q, F.coalesce("_dst", F.lower("dst")))),
        "verb_not_in_quote": ~F.contains(q, verb),
        "not_own_result": says & ((F.coalesce("study_type", F.lit("")) == "review") | text.cites_others(quote)),
        "hedge_mismatch": F.coalesce("hedged", F.lit(False)) != text.hedged(quote),
        "contrast_not_split": text.contrasts(quote),
    }
    return rows.select("id", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in broken.items()))).alias("broken"))


def recorded(n: Column, unit: str) -> Column:
    """A count with its unit; a count that is missing is told as such, not as 0."""
    return F.when(n.isNull(), "not recorded").otherwise(text.counted(n, unit))


def term_means(links: DataFrame) -> DataFrame:
    """The mean of each confidence term, over integer units; no row without links."""
    terms = ["agreement", "evidence_quality", "independence", "overall"]
    mean = lambda t: (F.sum(F.round(F.col(t) * 10000).cast("long")) / (F.count("*") * 10000.0)).alias(t)
    return links.agg(F.count("*").alias("n"), *map(mean, terms)).where("n > 0")


def author_count(papers: DataFrame) -> DataFrame:
    """Distinct first authors as written; all missing ones count as one."""
    return papers.agg(F.count_distinct(F.coalesce("first_author", F.lit("\0"))).alias("n_authors"))


def link_evidence(links: DataFrame) -> DataFrame:
    """id -> the claims that stand behind a link on any axis, sorted."""
    return links.select("id", F.array_sort(F.array_distinct(F.concat("yes", "no", "no_effect"))).alias("evidence"))


def coverage(findings: DataFrame, things: DataFrame, links: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for the latest round: what was discarded and dropped, what the quotes' verdicts are, what is missing."""
    rows = confidence_profile(findings).select(F.struct("*").alias("confidence_profile"))
    rows = rows.join(quote_summary(findings).select(F.col("unverified").alias("quotes_unverified")))
    rows = rows.join(quality.without_accession(things).agg(F.count("*").alias("proteins_without_accession_count")))
    rows = rows.join(quality.interventions_without_target(links, things).agg(F.count("*").alias("interventions_without_target_count")))
    return rows.join(quality.has_kind(things)).join(counts.select("no_quote_discarded", "duplicates_dropped"))

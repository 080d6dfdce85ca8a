"""A published graph, from its claims to its audit tables: what comes out is what was published."""

import json
import os

import pytest
from pyspark.sql import functions as F

from claimloom.operators import audit, gaps, links, quality

with open(os.path.join(os.path.dirname(__file__), "fixtures", "disputed_graph.json"), encoding="utf8") as f:
    WANT = json.load(f)


@pytest.fixture(scope="module")
def graph(spark):
    findings = spark.createDataFrame(WANT["findings"], "id string, paper string, src string, how string, dst string, says string, setting string, is_own_result boolean, hedged boolean, confidence double, quote_verified boolean, round int")
    papers = spark.createDataFrame(WANT["papers"], "id string, doi string, pmid string, first_author string, study_type string, is_preprint boolean, retracted boolean, source_sha256 string")
    things = spark.createDataFrame(WANT["things"], "id string, name string, kind string, uniprot_accession string")
    ids = spark.createDataFrame([r[:4] for r in WANT["links"]], "id string, src string, how string, dst string")
    table = links.scored_links(findings, papers).join(ids, ["src", "how", "dst"], "left")
    with_papers = table.join(links.link_papers(table, findings), "id", "left").withColumn("papers", F.coalesce("papers", F.array().cast("array<string>")))
    head = [("ok", 71, 7, 2, 2, True, "no_new_results", "standard", None, 25, 4, 0)]
    meta = spark.createDataFrame(head, "status string, found int, read int, used int, figures_read int, truncated boolean, stop_reason string, depth string, years string, max_papers int, max_queries int, no_quote_discarded long")
    return {"findings": findings, "papers": papers, "things": things, "links": table, "gaps": gaps.ranked_gaps(with_papers), "meta": meta}


def test_all_links(graph):
    names = ["id", "src", "how", "dst", "state", "basis", "overall", "label", "agreement", "evidence_quality", "independence", "yes", "no", "no_effect", "why"]
    got = [list(r) for r in graph["links"].select(*names).collect()]
    assert len(got) == 37 and sorted(got) == sorted(WANT["links"])


def test_all_gaps(graph):
    got = {(r.a, r.c): [r.implied_by, r.note, r.confidence] for r in graph["gaps"].collect()}
    assert len(got) == 50 and got == {tuple(g[0]): g[1:] for g in WANT["gaps"]}


def test_checks(graph):
    assert sorted(r.id for r in quality.interventions_without_target(graph["links"], graph["things"]).collect()) == WANT["interventions_without_target"]
    assert quality.without_accession(graph["things"]).count() == 0 and quality.has_kind(graph["things"]).head()[0]
    assert quality.dangling_references(*(graph[t] for t in ("findings", "links", "gaps", "things", "papers"))).count() == 0


def test_audit_block(graph):
    told = audit.interpretability(graph)
    head = told["headline"].head()
    assert (head.title, head.result, head.status, head.basis) == ("Evidence graph: 37 relationships from 20 papers", "EVIDENCE_MAPPED_DISPUTED", "QUALIFIED", ["OBSERVED", "INFERRED", "MODELED"])
    assert head.plain_language == "Read 2 papers and mapped 37 relationships from 44 quote-backed findings; 1 is corroborated by more than one paper, 28 rest on a single paper, and 1 is disputed."
    m = {r.id.split(".")[1]: r for r in told["metrics"].collect()}
    assert len(m) == 14 and (m["findings_verified"].value, m["findings_unverified"].value, m["findings_quote_mismatch"].value) == (35, 8, 1)
    assert (m["mean_link_confidence"].value, m["mean_link_confidence"].display, m["papers_found"].display) == (0.4426, "0.4426 mean", "71 found")
    span = told["uncertainty"].head().interval
    assert (span.low, span.central, span.high) == (0.24, 0.4426, 0.84)
    codes = [(r.code, r.severity) for r in told["limitations"].collect()]
    assert codes[:2] == [("QUOTE_MISMATCH", "ERROR"), ("UNVERIFIED_QUOTE", "ERROR")]
    assert {c for c, _ in codes} >= {"COVERAGE_INCOMPLETE", "QUERIES_NOT_RECORDED", "SINGLE_SOURCE_LINKS", "TRUNCATED_SEARCH", "UNTAGGED_VALUE", "DISPUTED_LINKS", "HEURISTIC_CONFIDENCE", "INTERPRETABILITY_PARTIAL", "UNKNOWN_VALUE", "YEARS_NOT_SPECIFIED"}
    moved = [r.result for r in told["counterfactuals"].collect()]
    assert len(moved) == 3 and moved[0].startswith("state agreed -> disagreed, heuristic confidence 0.84 -> ") and moved[2] == "unknown -- 7 of 71 papers found were read this round"
    assert told["steps"].count() == 11 and told["assumptions"].count() == 9 and told["lineage"].count() == 9 and told["relationships"].count() == 37 and told["evidence"].count() == 44
    assert told["quote_verification"].head()[:4] == (False, 35, 8, 1)
    claims = {r.id: r.claim for r in told["evidence"].collect()}
    things = {t[0]: t[1] for t in WANT["things"]}
    for i, _, a, how, b, says, where, *_ in WANT["findings"]:
        verb = {"no": f"does not {how}", "no_effect": "has no effect on"}.get(says, how)
        assert claims[i] == f"{things[a]} {verb} {things[b]}" + (f" ({where})" if where else "")

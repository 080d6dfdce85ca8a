import pytest
from pyspark.sql import functions as F

from claimloom.operators import audit, quality, rounds, search
from claimloom.plans import fold
from claimloom.sources import state
from claimloom.streaming import events


def test_chunks_are_greedy(spark):
    rows = spark.createDataFrame([(1, f"f{i:02d}", "x" * 400) for i in range(20)] + [(2, "g", "y" * 3000)], "round int, id string, body string")
    got = {(r.round, r.id): r.chunk for r in state.chunked(rows, ["id"], 1000).collect()}
    assert [got[1, f"f{i:02d}"] for i in range(5)] == [1, 1, 2, 2, 3] and got[2, "g"] == 1


def test_directory_hash_follows_names_and_content(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    one = state.directory_hash(spark, f"file://{tmp_path}").head()[0]
    (tmp_path / "b").write_text("3")
    assert len(one) == 64 and state.directory_hash(spark, f"file://{tmp_path}").head()[0] != one


def test_shown_graphs(spark, tmp_path):
    root = f"file://{tmp_path}"
    state.save_state({"gaps": spark.createDataFrame([("g1", "t1", "t2", "t3", ["L1"], "", 0.1, None)], state.TABLES["gaps"])}, f"{root}/g_1")
    assert state.shown(spark, root, "g_1")["gaps"].count() == 1
    shown = state.shown(spark, root, "g_1")
    assert shown["metrics"].count() == 14 and shown["headline"].head().result == "NO_EVIDENCE_FOUND"
    lost = state.shown(spark, root, "g_2")
    assert lost["meta"].head().error == "graph 'g_2' not found in memory"
    head, first = lost["headline"].head(), lost["limitations"].head()
    assert (head.result, head.status, head.basis) == ("GRAPH_UNAVAILABLE", "FAILED", ["INFERRED"])
    assert head.plain_language == "This round produced no graph: graph 'g_2' not found in memory"
    assert (first.code, first.severity, first.field_path) == ("GRAPH_NOT_FOUND", "ERROR", "output.error")
    other = state.abstention(spark, "g_3", "no answer", request={"round": 4, "found": 3})
    assert other["limitations"].head().code == "ROUND_NOT_SERVED" and other["meta"].head().found == 3


def test_answers_join_uses_with_requests(spark):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    uses = spark.createDataFrame([("e1", "grep"), ("e2", "sql")], "event_id string, name string").withColumn("ts", at(0))
    asked = spark.createDataFrame([(["e1", "e9"],)], "event_ids array<string>").withColumn("ts", at(5))
    assert [tuple(r) for r in events.answers(uses, asked).collect()] == [("e1", "grep")]
    assert events.answers(uses, asked.withColumn("ts", at(10_000))).count() == 0


def test_rule_checks(spark):
    ddl = "id string, paper string, src string, dst string, how string, quote string, is_own_result boolean, hedged boolean"
    rows = [
        ("f1", "p1", "t1", "t2", "hits", "Alpha hits Beta", True, False),
        ("f2", "p1", "t1", "t2", "hits", "", True, False),
        ("f3", "p2", "t1", "t2", "binds", "Alpha may bind nobody", True, False),
        ("f4", "p1", "t1", "t2", "hits", "Alpha hits Beta ... but not Gamma [14]", True, True),
        ("f5", "p3", "t1", "t2", "hits", "Alpha hits Beta (Smith et al., 2019)", False, False),
    ]
    p = spark.createDataFrame([("p1", "animal", "we saw Alpha hits Beta here"), ("p2", "review", "other text"), ("p3", "animal", None)], "id string, study_type string, source_text string")
    t = spark.createDataFrame([("t1", "Alpha"), ("t2", "Beta")], "id string, name string")
    got = {r.id: r.broken for r in audit.rule_checks(spark.createDataFrame(rows, ddl), p, t).collect()}
    assert got["f1"] == got["f5"] == []
    assert set(got["f2"]) == {"quote_not_in_source", "quote_not_contiguous", "entity_not_named", "verb_not_in_quote"}
    assert set(got["f3"]) == {"quote_not_in_source", "entity_not_named", "verb_not_in_quote", "not_own_result", "hedge_mismatch"}
    assert set(got["f4"]) == {"quote_not_in_source", "quote_not_contiguous", "not_own_result", "hedge_mismatch", "contrast_not_split"}


def test_budget_marks_truncation(spark):
    hits = spark.range(30).select(F.col("id"), (F.col("id") % 7).alias("score"))
    quick = search.budgeted(hits, "quick", [F.desc("score"), "id"]).collect()
    assert len(quick) == 10 and all(r.truncated for r in quick)
    assert not any(r.truncated for r in search.budgeted(hits, "deep", ["id"]).collect())


def test_grep_context_and_registry(spark):
    t = spark.createDataFrame([(1, "a\nb X\nc\nd\ne")], "doc_id long, text string")
    assert [(r.line, r.matched) for r in search.grep(t, "x", 1, ignore_case=True).orderBy("line").collect()] == [(0, False), (1, True), (2, False)]
    names = spark.createDataFrame([("AKT1", "Human"), ("GSK", "mouse"), ("none", "x")], "name string, organism string")
    reg = spark.createDataFrame([("akt1", "human", "P1"), ("gsk", "mouse", "P2"), ("GSK", "Mouse", "P3")], "name string, organism string, accession string")
    got = {r.name: (r.accession, r.ambiguity) for r in search.registry_matches(names, reg).collect()}
    assert got == {"AKT1": ("P1", []), "GSK": (None, ["P2", "P3"]), "none": (None, [])}


def test_small_views(spark):
    li = spark.createDataFrame([("L1", 0.5, 0.6, 0.0, 0.44, ["f2", "f1"], [], ["f1"])], "id string, agreement double, evidence_quality double, independence double, overall double, yes array<string>, no array<string>, no_effect array<string>")
    assert tuple(audit.term_means(li).head()) == (1, 0.5, 0.6, 0.0, 0.44) and audit.term_means(li.limit(0)).count() == 0
    assert audit.link_evidence(li).head().evidence == ["f1", "f2"]
    assert audit.author_count(spark.createDataFrame([("a",), (None,), (None,), ("a",)], "first_author string")).head()[0] == 2
    assert [r[0] for r in spark.createDataFrame([(2,), (1,), (None,)], "n int").select(audit.recorded(F.col("n"), "paper")).collect()] == ["2 papers", "1 paper", "not recorded"]
    rows = spark.createDataFrame([("L", 1, "single_source", 0.4), ("L", 2, "agreed", 0.7)], "id string, round int, state string, overall double")
    last = rounds.progression(rows, ["id"]).where("round = 2").head()
    assert (last.prior_state, last.moved) == ("single_source", 0.3)
    assert rounds.with_defaults(spark.createDataFrame([("f",)], "id string"), 3).head() == ("f", 3, [])
    acl = spark.createDataFrame([(1, True, None), (2, None, ["ann"]), (3, False, ["bob"])], "id int, public boolean, readers array<string>")
    assert [r.id for r in quality.visible(acl, "ann").collect()] == [1, 2] and [r.id for r in quality.visible(acl, None).collect()] == [1]
    ev = spark.createDataFrame([("a", "tool", None), ("b", "terminated", None), ("c", "error", "lost")], "event_id string, event_type string, error string")
    assert [(r.event_id, r.error) for r in events.outcomes(ev).collect()] == [("b", "terminated"), ("c", "lost")]


def test_emitted_bytes_are_equal_for_equal_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "id int, name string, x double")
    for i, d in enumerate((df, df.repartition(3))):
        state.emit(d.coalesce(1), f"file://{tmp_path}/{i}", ["id"])
    one, two = (sorted(b"".join(p.read_bytes() for p in sorted((tmp_path / str(i)).glob("part-*"))).splitlines()) for i in (0, 1))
    assert one == two and one[0] == b'{"id":1,"name":"a","x":0.5}'


def test_session_events_and_rebuild(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"event_id":"e1","event_type":"tool","ts":"2024-01-01T00:00:00Z"}\n{"other":1}\n')
    seen = []
    q = events.folded_into(events.session_events(spark, f"file://{tmp_path}/s"), lambda b, i: seen.extend(r.event_id for r in b.collect()), f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert seen == ["e1"]
    stored = {"papers": spark.createDataFrame([("p1", "old"), ("p2", "kept")], "id string, source_sha256 string"), "findings": spark.createDataFrame([("f1", "p1", "A b", True), ("f2", "p2", "x", True)], "id string, paper string, quote string, quote_verified boolean")}
    out = fold.rebuilt(stored, spark.createDataFrame([("p1", "nothing of it")], "paper string, text string"))
    assert {r.id: r.quote_verified for r in out["findings"].collect()} == {"f1": False, "f2": True}
    assert {r.id: len(r.source_sha256) for r in out["papers"].collect()} == {"p1": 64, "p2": 4}


def test_coverage_row(spark):
    f = spark.createDataFrame([("f1", 0.5, True, True), ("f2", 0.9, True, None)], "id string, confidence double, hedged boolean, quote_verified boolean")
    t = spark.createDataFrame([("t1", "gene", None), ("t2", "method", None)], "id string, kind string, uniprot_accession string")
    li = spark.createDataFrame([("t2", "t9")], "src string, dst string")
    c = spark.createDataFrame([(1, 2)], "no_quote_discarded long, duplicates_dropped long")
    r = audit.coverage(f, t, li, c).head()
    assert (r.quotes_unverified, r.proteins_without_accession_count, r.interventions_without_target_count, r.has_disease_node, r.confidence_profile.hedged_but_confident) == (1, 1, 1, False, 1)


def test_written_only_if_changed(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    put = lambda rows: state.written_if_changed(spark, lambda p: state.emit(spark.createDataFrame(rows, "id int"), p, ["id"]), path)
    assert [put([(1,), (2,)]), put([(2,), (1,)]), put([(2,)])] == [True, False, True]


def test_graph_ids_probe_the_catalog(spark):
    mine = state.minted_graph_id(spark.createDataFrame([], "graph_id string, question string"), "why?")
    taken = spark.createDataFrame([(mine, "another question")], "graph_id string, question string")
    assert mine.startswith("g_") and state.minted_graph_id(taken, "why?") != mine
    assert state.minted_graph_id(spark.createDataFrame([(mine, "why?")], "graph_id string, question string"), "why?") == mine


def test_numbers_that_are_not_finite_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("g1", float("nan"))], "id string, confidence double")
    with pytest.raises(Exception, match="not finite"):
        state.save_state({"gaps": df}, f"file://{tmp_path}/g")
    assert not (tmp_path / "g").exists()

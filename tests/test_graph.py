import random

from pyspark.sql import functions as F

from claimloom.operators import audit, gaps, identity, links, quality, rounds, search, verify
from claimloom.sources import state

FINDING = "id string, paper string, src string, how string, dst string, says string, quote string, setting string, is_own_result boolean, hedged boolean, round int"
PAPER = "id string, doi string, pmid string, title string, year int, first_author string, study_type string, is_preprint boolean, retracted boolean, source_text string"


def finding(i, paper="p1", src="t1", dst="t2", says="yes", quote="Alpha inhibits Beta.", setting=None, own=True, hedged=False, n=1, how="inhibits"):
    return i, paper, src, how, dst, says, quote, setting, own, hedged, n


def paper(i, text=None, author="A", study="animal", preprint=None, doi=None, pmid=None, title=None, year=None, retracted=None):
    return i, doi, pmid, title, year, author, study, preprint, retracted, text


def scored(spark, findings, papers):
    return {(r.src, r.how, r.dst): r for r in links.scored_links(spark.createDataFrame(findings, FINDING), spark.createDataFrame(papers, PAPER)).collect()}


def test_a_lone_source_scores_half_agreement(spark):
    r = scored(spark, [finding("f1")], [paper("p1")])["t1", "inhibits", "t2"]
    assert (r.state, r.basis, r.agreement, r.evidence_quality, r.independence, r.label) == ("single_source", "primary", 0.5, 0.6, 0.0, "medium")


def test_two_claims_of_one_paper_agree_but_are_not_independent(spark):
    r = scored(spark, [finding("f1"), finding("f2", quote="other")], [paper("p1")])["t1", "inhibits", "t2"]
    assert (r.state, r.agreement, r.independence, r.yes) == ("agreed", 1.0, 0.0, ["f1", "f2"])


def test_independence_counts_authors_over_papers(spark):
    papers = [paper("p1", author="Smith"), paper("p2", author="smith"), paper("p3", author="Jones")]
    r = scored(spark, [finding(f"f{i}", paper=f"p{i}") for i in (1, 2, 3)], papers)["t1", "inhibits", "t2"]
    assert r.independence == 0.5


def test_background_only_groups_are_links_and_missing_papers_are_unknown(spark):
    r = scored(spark, [finding("f1", paper="p404", own=None)], [])["t1", "inhibits", "t2"]
    assert (r.state, r.basis, r.evidence_quality, r.agreement) == ("single_source", "background_only", 0.4, 0.0)


def test_disagreement_names_conditions_only_where_camps_do_not_meet(spark):
    apart = [finding("f1", setting="mouse"), finding("f2", says="no", setting="human")]
    assert scored(spark, apart, [paper("p1")])["t1", "inhibits", "t2"].why == "conditions differ: {mouse} vs {human}"
    assert scored(spark, [finding("f1", setting="mouse"), finding("f2", says="no", setting="mouse")], [paper("p1")])["t1", "inhibits", "t2"].why is None
    assert scored(spark, [finding("f1"), finding("f2", says="no", setting="x")], [paper("p1")])["t1", "inhibits", "t2"].why is None


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [finding(f"f{i}", paper=f"p{rng.randrange(9)}", dst=f"t{rng.randrange(4)}", says=rng.choice(["yes", "no", "no_effect"]), own=rng.choice([True, False, None]), hedged=rng.choice([True, False, None])) for i in range(200)]
    df, papers = spark.createDataFrame(rows, FINDING), spark.createDataFrame([paper(f"p{i}", author=f"A{i % 3}") for i in range(8)], PAPER)
    a, b = (sorted(map(str, links.scored_links(x, papers).collect())) for x in (df, df.repartition(7)))
    assert a == b


def test_gaps_of_open_triangles(spark):
    ddl = "src string, how string, dst string, overall double, basis string, papers array<string>"
    rows = [("a", "x", "b", 0.8, "primary", ["p1"]), ("b", "x", "c", 0.6, "primary", ["p2"]), ("c", "x", "d", 0.5, "mixed", []), ("a", "y", "b", 0.2, "primary", ["p1"]), ("e", "x", "e", 0.9, "primary", [])]
    got = {(r.a, r.c): r for r in gaps.ranked_gaps(spark.createDataFrame(rows, ddl)).collect()}
    assert set(got) == {("a", "c"), ("b", "d")}
    assert got["a", "c"].confidence == 0.6 and got["a", "c"].implied_by == ["a|x|b", "b|x|c"]
    assert abs(got["b", "d"].confidence - 0.5 * 0.85 * 0.65) < 1e-4
    closed = [*rows, ("c", "z", "a", 0.1, "primary", [])]
    assert ("a", "c") not in {(r.a, r.c) for r in gaps.ranked_gaps(spark.createDataFrame(closed, ddl)).collect()}


def test_gap_degree_cap_bounds_a_hub(spark):
    ddl = "src string, how string, dst string, overall double, basis string, papers array<string>"
    rows = [("hub", "x", f"n{i:03d}", 0.5, "primary", []) for i in range(60)]
    w = gaps.wedges(gaps.undirected_edges(spark.createDataFrame(rows, ddl)))
    assert w.count() == 24 * 23 // 2 and w.agg(F.max("c")).head()[0] == "n023"


def test_quotes_new_claims_are_discarded_and_stored_ones_marked(spark):
    ddl = FINDING + ", is_new boolean, quote_verified boolean"
    rows = [(*finding("f1"), True, True), (*finding("f2", quote="not there"), True, True), (*finding("f3", quote="not there"), False, True), (*finding("f4", paper="p2"), True, True), (*finding("f5", paper="p2"), False, True), (*finding("f6", paper="p404"), False, False)]
    papers = [paper("p1", text="We say: Alpha   inhibits\nBeta. Indeed."), paper("p2", text="  ")]
    out = {r.id: (r.quote_verified, r.discarded) for r in verify.verified(spark.createDataFrame(rows, ddl), spark.createDataFrame(papers, PAPER)).collect()}
    assert out == {"f1": (True, False), "f2": (False, True), "f3": (False, False), "f4": (None, False), "f5": (True, False), "f6": (False, False)}


def test_reverification_discards_nothing(spark):
    rows = [(*finding("f1"), None), (*finding("f2", paper="p2"), True)]
    texts = spark.createDataFrame([("p1", "an excerpt")], "paper string, text string")
    out = {r.id: r.quote_verified for r in verify.reverified(spark.createDataFrame(rows, FINDING + ", quote_verified boolean"), texts).collect()}
    assert out == {"f1": False, "f2": True}


def test_containment_join_against_every_pair(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "(gamma", "delta)", "e-f", "α", "7"]
    texts = [(i, " ".join(rng.choices(words, k=40))) for i in range(30)]
    quotes = [(i, t[rng.randrange(60) :][: rng.randrange(5, 90)]) for i, (_, t) in enumerate(texts)] + [(90, ""), (91, "nowhere at all in these texts to be found"), (92, None)]
    q, t = spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(texts, "text_id long, text string")
    from claimloom.functions import text

    want = {tuple(r) for r in q.crossJoin(t).where(text.quote_found(F.col("quote"), F.col("text"))).select("quote_id", "text_id").collect()}
    got = [tuple(r) for r in verify.quotes_in_texts(q, t).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_a_round_sent_again_adds_nothing(spark):
    df = spark.createDataFrame([finding("f1"), finding("f2", quote="Second.")], FINDING)
    both = rounds.staged(df.withColumn("quote_verified", F.lit(True)), df)
    kept = rounds.deduplicated(both, ["id"])
    assert sorted((r.id, r.is_new) for r in kept.collect()) == [("f1", False), ("f2", False)]
    assert both.where("is_new and quote_verified is not null").count() == 0


def test_content_differs_by_quote_after_folding(spark):
    df = spark.createDataFrame([finding("f1", quote="“A”  b"), finding("f2", quote='"a" B'), finding("f3", quote="a c")], FINDING).withColumn("is_new", F.lit(True))
    assert sorted(r.id for r in rounds.deduplicated(df, ["id"]).collect()) == ["f1", "f3"]


def test_colliding_ids_are_renamed_around_literal_ones(spark):
    df = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3), ("f_1", 4), ("g", 5)], "id string, pos int")
    assert [r.id for r in rounds.renamed(df, ["pos"]).orderBy("pos").collect()] == ["f", "f_2", "f_3", "f_1", "g"]


def test_minted_ids_stay_and_never_come_back(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    prior = spark.createDataFrame([("b", "L2"), ("z", "L5"), ("b", "L10")], "k string, id string")
    out = {r.k: r.id for r in rounds.minted(keys, prior, ["k"], ["k"], "L", floor=11).collect()}
    assert out == {"b": "L2", "a": "L12", "c": "L13"}


def test_dense_numbers_over_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert all(r.number == r.x + 1 for r in rounds.dense_numbers(df.repartition(5), ["x"]).collect())


def test_changes_outcome_and_delta(spark):
    ddl = "id string, state string, overall double, yes array<string>, no array<string>, no_effect array<string>, changed_in_round int"
    was = spark.createDataFrame([("L1", "single_source", 0.4, ["f1"], [], [], 1), ("L2", "agreed", 0.8, ["f2", "f3"], [], [], 1), ("L9", "agreed", 0.8, [], [], [], 1)], ddl)
    now = spark.createDataFrame([("L1", "agreed", 0.7, ["f1", "f4"], [], [], None), ("L2", "agreed", 0.8, ["f2", "f3"], [], [], None), ("L3", "single_source", 0.4, ["f5"], [], [], None)], ddl)
    marked = rounds.marked_changes(now, was, 2)
    assert {r.id: r.changed_in_round for r in marked.collect()} == {"L1": 2, "L2": 1, "L3": 2}
    outcome = lambda a, b: rounds.round_outcome(a, b).head()[0]
    assert outcome(now, was) == "promoted" and outcome(now, was.limit(0)) == "new_evidence" and outcome(was, was) == "nothing_new"
    assert outcome(now.withColumn("state", F.when(F.col("id") == "L2", "disagreed").otherwise(F.col("state"))), was) == "contradicted"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = rounds.delta({"links": marked, "things": ids("t1", "t2"), "papers": ids("p1"), "gaps": ids("g2")}, {"links": was, "things": ids("t1"), "papers": ids("p1"), "gaps": ids("g1", "g2")}, 2)
    assert sorted(map(tuple, got.collect())) == [("gaps_resolved", "g1"), ("links_added", "L3"), ("links_changed", "L1"), ("things_added", "t2")]


def test_papers_merge_by_key_and_fill_blanks_in_order(spark):
    rows = [paper("p1", doi="10.1/A", author="", preprint=False), paper("p2", doi="https://doi.org/10.1/a", author="Late", preprint=True), paper("p3", pmid="5"), paper("p4", author=None), paper("p5", author="X")]
    out = {r.key: r for r in identity.merged_papers(spark.createDataFrame(rows, PAPER), ["id"], ["first_author", "is_preprint"]).collect()}
    assert (out["doi:10.1/a"].id, out["doi:10.1/a"].first_author, out["doi:10.1/a"].is_preprint, out["doi:10.1/a"].n_merged) == ("p1", "Late", True, 2)
    assert out["ty:|"].n_merged == 2 and out["ty:|"].first_author == "X"


def test_entities_match_by_accession_then_name_unless_accessions_differ(spark):
    ddl = "id string, name string, aliases array<string>, uniprot_accession string, ambiguity array<string>"
    stored = spark.createDataFrame([("t1", "Alpha-1", ["AKT"], "P1", None), ("t2", "Beta", [], None, None), ("t3", "Gamma", None, "P3", ["two readings"])], ddl)
    new = spark.createDataFrame([("a", "alpha 1", [], "P9", None), ("b", "other", [], " p1 ", None), ("c", "x", ["betas"], None, None), ("d", "Akt", None, None, None), ("e", "new", [], "P3", None)], ddl)
    out = {r.local_id: (r.stored_id, r.via) for r in identity.matched_entities(new, stored).collect()}
    assert out == {"a": (None, None), "b": ("t1", "accession"), "c": ("t2", "name"), "d": ("t1", "name"), "e": (None, None)}


def test_sequential_resolution_lets_later_rows_meet_new_ones(spark):
    rows = [("g", 1, "a", "Foo", ["bar"], None), ("g", 2, "b", "BAR", ["baz"], None), ("g", 3, "c", "baz", [], "P1"), ("g", 4, "d", "foo", [], "P2"), ("g", 5, "e", "zzz", [], "p1"), ("h", 1, "f", "Foo", None, None)]
    df = spark.createDataFrame(rows, "graph_id string, ord int, id string, name string, aliases array<string>, uniprot_accession string")
    got = identity.resolve(df, df.limit(0), "graph_id").collect()
    assert {r.id: r.entity_id for r in got} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "a", "f": "f"}
    made = {r.id: r.made for r in got}
    assert (made["a"].aliases, made["a"].mentions, made["a"].uniprot_accession) == (["bar", "baz", "zzz"], 4, "P1") and made["f"] is None
    assert [(m.name, m.via) for m in made["a"].merged_from] == [("BAR", "name"), ("baz", "name"), ("zzz", "accession")]


def test_accession_keeps_the_lowest_number_and_sums_mentions(spark):
    ddl = "id string, name string, kind string, aliases array<string>, mentions int, uniprot_accession string, ambiguity array<string>"
    things = spark.createDataFrame([("t10", "B", "gene", ["y"], 2, "P1", None), ("t2", "A", "gene", ["x"], None, "p1", None), ("t3", "C", "gene", [], 1, "P1", ["q"])], ddl)
    mapping = identity.coalesced_by_accession(things)
    assert {r.id: r.kept_id for r in mapping.collect()} == {"t10": "t2", "t2": "t2", "t3": "t3"}
    (r,) = [r for r in identity.resolve(things.limit(0).withColumn("ord", F.lit(1)), things).collect() if r.id == "t2"]
    # mentions that were never counted are none
    assert (r.made.mentions, r.made.aliases, [tuple(m) for m in r.made.merged_from]) == (2, ["B", "x", "y"], [("B", "accession")])


def test_dangling_references_are_reported(spark):
    f = spark.createDataFrame([finding("f1", paper="p404", dst="t404")], FINDING)
    li = spark.createDataFrame([("t1", "t2", ["f1"], ["f9"], [])], "src string, dst string, yes array<string>, no array<string>, no_effect array<string>")
    g = spark.createDataFrame([("t1", "t7")], "a string, c string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = sorted(map(tuple, quality.dangling_references(f, li, g, ids("t1", "t2"), ids("p1")).collect()))
    assert got == [("findings.dst", "t404"), ("findings.paper", "p404"), ("gaps.c", "t7"), ("links.no", "f9")]


def test_checks_on_kinds(spark):
    things = spark.createDataFrame([("t1", "small_molecule", None), ("t2", "protein", " "), ("t3", "method", None), ("t4", "gene", "P1")], "id string, kind string, uniprot_accession string")
    li = spark.createDataFrame([("t2", "t1"), ("t3", "t1")], "src string, dst string")
    assert [r.id for r in quality.interventions_without_target(li, things).collect()] == ["t3"]
    assert [r.id for r in quality.without_accession(things).collect()] == ["t2"]
    assert quality.has_kind(things).head()[0] is False and quality.has_kind(things.limit(0)).head()[0] is False


def test_grades(spark):
    ddl = "s string, p boolean, r boolean, v boolean"
    rows = [("clinical_trial", False, False, True), ("clinical_trial", True, None, True), ("clinical_trial", None, True, True), ("clinical_trial", None, None, None), ("other", None, None, True), ("animal", None, None, True)]
    got = [x[0] for x in spark.createDataFrame(rows, ddl).select(audit.graded(*map(F.col, "sprv"))).collect()]
    assert got == ["HIGH", "LOW", "UNSUPPORTED", "LOW", "UNSUPPORTED", "MODERATE"]


def test_requests_take_defaults_and_note_them(spark):
    df = spark.createDataFrame([('{"target": "x", "depth": "weird"}',), ("plain words",), ('{"ask": "test_gap", "target": "g1", "depth": "deep", "years": "2010"}',)], "task string")
    a, b, c = search.requests(df).collect()
    assert (a.ask, a.target, a.depth) == ("new_question", "x", "standard") and (b.target, len(b.defaults_applied)) == ("plain words", 3)
    assert (c.ask, c.depth, c.defaults_applied) == ("test_gap", "deep", [])


def test_state_round_trip_hash_catalog_and_abstention(spark, tmp_path):
    f = spark.createDataFrame([finding("f1"), finding("f2", n=2)], FINDING)
    path = f"file://{tmp_path}/g"
    state.save_state({"findings": f}, path)
    state.save_state({"findings": f.where("id = 'f2'")}, path)
    loaded = state.load_state(spark, path)
    assert [r.id for r in loaded["findings"].collect()] == ["f2"] and loaded["things"].count() == 0
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "p1.txt").write_text("some text\nof two lines")
    (tmp_path / "texts" / "p2.txt").write_text("  ")
    assert [tuple(r) for r in state.read_texts(spark, f"file://{tmp_path}/texts").collect()] == [("p1", "some text\nof two lines")]
    cat = spark.createDataFrame([("g1", "q", 1)], "graph_id string, question string, round int")
    new = spark.createDataFrame([("g1", None, 2), ("g2", "r", 1)], cat.schema)
    assert sorted(map(tuple, state.upserted_catalog(cat, new).collect())) == [("g1", "q", 2), ("g2", "r", 1)]
    gone = state.abstention(spark, "g9", "not found")
    assert gone["links"].count() == 0 and gone["meta"].head().status == "failed"


def test_strict_json(spark, tmp_path):
    import pytest

    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('{"id": "f1", "confidence": 0.5}')
    bad.write_text('{"id": "f1", "confidence": NaN}')
    assert state.read_json(spark, f"file://{good}", "id string, confidence double").head().confidence == 0.5
    with pytest.raises(Exception):  # noqa: B017
        state.read_json(spark, f"file://{bad}", "id string, confidence double").collect()

"""Fixed values that results depend on, and the table schemas (as DDL)."""

from __future__ import annotations

# Quality of a study by its type, in hundredths. Anything else counts as unknown.
STUDY_QUALITY = {
    "meta_analysis": 100,
    "clinical_trial": 90,
    "human_cohort": 80,
    "animal": 60,
    "test_tube": 50,
    "computational": 40,
    "review": 30,
    "unknown": 40,
}
UNKNOWN_QUALITY = 40
# A preprint's share of that quality, in hundredths.
PREPRINT_SHARE = 80
# Weight of a link's basis in gap scores.
BASIS_WEIGHT = {"primary": 1.0, "mixed": 0.85, "hedged_only": 0.6, "background_only": 0.35}
OTHER_BASIS_WEIGHT = 0.6
# Grade by study type.
STUDY_GRADE = {
    "meta_analysis": "HIGH",
    "clinical_trial": "HIGH",
    "human_cohort": "MODERATE",
    "animal": "MODERATE",
    "test_tube": "LOW",
    "computational": "LOW",
    "review": "LOW",
    "unknown": "UNSUPPORTED",
}
GRADES = ["UNSUPPORTED", "LOW", "MODERATE", "HIGH"]
# Greek letters that names spell out.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "κ": "kappa", "λ": "lambda", "μ": "mu", "σ": "sigma", "ω": "omega"}
# Papers and queries allowed at each depth.
TIERS = {"quick": (10, 2), "standard": (25, 4), "deep": (50, 6), "exhaustive": (300, 12)}
# Fixed values of gap ranking.
GAP_CAP, GAP_CEILING, DEGREE_CAP, ROUTE_BONUS, SHARED_PAPER = 50, 0.6, 24, 0.12, 0.65
# Kinds of entities that act, and those acted on.
INTERVENTION_KINDS = ["small_molecule", "method"]
TARGET_KINDS = ["protein", "gene"]
# Verbs that state a relationship.
RELATIONS = ["inhibits", "activates", "binds", "suppresses", "increases", "decreases", "causes", "drives", "treats", "associated_with"]

THINGS = "id string, name string, kind string, aliases array<string>, mentions int, uniprot_accession string, gene_symbol string, resolved_by string, ambiguity array<string>, merged_from array<struct<name:string,via:string>>, round int"
PAPERS = "id string, doi string, pmid string, title string, year int, journal string, first_author string, study_type string, is_preprint boolean, retracted boolean, round int, source_sha256 string, source_text string"
FINDINGS = "id string, paper string, src string, how string, dst string, says string, quote string, quote_verified boolean, section string, setting string, is_own_result boolean, hedged boolean, confidence double, flags array<string>, round int"
LINKS = "id string, src string, how string, dst string, state string, basis string, overall double, label string, agreement double, evidence_quality double, independence double, yes array<string>, no array<string>, no_effect array<string>, why string, changed_in_round int"
META = "schema_version string, graph_id string, question string, round int, status string, generated_at string, error string, found int, read int, used int, figures_read int, truncated boolean, stop_reason string, depth string, years string, max_papers int, max_queries int, queries array<struct<q:string,tool:string,search_id:string,n_results:int>>, defaults_applied array<string>, no_quote_discarded long, duplicates_dropped long, quotes_unverified long, link_seq long, gap_seq long, proteins_without_accession_count long, interventions_without_target_count long, has_disease_node boolean"
ROUNDS = "n int, ask string, target string, depth string, papers_added long, outcome string"
GAPS = "id string, a string, c string, via string, implied_by array<string>, note string, confidence double, searched_in_round int"

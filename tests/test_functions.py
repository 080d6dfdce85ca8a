import pytest
from pyspark.sql import functions as F

from claimloom.functions import scoring, text


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("https://doi.org/10.1/AbC/", "10.1/abc"), ("http://dx.doi.org/10.1/x", "10.1/x"), ("DOI.org/10.1/x", "10.1/x"), (" 10.1/X ", "10.1/x"), (None, ""), ("", "")],
)
def test_doi(spark, raw, want):
    assert values(spark, [(raw,)], "c string", text.normalize_doi(F.col("c"))) == [want]


@pytest.mark.parametrize(
    ("raw", "want", "compact", "symbol"),
    [
        ("Kinases", "kinase", "kinases", False),
        ("glass", "glass", "glass", False),
        ("GAS", "gas", "gas", True),
        ("p53s", "p53s", "p53s", True),
        ("TGF-β1", "tgf beta1", "tgfbeta1", True),
        ("  Foo   (bar) ", "foo bar", "foobar", False),
        ("was", "was", "was", False),
        ("123", "123", "123", False),
        (None, "", "", False),
    ],
)
def test_names(spark, raw, want, compact, symbol):
    c = F.col("c")
    row = spark.createDataFrame([(raw,)], "c string").select(text.normalize_name(c), text.compact_name(c), text.is_symbol(c)).head()
    assert tuple(row) == (want, compact, symbol)


@pytest.mark.parametrize(
    ("quote", "source", "want"),
    [
        ("Alpha inhibits Beta in cultured cells.", "Alpha   inhibits\nBeta in cultured cells.", True),
        ("Alpha blocks Beta.", "Alpha inhibits Beta.", False),
        ("shown (Figure 5F).", "Shown ( figure 5f ) .", True),
        ("NAC 124 31", "NAC 12431", False),
        ("NAC 124 31", "NAC12431", False),
        ("First one. Third one.", "First one. Second one. Third one.", False),
        ("“α V β 3” – it’s", '"αVβ3"-it\'s', True),
        ("", "anything", False),
        (None, "anything", False),
        ("a b", "A b", True),
    ],
)
def test_quotes(spark, quote, source, want):
    assert values(spark, [(quote, source)], "q string, t string", text.quote_found(F.col("q"), F.col("t"))) == [want]


def test_source_key_takes_the_strongest_identifier(spark):
    rows = [("10.1/A", "7", "T", 2000), (None, "7", "T", 2000), (None, "", "The Studies", 2000), (None, None, None, None)]
    c = text.source_key(*map(F.col, ("doi", "pmid", "title", "year")))
    assert values(spark, rows, "doi string, pmid string, title string, year int", c) == ["doi:10.1/a", "pmid:7", "ty:the studie|2000", "ty:|"]


def test_nfkc(spark):
    assert values(spark, [("ﬁn",), (None,)], "c string", text.nfkc(F.col("c"))) == ["fin", None]


def test_display_functions(spark):
    c = F.col("c")
    one = lambda v, col: values(spark, [(v,)], "c string", col)[0]
    assert one("<b>x</b>  y" + "z" * 500, text.plain(c)).endswith("…") and one("<b>x</b>  y", text.plain(c)) == "x y"
    assert one("a b/c", text.slug(c)) == "a_b_c" and one("//", text.slug(c)) == "unnamed"
    assert one("this may work", text.hedged(c)) and not one("maybe not", text.hedged(c))
    assert one("as shown [3, 4]", text.cites_others(c)) and not one("we show", text.cites_others(c))
    assert one("it binds A but not B, whereas C stayed", text.clauses(c)) == ["it binds A", "but not B", "whereas C stayed"]
    assert one("L12: x", text.line_number(c)) == 12 and one("x", text.line_number(c)) is None
    assert one("2. Introduction", text.section_of(c)) == "discussion" and one("x", text.section_of(c)) is None and one("Table 2: doses", text.section_of(c)) == "figure_caption"
    assert one("a\x00\n b", text.title_snippet(c)) == "a b"


@pytest.mark.parametrize(("y", "n", "want"), [(0, 0, 0), (1, 0, 5000), (0, 1, 5000), (2, 0, 10000), (0, 2, 0), (2, 1, 6667), (1, 1, 5000)])
def test_agreement(spark, y, n, want):
    assert values(spark, [(y, n)], "y long, n long", scoring.agreement_points(F.col("y"), F.col("n"))) == [want]


@pytest.mark.parametrize(("counts", "want"), [((0, 0, 1), "no_effect"), ((1, 1, 0), "disagreed"), ((1, 0, 3), "single_source"), ((2, 0, 0), "agreed"), ((0, 2, 0), "agreed"), ((0, 0, 0), "single_source")])
def test_states(spark, counts, want):
    assert values(spark, [counts], "y long, n long, e long", scoring.state(F.col("y"), F.col("n"), F.col("e"))) == [want]


@pytest.mark.parametrize(("own", "hedged", "want"), [(0, 0, "background_only"), (2, 2, "hedged_only"), (2, 1, "mixed"), (2, 0, "primary")])
def test_bases(spark, own, hedged, want):
    assert values(spark, [(own, hedged)], "o long, h long", scoring.basis(F.col("o"), F.col("h"))) == [want]


def test_quality_of_sources(spark):
    rows = [("clinical_trial", True), ("clinical_trial", None), ("something_new", False), (None, None)]
    assert values(spark, rows, "s string, p boolean", scoring.study_points(F.col("s"), F.col("p"))) == [7200, 9000, 4000, 4000]

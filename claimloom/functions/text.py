"""Text functions as Column expressions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.vocabulary import GREEK

#: White space as names and quotes mean it, and characters that quotes have in several forms.
SPACE = r"(?U)[\s\x1c-\x1f]+"
TYPOGRAPHIC, ASCII_FORMS = "‘’“”–—−\u00a0\u2009\u200a\u202f", "''\"\"---    "
#: Prefixes of DOIs and the addresses that resolve identifiers.
DOI_PREFIX = r"(?i)^(https?://)?(dx\.)?doi\.org/"
DOI_ADDRESS, PMID_ADDRESS = "https://doi.org/", "https://pubmed.ncbi.nlm.nih.gov/"
#: Fixed value: white space that touches anything but an ASCII letter or digit.
LOOSE_SPACE = r"(?<=[^0-9A-Za-z])\s+|\s+(?=[^0-9A-Za-z])"


def _or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def nfkc(c: Column) -> Column:
    """Compatibility composition, by the Unicode library that Spark ships. ASCII texts pass as they are."""
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def spelled_greek(c: Column) -> Column:
    for letter, name in GREEK.items():
        c = F.replace(c, F.lit(letter), F.lit(name))
    return c


def normalize_doi(c: Column) -> Column:
    """A DOI without resolver prefix and outer slashes, lower-cased; null is ''."""
    bare = F.regexp_replace(F.trim(_or_blank(c)), DOI_PREFIX, "")
    return F.lower(F.regexp_replace(F.trim(bare), r"^/+|/+$", ""))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def is_symbol(raw: Column) -> Column:
    """Whether a name looks like a symbol: it has letters, all upper-case, or a letter and a digit."""
    raw = _or_blank(raw)
    return raw.rlike(r"\p{L}") & (~raw.rlike(r"[\p{L}&&[^\p{Lu}]]") | raw.rlike(r"\p{Nd}"))


def normalize_name(c: Column) -> Column:
    """Lower-cased words of a name without punctuation, and without the plural s unless it is a symbol."""
    words = collapsed(F.regexp_replace(F.lower(spelled_greek(nfkc(_or_blank(c)))), r"[^\p{L}\p{N}_\s]", " "))
    plural = lambda w: (F.char_length(w) > 3) & w.endswith("s") & ~w.endswith("ss") & ~is_symbol(c)
    # bound as a lambda's variable, so that the words are made once
    return F.transform(F.array(words), lambda w: F.when(plural(w), F.substr(w, F.lit(1), F.char_length(w) - 1)).otherwise(w))[0]


def compact_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(spelled_greek(nfkc(_or_blank(c)))), r"[^\p{L}\p{N}]", "")


def folded(c: Column) -> Column:
    """NFKC, quotes, dashes and spaces in one form each, white space collapsed, lower-cased."""
    return F.lower(collapsed(F.translate(nfkc(_or_blank(c)), TYPOGRAPHIC, ASCII_FORMS)))


def despaced(c: Column) -> Column:
    """White space goes where it touches anything but an ASCII letter or digit."""
    return F.regexp_replace(c, LOOSE_SPACE, "")


def quote_form(c: Column) -> Column:
    return despaced(folded(c))


def quote_found(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text, both in quote form; an empty quote does not."""
    q = quote_form(quote)
    return F.coalesce((q != "") & F.contains(quote_form(text), q), F.lit(False))


def plain(c: Column, limit: int = 400) -> Column:
    """Each tag a space, white space collapsed, cut to `limit` code points with an ellipsis."""
    bare = collapsed(F.regexp_replace(_or_blank(c), r"<[^>]*>", " "))
    return F.when(F.char_length(bare) > limit, F.concat(F.substring(bare, 1, limit - 1), F.lit("…"))).otherwise(bare)


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def slug(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_or_blank(c), r"[^A-Za-z0-9_.:-]+", "_"), r"^[_.:-]+|[_.:-]+$", "")
    return F.when(bare == "", "unnamed").otherwise(bare)


def source_key(doi: Column, pmid: Column, title: Column, year: Column) -> Column:
    """The strongest identifier a source has."""
    d, p = normalize_doi(doi), F.trim(_or_blank(pmid))
    by_title = F.concat(F.lit("ty:"), normalize_name(title), F.lit("|"), _or_blank(year.cast("string")))
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(p != "", F.concat(F.lit("pmid:"), p)).otherwise(by_title)


def accession(acc: Column, ambiguity: Column | None = None) -> Column:
    bare = F.upper(F.trim(_or_blank(acc)))
    return bare if ambiguity is None else F.when(F.size(F.coalesce(ambiguity, F.array())) > 0, "").otherwise(bare)


def source_id(doi: Column, pmid: Column) -> Column:
    """A source's durable identifier; null without one."""
    d, p = normalize_doi(doi), F.trim(_or_blank(pmid))
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(p != "", F.concat(F.lit("pmid:"), p))


def source_reference(doi: Column, pmid: Column) -> Column:
    """The address that resolves `source_id`."""
    d, p = normalize_doi(doi), F.trim(_or_blank(pmid))
    return F.when(d != "", F.concat(F.lit(DOI_ADDRESS), d)).when(p != "", F.concat(F.lit(PMID_ADDRESS), p, F.lit("/")))


def source_type(is_preprint: Column) -> Column:
    return F.when(is_preprint, "preprint").when(~is_preprint, "publication").otherwise("publication_status_unrecorded")


def claim(src: Column, how: Column, dst: Column, says: Column, setting: Column | None = None) -> Column:
    """A sentence for a claim by what it says, with the condition it holds under."""
    verb = F.coalesce(F.nullif(how, F.lit("")), F.lit("relates to"))
    told = F.when(says == "no", F.concat(F.lit(" does not "), verb)).when(says == "no_effect", F.lit(" has no effect on")).otherwise(F.concat(F.lit(" "), verb))
    under = F.lit("") if setting is None else F.when(_or_blank(setting) != "", F.concat(F.lit(" ("), setting, F.lit(")"))).otherwise("")
    return F.concat(src, told, F.lit(" "), dst, under)


def link_label(src: Column, how: Column, dst: Column) -> Column:
    return F.concat(src, F.lit(" --"), how, F.lit("--> "), dst)


def graph_id(question: Column, tries: int = 0) -> Column:
    """A short id for a question; `tries` probes for another one after a collision."""
    seed = F.concat(F.lit("q:"), question, F.lit(f":{tries}" if tries else ""))
    return F.concat(F.lit("g_"), F.substring(F.sha2(seed, 256), 1, 4))


# Words that qualify a claim, marks and verbs that report others' results, words that part contrasts.
HEDGES = ["may", "might", "could", "suggests", "appears to", "is thought to", "potentially", "we hypothesize", "likely", "consistent with", "implicates", "is associated with a possible"]
REPORTS = ["has been shown", "is known to", "it is established that", "previous work demonstrated"]
CONTRASTS = ["but not", "whereas", "while no effect was observed", "in contrast"]
# The section that each heading stands for, and the heading that stands for two.
SECTIONS = {"abstract": "abstract", "results": "results", "results and discussion": "results", "methods": "methods", "materials and methods": "methods", "experimental": "methods", "discussion": "discussion", "introduction": "discussion", "background": "discussion", "conclusion": "discussion"}
AMBIGUOUS_SECTION = "results and discussion"


def _any_of(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def hedged(c: Column) -> Column:
    return c.rlike(_any_of(HEDGES))


def cites_others(c: Column) -> Column:
    """Whether a sentence carries a citation mark or a reporting verb, so that its claim is not the paper's own."""
    mark = r"\[\d+(?:[,–-]\s*\d+)*\]|\(\s*[A-Z]\p{L}+(?: et al\.)?,? \d{4}\s*\)|[A-Z]\p{L}+ and [A-Z]\p{L}+ showed"
    return c.rlike(mark) | c.rlike(_any_of(REPORTS))


def contrasts(c: Column) -> Column:
    return c.rlike(_any_of(CONTRASTS))


def clauses(c: Column) -> Column:
    """A sentence cut before each contrasting phrase."""
    return F.filter(F.transform(F.split(c, r"(?i)[,;]?\s+(?=(?:" + "|".join(CONTRASTS) + r")\b)"), F.trim), lambda x: x != "")


def _heading(c: Column) -> Column:
    """A heading in small letters, without its number."""
    return F.lower(F.trim(F.regexp_replace(_or_blank(c), r"^\s*\d+(\.\d+)*\.?\s+", "")))


def section_of(heading: Column) -> Column:
    """The section a heading stands for; a line that begins with a figure's or a table's number is a caption; else null."""
    h = _heading(heading)
    out = F.when(h.rlike(r"^(figure|table) \d"), "figure_caption")
    for name, section in SECTIONS.items():
        out = out.when(h == name, section)
    return out


def section_flags(heading: Column) -> Column:
    return F.when(_heading(heading) == AMBIGUOUS_SECTION, F.array(F.lit("section_ambiguous"))).otherwise(F.array().cast("array<string>"))


def score_text(c: Column) -> Column:
    """A score of four places as it is spoken of: 0.5, 0.4426, 1.0."""
    return F.regexp_replace(c.cast("decimal(14,4)").cast("string"), "0{1,3}$", "")


def line_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^L(\d+):", 1).try_cast("int")


def title_snippet(c: Column, n: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(_or_blank(c), r"[\p{Cc}\p{Cf}]+", " "), " +", " ")), 1, n)


def years_floor(year: Column, floor: int | None) -> Column:
    return F.lit(True) if floor is None else year >= floor

"""Personal data by weak supervision.

Patterns propose candidate spans. Four labelers, a pattern's strict form, a gazetteer, the words
before the span, and its borders, vote yes, no or nothing on each. Expectation-maximisation over
the counts of all vote patterns (81 at most for each kind, whatever the input) estimates how
reliable each labeler is for each kind, and the resulting beliefs train one logistic span
classifier. Spans of the base kinds that pass their own test always stay; spans of the added kinds
(ssn, iban, name) stay if the classifier says so.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import fields, map_rows, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "name")
LABELERS = ("shape", "gazetteer", "context", "border")
#: The belief from which an added span stays.
ACCEPT = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive and anchored at the run's start: the same matches as without, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SURNAME = re.compile(r"\x20[A-Z][\w'-]+(?:\x20[A-Z][\w'-]+)?")

#: Common given names, titles and what tends to stand before personal data.
GIVEN = "Alexander Alice Andrea Anna Antonio Barbara Carlos Carmen Catherine Charles Christian Christine Claudia Daniel David Elena Elizabeth Emma Eva Fernando Francisco George Hans Helen Isabel Jacques James Jean Jennifer Jessica John Jorge Joseph Juan Julia Karen Karl Klaus Laura Linda Louis Lucia Luis Manuel Margaret Maria Marie Mark Martin Mary Michael Michel Nicole Olivia Patricia Paul Pedro Peter Philippe Pierre Robert Sandra Sarah Sofia Stefan Susan Susanne Thomas Ursula Victor William Wolfgang".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
TOP_DOMAINS = frozenset("com org net edu gov info io co uk de fr es it eu us ca au jp cn ru br in ch nl at be".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split())
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split())
BEFORE = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "master", "pay", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "name": ("name", "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "señor", "señora", "author", "by", "dear"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


@lru_cache(maxsize=1)
def _names():
    import ahocorasick

    a = ahocorasick.Automaton()
    for n in (*GIVEN, *TITLES):
        a.add_word(n, len(n))
    a.make_automaton()
    return a


def matches(text: str):
    """(kind, start, end, whether it passes its kind's own test): leftmost, not overlapping in each kind."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end, True
        at = text.find("@", max(end, at + 1))
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _only_digits(m[0])
            if len(digits) >= 12:
                yield "card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 8 <= len(_only_digits(m[0])) <= 15
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end(), False
    for m in _IBAN.finditer(text):
        yield "iban", m.start(), m.end(), False
    end = 0
    for last, n in _names().iter(text):
        at = last + 1 - n
        if at >= end and not (at and text[at - 1].isalnum()):
            skip = last + 1 + (text[last + 1 : last + 2] == ".")
            if m := _SURNAME.match(text, skip):
                end = m.end()
                yield "name", at, end, False


def _shape(kind: str, s: str) -> int:
    if kind == "email":
        return 1 if re.fullmatch(r"[A-Za-z0-9][\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}", s) and ".." not in s else -1
    if kind == "ip":
        return 1 if all(p == "0" or not p.startswith("0") and len(p) <= 3 and int(p) <= 255 for p in s.split(".")) else -1
    if kind == "card":
        return 1 if 16 <= len(d := _only_digits(s)) <= 19 and luhn(d) else -1
    if kind == "phone":
        return 1 if 8 <= len(_only_digits(s)) <= 15 and s.count("(") == s.count(")") else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind == "iban":
        flat = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    return 1 if s.count(" ") <= 2 else 0


def _known(kind: str, s: str) -> int:
    if kind == "email":
        return 1 if s.rsplit(".", 1)[-1].lower() in TOP_DOMAINS else 0
    if kind == "ip":
        return -1 if s.startswith(("0.", "255.")) else 1 if s.startswith(("10.", "192.168.", "172.")) else 0
    if kind == "card":
        return 1 if s[0] in "3456" else -1
    if kind == "phone":
        d = _only_digits(s)
        return 1 if any(d[:n] in COUNTRY_CODES for n in (1, 2, 3)) else -1
    if kind == "iban":
        return 1 if s[:2] in IBAN_COUNTRIES else -1
    if kind == "name":
        return 1 if any(w.rstrip(".") in GIVEN for w in s.split()) else 0
    return 0


def _context(kind: str, text: str, start: int) -> int:
    words = re.findall(r"\w+", text[max(0, start - 30) : start].lower())[-3:]
    if kind == "name":
        own = re.match(r"\w+", text[start : start + 12])
        words.append(own[0].lower() if own else "")
    return 1 if any(w.startswith(b) if kind != "name" else w == b for w in words for b in BEFORE[kind]) else 0


def _border(text: str, start: int, end: int) -> int:
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    if before.isalnum() or after.isalnum():
        return -1
    return 1 if (not before or before in " \t\n(<\"'[:=,;") and (not after or after in " \t\n)>\"'],;.!?") else 0


def candidates(text: str) -> list[dict]:
    """Every match, with the votes on it as base-3 digits of `code`."""
    out = []
    for kind, start, end, passes in matches(text):
        s = text[start:end]
        votes = _shape(kind, s), _known(kind, s), _context(kind, text, start), _border(text, start, end)
        out.append({"kind": kind, "start": start, "end": end, "base": passes and kind in BASE, "code": sum((v + 1) * 3**i for i, v in enumerate(votes))})
    return out


def _votes(code: int) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(len(LABELERS))]


def reliabilities(counts: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation-maximisation for one kind from counts of vote patterns.

    Returns the share of true spans, P(vote | class) for each labeler as [labeler, class, vote + 1],
    and the belief in each pattern. Counts are smoothed, and beliefs start from the votes' sum.
    """
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], np.float64)
    votes = np.array([_votes(c) for c in codes])
    belief = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    for _ in range(rounds):
        share = (n @ belief + 1) / (n.sum() + 2)
        table = np.zeros((votes.shape[1], 2, 3))
        for k, w in enumerate((n * (1 - belief), n * belief)):
            for j in range(votes.shape[1]):
                table[j, k] = np.bincount(votes[:, j] + 1, weights=w, minlength=3) + 1
        # a labeler is taken to be no worse than chance: its yes is worth more among true spans
        table += np.array([[[0.5, 0, 0], [0, 0, 0.5]]])
        table /= table.sum(axis=2, keepdims=True)
        score = np.log(share / (1 - share)) + sum(np.log(table[j, 1, votes[:, j] + 1] / table[j, 0, votes[:, j] + 1]) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done = np.abs(new - belief).max() < 1e-9
        belief = new
        if done:
            break
    return float(share), table, dict(zip(codes, belief.tolist(), strict=True))


def span_classifier(counts: dict[tuple[str, int], int]) -> dict[tuple[str, int], float]:
    """The belief of the trained classifier in every (kind, code) that occurs."""
    if not counts:
        return {}
    target = {}
    for kind in KINDS:
        own = {code: n for (k, code), n in counts.items() if k == kind}
        if own:
            target |= {(kind, code): p for code, p in reliabilities(own)[2].items()}
    rows = sorted(counts)
    x = np.zeros((len(rows), 1 + 2 * len(LABELERS) + len(KINDS)))
    x[:, 0] = 1
    for r, (kind, code) in enumerate(rows):
        for i, v in enumerate(_votes(code)):
            x[r, 1 + 2 * i], x[r, 2 + 2 * i] = v > 0, v < 0
        x[r, 1 + 2 * len(LABELERS) + KINDS.index(kind)] = 1
    y, n = np.array([target[r] for r in rows]), np.array([counts[r] for r in rows], np.float64)
    n = np.sqrt(n)  # so that one frequent pattern doesn't drown the others
    b, ridge = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return dict(zip(rows, (1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))).tolist(), strict=True))


_CANDIDATES = "array<struct<kind:string,start:int,end:int,base:boolean,code:int>>"


def _with_candidates(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """`keep` as it is, and the candidates of `text`. rows: keep (any type), text (which stays if asked)."""
    names = ["keep", "text"] if with_text else ["keep"]
    schema = T.StructType([*(rows.schema[n] for n in names), *fields(f"candidates {_CANDIDATES}").fields])

    def make():
        def step(cols):
            return {n: cols[n] for n in names} | {"candidates": [candidates(t or "") for t in cols["text"].to_pylist()]}

        return step

    return map_rows(rows.select("keep", "text"), schema, make)


def _accepted(found: DataFrame) -> Column:
    counted = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.code").count().collect()  # 81 rows a kind at most
    belief = span_classifier({(r["kind"], r["code"]): r["count"] for r in counted})
    good = [f"{k}:{c}" for (k, c), p in sorted(belief.items()) if k not in BASE and p >= ACCEPT]
    base = F.filter("candidates", lambda c: c["base"])
    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter("candidates", lambda c: F.concat_ws(":", c["kind"], c["code"]).isin(good) & free(c)) if good else F.array().cast(_CANDIDATES)
    return F.transform(F.concat(base, added), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive; by kind as in KINDS,
    then start) of every whole text. Null and empty texts have none; repeated rows give repeated
    results, an empty table none; a very long text is read once for each kind. Other columns are not
    read. Added spans don't overlap base ones."""
    rows = df.select(df[id_col].alias("keep"), df[text_col].cast("string").alias("text"))
    found = written(_with_candidates(rows), "pii")
    return found.select(F.col("keep").alias("doc_id"), _accepted(found).alias("spans"))


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df`, all columns, with each personal span of the text replaced by [KIND]; overlapping spans
    become one, named after the first. Null texts stay null and empty ones empty; repeated rows give
    repeated rows, an empty table none. Columns of any name pass unchanged."""
    others = [df[n] for n in df.columns if n != text_col] or [F.lit(True).alias("none")]
    rows = df.select(F.struct(*others).alias("keep"), df[text_col].cast("string").alias("text"))
    found = written(_with_candidates(rows, with_text=True), "pii")
    spans = F.array_sort(F.transform(_accepted(found), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def clean(text, spans):
        if not spans:
            return text
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def make():
        def step(cols):
            return {"keep": cols["keep"], "text": [clean(t, s) for t, s in zip(cols["text"].to_pylist(), cols["spans"].to_pylist(), strict=True)]}

        return step

    schema = T.StructType([found.schema["keep"], T.StructField("text", T.StringType())])
    out = map_rows(found.select("keep", "text", spans.alias("spans")), schema, make)
    return out.select(*(F.col("text").cast(df.schema[n].dataType).alias(n) if n == text_col else F.col("keep")[n].alias(n) for n in df.columns))

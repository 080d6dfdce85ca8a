import random
import re

from claimloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def base(text):
    return [(c["kind"], c["start"], c["end"]) for c in pii.candidates(text) if c["base"]]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(6)
    bits = ["a", "@", ".", "b.c", "1", "22", "300", "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "+1 (555) 010-9999", " ", "-", "(", ")", "é", "192.168.0.1", "\n", "x@y.z", "%", "001"]
    for _ in range(30_000):
        text = "".join(rng.choices(bits, k=rng.randrange(9)))
        assert base(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1(" * 100_000):
        base(text)


def test_classifier_and_redaction(spark):
    rows = [(1, "Call Dr. Maria Lopez at +1 (228) 555-1624, mail m.lopez@mail.example.com."), (2, None), (3, ""), (4, "Maria was there. IBAN DE89 3704 0044 0532 0130 00 ok"), (5, "ssn 536-22-1234 end"), (1, "Call Dr. Maria Lopez at +1 (228) 555-1624, mail m.lopez@mail.example.com.")]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, kind string, code int")
    got = sorted(((r.doc_id, [s.kind for s in r.spans]) for r in pii.find(df).collect()))
    assert got[0] == got[1] == (1, ["email", "phone", "name"]) and got[2:4] == [(2, []), (3, [])]
    assert got[4] == (4, ["iban"])
    out = sorted(pii.redacted(df).collect(), key=lambda r: (r.doc_id, r.text or ""))
    assert out[0].text == "Call [NAME] at [PHONE], mail [EMAIL]." and out[2].text is None and out[3].text == ""
    assert pii.redacted(df).columns == df.columns
    assert pii.find(df.limit(0)).count() == 0


def test_reliabilities_follow_the_labelers():
    rng = random.Random(2)
    counts = {}
    for _ in range(5000):
        true = rng.random() < 0.4
        votes = [(1 if true else -1) if rng.random() < p else rng.choice([-1, 0, 1]) for p in (0.9, 0.7, 0.6, 0.0)]
        code = sum((v + 1) * 3**i for i, v in enumerate(votes))
        counts[code] = counts.get(code, 0) + 1
    share, table, belief = pii.reliabilities(counts)
    assert abs(share - 0.4) < 0.08
    assert table[0, 1, 2] > table[3, 1, 2] and belief[max(counts)] > 0.9 > 0.1 > belief[min(counts)]

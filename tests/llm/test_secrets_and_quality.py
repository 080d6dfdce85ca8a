import random
import re
from collections import Counter

from claimloom.llm import quality, secret_scan

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    bits = ["password", "Passwd", "toKen", "secret", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc123", "a" * 12, "0f" * 12, "AKIA", "AKIA" + "B7" * 9, "İ", "K", "ſecret", "é", "\n", "x", "==", "tokentoken"]
    for _ in range(30_000):
        text = "".join(rng.choices(bits, k=rng.randrange(9)))
        assert [s for s in secret_scan.scan(text) if s[1] < 3] == base(text), text


def test_checksums():
    good = secret_scan.checksummed_token("ghp_", "a1B2" * 7 + "zz")
    npm = secret_scan.checksummed_token("npm_", "Q" * 30)
    assert secret_scan.spelled(secret_scan.scan(f"é {good} {npm}")) == "github:2:42,npm:43:83"
    wrong = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert secret_scan.scan(wrong) == [] and secret_scan.scan("x" + good) == [] and secret_scan.scan(good + "9") == []


def test_secret_table(spark):
    df = spark.createDataFrame([(1, "token: abcdef1", 1), (2, None, 1), (3, "", 1), (1, "token: abcdef1", 1)], "doc_id long, text string, secrets int")
    out = secret_scan.scan_texts(df).collect()
    assert [(r.doc_id, [tuple(s) for s in r.secrets]) for r in out] == [(1, [("assign", 0, 14)]), (2, []), (3, []), (1, [("assign", 0, 14)])]
    assert secret_scan.scan_texts(df.limit(0)).count() == 0


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)


def test_measures_against_brute_force():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choices(["a", "b", "é", " ", "\n", "\t", "\x0b", "\r", "\xa0", "\x85", "\x1c", "#", "|", "x y z ", "日"], k=rng.randrange(40)))
        t = quality.Text(text)
        assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == measured(text), text


def test_verdict_does_not_depend_on_the_order():
    rng = random.Random(5)
    good = " ".join(f"word{rng.randrange(10**6)}" for _ in range(80))
    texts = [good, "", "few words", "a b c " * 40, good + "#" * 30, "\n".join([good] * 2), " ".join(["x"] * 60), " ".join(["12"] * 30 + [f"w{i}" for i in range(25)])]
    names = list(quality.RULES)
    for t in texts:
        verdicts = {quality.first_rejection(quality.Text(t), rng.sample(names, len(names))) is None for _ in range(20)}
        assert len(verdicts) == 1
    assert quality.first_rejection(quality.Text(good), names) is None
    assert all(quality.first_rejection(quality.Text(t), names) for t in texts[1:])


def test_order_is_by_rejection_per_cost():
    order = quality.rule_order(["few words"] * 50 + ["# # " * 40] * 5)
    assert order.index("few_words") < order.index("word_length") and set(order) == set(quality.RULES)
    assert quality.rule_order([]) == list(quality.RULES)


def test_quality_table(spark):
    df = spark.createDataFrame([(1, "x y", 1), (2, None, 1), (3, "", 1), (1, "x y", 1)], "doc_id long, text string, kept int")
    out = quality.cascade(df).collect()
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in out] == [(1, 2, True, False), (2, 0, True, False), (3, 0, True, False), (1, 2, True, False)]
    assert quality.cascade(df.limit(0)).count() == 0
    assert quality.cascade(df, measures=False).columns == ["doc_id", "kept"]

import random
from collections import Counter

import regex

from claimloom.llm import decontaminate


def brute(docs, items, words=5, percent=80):
    """Weighted similarity of the window at every start with every item."""
    split = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    shingles = lambda w: [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    out = {}
    for d, text in docs:
        w = split(text)
        for item, t in items:
            v = split(t)
            if len(v) < words or len(w) < words:
                continue
            have, want = shingles(w), shingles(v)
            if not set(have) & set(want):
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = Counter(shingles(w[s : s + len(v)])), Counter(want)
                both = sum(min(n, b[x]) * min(63, len(x)) for x, n in a.items())
                union = sum(n * min(63, len(x)) for c in (a, b) for x, n in c.items()) - both
                if 100 * both >= percent * union:
                    best = out.get((d, item), (0, 0))
                    out[d, item] = min(best, (-both / union, s))
    return {k: (-v[0], v[1]) for k, v in out.items()}


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.similarity, r.at) for r in decontaminate.leaks(d, b, **more).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)] + ["É", "straße", "of", "the"]
    say = lambda n: rng.choices(vocab, k=n)
    items = [(i, " ".join(say(rng.choice([8, 20, 20, 40, 60])))) for i in range(12)] + [(50, "one two"), (51, None), (52, "")]
    items.append((53, items[0][1]))
    docs = [(100, None), (101, ""), (102, "three words only"), (103, items[1][1]), (None, "x " + items[2][1])]
    for k in range(80):
        w = rng.choice(items[:12])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = say(rng.choice([0, 1]))
        docs.append((k, " ".join(say(rng.randrange(30))) + "\n" + ", ".join(w).upper() + ".\n" + " ".join(say(rng.randrange(30)))))
    docs += docs[:7]
    want = brute(docs, items)
    got = found(spark, docs, items)
    assert len(want) > 30
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "a b c d e f")]) == {} and found(spark, [(1, "a b c d e f")], []) == {}
    d = spark.createDataFrame([(1, "a b c d e f", 1, "z"), (2, "other words of no item here", 1, "z")], "doc_id long, text string, code int, window string")
    b = spark.createDataFrame([(7, "A, b; c d e f!", "q")], "item_id long, text string, doc_id string")
    assert [r.doc_id for r in decontaminate.decontaminated(d, b).collect()] == [2]
    assert decontaminate.decontaminated(d, b).columns == d.columns


def test_shuffled_seeds_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(5)
    say = lambda n: rng.choices([f"w{i}" for i in range(300)], k=n)
    items = [(i, " ".join(say(25))) for i in range(10)]
    docs = [(k, " ".join([*say(9), *rng.choice(items)[1].split()[: rng.choice([25, 24, 12])], *say(9)])) for k in range(60)]
    want = found(spark, docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert found(spark, docs, items) == want == brute(docs, items) and len(want) > 20


def test_recall_of_the_index_by_similarity(spark):
    """Planted near matches from 0.8 to 1: the index finds at least 0.9 of what exact search does, in each band."""
    rng = random.Random(8)
    vocab = ["w" * rng.choice([2, 4, 7]) + str(i) for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([30, 60, 90])))) for i in range(40)]
    docs = []
    for k in range(600):
        w = items[k % 40][1].split()
        for _ in range(k % 4):
            w[rng.choice([0, 1, -1, -2, rng.randrange(len(w))])] = rng.choice(vocab)
        docs.append((k, " ".join([*rng.choices(vocab, k=5), *w, *rng.choices(vocab, k=5)])))
    want, got = brute(docs, items), found(spark, docs, items)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        band = [k for k, v in want.items() if low <= v[0] < high]
        assert len(band) >= 10, (low, len(band))
        assert sum(k in got for k in band) >= 0.9 * len(band), (low, high)


def test_a_very_long_text_and_seeds_that_all_items_share(spark):
    """100,000 words around one item, and items that differ in a few words only."""
    rng = random.Random(9)
    common = [f"common{i}" for i in range(30)]
    items = [(i, " ".join([*common, f"own{i}", f"last{i}"])) for i in range(20)]
    long = rng.choices([f"x{i}" for i in range(20000)], k=100_000)
    at = 50_000
    docs = [(1, " ".join(long[:at] + items[3][1].split() + long[at:])), (2, " ".join(long))]
    got = found(spark, docs, items)
    assert got[1, 3] == (1.0, at) and {d for d, _ in got} == {1}
    assert got == brute(docs[:1], items)

import random
from collections import Counter

from claimloom.llm import decontaminate


def similarity(text, item, start):
    shingles = lambda w: Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4))
    a, b = shingles(text[start : start + len(item)]), shingles(item)
    weigh = lambda c: sum(n * min(63, len(x)) for x, n in c.items())
    both = weigh(a & b)
    return both / (weigh(a) + weigh(b) - both)


def test_windows_between_and_beside_alignments(spark):
    """Every start is tried: pairs that reach the threshold at an unaligned start only are found."""
    rng = random.Random(3)
    say = lambda n: ["w" * rng.choice([1, 2, 5, 11]) + str(rng.randrange(10**6)) for _ in range(n)]
    items, docs, want, unaligned = [], [], {}, 0
    for k in range(400):
        item = say(50)
        at = rng.choice([43, 44, 45])
        text = say(6) + (item[:at] + say(2) + item[at:] if k % 2 else item[: at - 3] + say(7)) + say(6)
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(text)))
        aligned = min((-similarity(text, item, s), s) for s in ((6, 8) if k % 2 else (6,)))
        best = min((-similarity(text, item, s), s) for s in range(len(text) - len(item) + 1))
        unaligned += aligned[0] > -0.8 >= best[0]
        if best[0] <= -0.8:
            want[k] = (-best[0], best[1])
    assert unaligned > 3
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.similarity, r.at) for r in decontaminate.leaks(d, b).collect() if r.doc_id == r.item_id}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)

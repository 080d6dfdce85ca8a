import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import repeats


def brute(rows, t):
    raws = [(d, (x or "").encode()) for d, x in rows]
    seen = Counter(r[s : s + t] for _, r in raws for s in range(len(r) - t + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - t + 1):
            if seen[r[s : s + t]] > 1:
                gone[s : s + t] = b"\1" * t
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ab", k=rng.randrange(1, 120))) for _ in range(6)] + ["é" * 30, "x" * 80, "日本語" * 9]
    made = [None, "", *("".join(rng.choices(base, k=rng.randrange(8))) for _ in range(6))]
    return [(i, rng.choice(made)) for i in range(35)] + [(None, made[3]), (3, made[4]), (3, made[4])]


@pytest.mark.parametrize("group", [100_000, 9, 2])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    for seed in (1, 2):
        rows = texts(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = [tuple(r) for r in repeats.remove_repeats(df, 40, with_text=False).collect()]
        assert sorted(got, key=repr) == brute(rows, 40)


def test_production_threshold_and_spans(spark):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = say(350)
    rows = [(1, say(99) + "Z" + passage + "Z" + say(30)), (2, passage), (3, "Y" + passage[:199] + "Y" + say(10)), (4, passage[100:320] + "Y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as gram")
    out = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert sorted(tuple(r)[:5] for r in out.values()) == brute(rows, 200)
    assert [tuple(s) for s in out[1].removed] == [(100, 450)] and bytes(out[2].kept) == b"" and out[3].n_removed == 0


def test_empty_table_and_small_threshold(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, 8)


def test_digit_passes_order_suffixes_as_sorting_does():
    rng = random.Random(4)
    rows = [bytes(rng.choices(b"ab\0", k=rng.choice([0, 3, 17, 30, 30, 30]))) for _ in range(300)]
    groups = np.sort(np.array(rng.choices(range(5), k=300)))
    for depth in (8, 20, 24):
        cut = [r[:depth].ljust(-(-depth // 8) * 8, b"\0") for r in rows]
        order, common = repeats.radix_order(groups, repeats.digits(rows, depth))
        assert [(groups[i], cut[i]) for i in order] == sorted((groups[i], cut[i]) for i in range(300))
        for place in range(1, 300):
            i, j = order[place - 1], order[place]
            same = next((k for k, (x, y) in enumerate(zip(cut[i], cut[j], strict=True)) if x != y), len(cut[i]))
            assert common[place] == (-1 if groups[i] != groups[j] else same)


def test_segments_find_the_same_anchors(monkeypatch):
    rng = random.Random(6)
    raw = bytes(rng.choices(b"abcd ", k=9000)) * 2
    whole = repeats.anchors(raw, 200)
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(raw, 200), strict=True))


def test_a_very_long_text_that_repeats_itself(spark):
    rng = random.Random(10)
    part = "".join(rng.choices("abcdefgh ", k=600_000))
    rows = [(1, part + "#" + part[:300_000] + "#" + "".join(rng.choices("abcdefgh ", k=500_000))), (2, "short")]
    out = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in out[1].removed] == [(0, 300_000), (600_001, 900_001)] and out[2].n_removed == 0

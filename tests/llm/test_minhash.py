import random
import re

import numpy as np
import pytest

from claimloom.llm import minhash


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        k = min(words, len(w)) or 1
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        low = min(ids) if ids else None
        low = low if sets[i] else d
        out.append((d, len(sets[i]), low, d == low))
    return sorted(out, key=repr)


def check(spark, rows, words=3, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash.near_duplicates(df, words, percent).collect()]
    assert sorted(got, key=repr) == brute(rows, words, percent)


def near_copies(rng, n):
    """A chain and a star of edits, many of them just under or over the threshold."""
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows, now = [], base
    for k in range(n):
        src = rng.choice([base, now])
        now = list(src)
        for _ in range(rng.randrange(6)):
            now[rng.randrange(len(now))] = f"x{rng.randrange(900)}"
        rows.append((1000 + k, " ".join(now)))
    return rows


def test_near_copies_nulls_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = near_copies(rng, 60) + [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "Two  words"), (8, "\x85\xa0"), (None, "one"), (9, "É a b"), (10, "é a b")]
    rows += rows[:5]
    check(spark, rows)
    check(spark, rows, 5, 80)


@pytest.mark.parametrize("split", [65_536, 9])
def test_blocks_of_unresolved_buckets(spark, monkeypatch, split):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SPLIT", split)
    check(spark, near_copies(random.Random(8), 80))


def test_empty_table_and_clashing_columns(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c", 5, "r"), (2, "a b c", 6, "s")], "doc_id long, text string, set_id long, root string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_posterior_bound_and_signatures():
    least = minhash.least_matches(85)
    assert all(0 < m < 16 * (i + 1) for i, m in enumerate(least)) and list(least) == sorted(least)
    rng = np.random.default_rng(1)
    items = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    a, b = items[:3600], items[400:]
    share = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(share - 0.8) < 0.15
    assert minhash.linked(a, b, 80) and not minhash.linked(a, b, 81)


def test_deduplicated_rows_with_nulls_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (2, text + " more"), (2, text + " more"), (None, text), (None, "lonely words of nobody else"), (7, None), (7, None), (8, ""), (9, "short")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, root string")
    out = minhash.deduplicated(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(2, text + " more"), (None, "lonely words of nobody else"), (7, None), (7, None), (8, ""), (9, "short")], key=repr)
    assert minhash.deduplicated(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    chain = list(range(100, 160))
    edges = list(zip(chain, chain[1:], strict=False)) + [(5, x) for x in range(6, 30)] + [(40, 41), (41, 40)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == 100 for x in chain) and all(got[x] == 5 for x in range(5, 30)) and got[41] == got[40] == 40
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_that_share_half_a_digest_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 10, 7), (2, 10, 8), (3, 10, 7), (4, 11, 9), (5, None, None)], "doc_id long, set_id long, mate long")
    got = {r.doc_id: r.set_id for r in minhash.told_apart(rows).collect()}
    assert got[1] == got[3] != got[2] and 10 not in (got[1], got[2]) and got[4] == 11 and got[5] is None


def test_columns_of_any_name_pass(spark):
    names = ["_id", "_key", "_linked", "_text_key", "_first", "row", "n", "several", "root", "set_id"]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text, *"abcdefghij"), (1, text, *"klmnopqrst"), (1, text, *"klmnopqrst"), (3, None, *"klmnopqrst"), (3, None, *"klmnopqrst")]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = minhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted(rows[2:])


def test_large_open_buckets_are_split(spark, monkeypatch):
    """Texts that share much boilerplate and are no near copies, with near copies among them."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "SPLIT", 5)
    rng = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for k in range(70):
        own = [f"o{rng.randrange(10**6)}" for _ in range(20)]
        rows.append((k, " ".join(common + own)))
        if k % 5 == 0:
            rows.append((500 + k, " ".join(common + own[:-1] + ["other"])))
    check(spark, rows, 3, 85)


@pytest.mark.parametrize("split", [65_536, 2])
def test_a_pair_that_shares_one_band_is_linked_whatever_the_bucket_holds(spark, monkeypatch, split):
    """Texts 1 and 2 are at exactly 0.8 and agree in band 3 only; text 3, linked with neither, heads its bucket."""
    monkeypatch.setattr(minhash, "SPLIT", split)
    text = "a806496 a649608 a238377 a603907 a598869 a271431 a432528 a883377"
    rows = [(1, text), (2, text + " x14663"), (3, text + " y1133 y1134 y1135")]
    sets = [minhash.shingles(t.encode(), 5) for _, t in rows]
    bands = [minhash.signature(x).reshape(minhash.BANDS, minhash.ROWS) for x in sets]
    assert np.flatnonzero((bands[0] == bands[1]).all(axis=1)).tolist() == [3] and (bands[2][3] == bands[0][3]).all()
    assert min(sets, key=minhash.digest) is sets[2]
    check(spark, rows, 5, 80)
    assert {r.doc_id for r in minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 3}


@pytest.mark.parametrize("many", [256, 0])
def test_partners_in_a_unit_of_one_or_two_blocks(monkeypatch, many):
    monkeypatch.setattr(minhash, "MANY", many)
    rng = np.random.default_rng(6)
    wide = rng.integers(0, 1 << 32, (40, minhash.HASHES), dtype=np.uint32)
    for k in range(1, 40):  # each agrees with the one before in a share of its minima
        same = rng.random(minhash.HASHES) < rng.choice([0.5, 0.75, 0.9])
        wide[k, same] = wide[k - 1, same]
    root = [k // 3 * (k % 2) for k in range(40)]
    for head, block in (((7, 2, 2), [2] * 40), ((7, 2, 5), [2] * 17 + [5] * 23)):
        unit = minhash._Unit(head, [(k, root[k], block[k], wide[k].tobytes()) for k in range(40)])
        for n in range(40):
            want = [k for k in range(n + 1, 40) if root[k] != root[n] and (head[1] == head[2] or block[k] != block[n]) and len(minhash.surviving(wide[n : n + 1], wide[k : k + 1], 80))]
            assert unit.partners(n, 80).tolist() == want


def test_a_very_long_text(spark):
    rng = random.Random(2)
    w = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:110_000])), (3, " ".join(w[:20_000])), (4, "w1 w2 w3 w4")]
    check(spark, rows)

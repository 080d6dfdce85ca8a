import random

from pyspark.sql import functions as F

from claimloom.llm import chat


def brute(rows, branches):
    """Every root-to-leaf path by walking up, ranked, formatted."""
    by = {(c, n): (p, r or "", t or "", s or 0.0) for c, n, p, r, t, s in rows}
    kids = {(c, p) for (c, n), (p, *_) in by.items() if (c, p) in by}
    paths = {}
    for c, n in by:
        if (c, n) in kids:
            continue
        path, at, seen = [], n, set()
        while (c, at) in by and at not in seen:
            seen.add(at)
            path.append(at)
            at = by[c, at][0]
        if (c, at) in by:
            continue  # a cycle
        paths.setdefault(c, []).append((-sum(by[c, x][3] for x in path), -len(path), n, path[::-1]))
    out = {}
    for c, found in paths.items():
        for k, (_, _, leaf, path) in enumerate(sorted(found)[:branches]):
            out[c, leaf] = (k + 1, [(by[c, x][1], by[c, x][2]) for x in path])
    return out


def check(spark, rows, branches):
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    got = chat.read_back(chat.format_trees(df, branches)).collect()
    want = brute(rows, branches)
    assert {(r.conv_id, r.leaf): (r.branch, [tuple(t) for t in r.turns]) for r in got} == want
    for r in got:
        assert r.loss == [t for role, t in want[r.conv_id, r.leaf][1] if role == "assistant"]
        assert r.n_turns == len(r.turns)


def test_trees_with_nulls_controls_cycles_and_ties(spark):
    rng = random.Random(4)
    bits = ["</turn>\n", "<text>", "<turn>", "\\", "\\l", "\\b", "b", "l", "é", "\n", ""]
    rows = []
    for c in (1, 2, 3, None):
        for n in range(1, 40):
            parent = rng.choice([None, 999, *range(1, n)]) if n > 3 else (n - 1 or None)
            text = rng.choice([None, *("".join(rng.choices(bits, k=4)) for _ in range(9))])
            rows.append((c, n, parent, rng.choice(["user", "assistant", None, "<text>"]), text, rng.choice([None, 0.5, 1.0])))
    rows += [(9, 1, 2, "user", "a", 1.0), (9, 2, 1, "user", "b", 1.0), (9, 3, None, "user", "c", 1.0), (9, 4, 2, "user", "d", 1.0)]
    check(spark, rows, 1)
    check(spark, rows, 100)


def test_long_chain_and_empty_table(spark):
    rows = [(1, n, n - 1 or None, "assistant" if n % 2 else "user", f"t{n}", 0.0) for n in range(1, 70)]
    check(spark, rows, 1)
    check(spark, [], 1)


def test_rows_by_turn_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b", "x"), (1, 0, "user", None, "y"), (1, 1, "assistant", "b", "z"), (None, None, None, None, None)], "conv_id long, turn long, role string, text string, node string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_trees(chat.reply_tree(rows))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert out[1].loss == ["b", "b"] and out[None].n_turns == 1


def test_escapes_are_reversible(spark):
    texts = ["\\### Assistant: </turn> ok", "\\\\b<\\l<<", "\\bl", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "<" not in r.e for r in rows)

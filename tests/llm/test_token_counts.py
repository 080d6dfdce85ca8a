import random

from claimloom.llm import token_counts
from claimloom.llm.bpe import load
from claimloom.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.tiktoken")
BITS = ["a", "b", " ", "\n", "\t", "'s", "'re", "'", "é", "日本", "r", "e", "1", "२", "!!", "  ", "ll", "<|endoftext|>"]


def test_edits_against_a_full_recount():
    c = token_counts.Counter(load(PATH), cache=20)
    rng = random.Random(3)
    for _ in range(5000):
        tree = token_counts.Tree.of("".join(rng.choices(BITS, k=rng.randrange(14))), c)
        text = tree.text
        for _ in range(rng.randrange(6)):
            start, gone, new = rng.randrange(len(text) + 2), rng.randrange(5), "".join(rng.choices(BITS, k=rng.randrange(3)))
            text = text[: min(start, len(text))] + new + text[min(start, len(text)) + gone :]
            tree.edit(start, gone, new)
            split = c.split.findall(text)
            assert tree.text == text and [x.tolist() for x in tree.leaves()] == [[*map(len, split)], [*map(c.of, split)]]
            assert tree.tokens == len(c.own.encode_ordinary(text)) and tree.chars == len(text)


def test_an_edit_costs_its_region_only():
    c = token_counts.Counter(load(PATH))
    tree = token_counts.Tree.of("some words and more " * 5000, c)
    tree.edit(50_000, 3, "new words")
    assert tree.encoded < 12


def test_table(spark):
    rows = [(1, "Hello world", [(5, 6, " there, all of you"), (0, 0, "Oh ")]), (2, None, [(0, 0, "two words")]), (3, "", None), (4, "x", [(9, 9, None)]), (1, "Hello world", [])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, edits array<struct<start:int,gone:int,new:string>>, n_tokens int")
    out = token_counts.counts_after_edits(df, PATH).collect()
    c = token_counts.Counter(load(PATH))
    n = lambda t: len(c.own.encode_ordinary(t))
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in out) == [(1, 2, 2), (1, 2, n("Oh Hello there, all of you")), (2, 0, 2), (3, 0, 0), (4, 1, 1)]
    assert token_counts.counts_after_edits(df.limit(0), PATH).count() == 0


def test_edit_logs(spark):
    log = spark.createDataFrame([(1, 2, 0, 1, "b"), (1, 1, 0, 0, "a")], "doc_id long, seq int, start int, gone int, new string")
    (r,) = token_counts.collected_edits(log).collect()
    assert [e.new for e in r.edits] == ["a", "b"]


def test_kept_trees_take_logs_and_encode_touched_regions_only(spark):
    rng = random.Random(8)
    texts = {i: "".join(rng.choices([*BITS, "word ", "Another ", ", "], k=rng.randrange(60))) for i in range(40)} | {90: "", 91: None, 92: "some words and more " * 20_000}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, lens int")
    kept = token_counts.trees(docs, PATH)
    c = token_counts.Counter(load(PATH))
    for _ in range(2):
        log = [(rng.choice([*texts, 1000]), q, rng.randrange(70), rng.randrange(9), "".join(rng.choices(BITS, k=rng.randrange(4)))) for q in range(50)] + [(92, 99, 200_000, 3, "it's")]
        for d, _, start, gone, new in log:
            if d in texts:
                t = texts[d] or ""
                texts[d] = t[:start] + new + t[start + gone :]
        kept = token_counts.updated(kept, spark.createDataFrame(log, "doc_id long, seq int, start int, gone int, new string"), PATH)
        kept = token_counts.written(kept, "kept")
        got = {r.doc_id: r for r in kept.collect()}
        assert got.keys() == texts.keys()
        for d, t in texts.items():
            split = c.split.findall(t or "")
            assert (got[d].text, got[d].lens, got[d].counts) == (t or "", [*map(len, split)], [*map(c.of, split)]) and got[d].n_tokens == sum(got[d].counts)
    one = spark.createDataFrame([(92, texts[92], [(200_000, 2, "new words")])], "doc_id long, text string, edits array<struct<start:int,gone:int,new:string>>")
    (r,) = token_counts.edited(token_counts.trees(one, PATH, edits_col="edits"), PATH).collect()
    assert r.n_reencoded < 12 < r.n_pieces

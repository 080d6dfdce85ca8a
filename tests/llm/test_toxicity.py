import random

from claimloom.llm import toxicity

BAD = ["vequeno", "vequira", "lostragen", "gromwick", "gromlett"]


def corpus(rng, n, share=0.3):
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(["an", "er", "tion", "st", "he", "ing", "ou", "re"], k=rng.randrange(1, 5))) for _ in range(rng.randrange(40, 200))]
        bad = rng.random() < share
        for _ in range(max(2, len(words) // 40) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = corpus(rng, 900)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d % 3 != 1], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[d], y) for d, _, y in rows if d % 3 == 1]
    right = sum((s >= toxicity.REJECT) == bool(y) for s, y in held)
    assert right / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values())
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {d for d, s in got.items() if s < toxicity.REJECT} and toxicity.without_toxic(docs, model).columns == docs.columns


def test_model_does_not_depend_on_partitions(spark):
    rows = corpus(random.Random(2), 120)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    a, b = (toxicity.train(x, y) for x, y in ((docs, labels), (docs.repartition(5), labels.repartition(3))))
    assert a.parts == b.parts and (a.curve[0] == b.curve[0]).all()


def test_nulls_repeats_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "text"), (3, "text"), (None, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    odd = spark.createDataFrame([(3, 1), (3, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, odd)).count() == 5
    rows = corpus(random.Random(3), 60)
    model = toxicity.fitted([(y, t.encode()) for _, t, y in rows], (40, 20))
    assert toxicity.score(docs, model).count() == 5 and toxicity.score(docs.limit(0), model).count() == 0

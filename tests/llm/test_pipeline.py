import random

import corpus_pipeline
from claimloom.llm import bpe
from claimloom.llm.queries import vocabulary


def test_stages_over_planted_cases(spark, tmp_path):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choices(["an", "er", "ti", "st", "he", "in", "ou", "re"], k=rng.randrange(2, 6))) for _ in range(n))
    clean = [(i, say(80)) for i in range(200)]
    item = say(30)
    base = say(100)
    words = base.split()
    words[50] = "changed"
    toxic = [(300 + i, " ".join(w if rng.random() > 0.1 else "gromwickle" for w in say(80).split()) + " gromwickle") for i in range(100)]
    planted = [(500, base), (501, base), (502, " ".join(words)), (510, say(20) + " " + item + " " + say(20)), (520, "Write to some.one@mail.example.com or " + say(60)), (530, None), (531, "")]
    rows = clean + toxic + planted
    for name, data, ddl in (
        ("documents", [(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(d, 1, int(300 <= d < 400)) for d, _ in clean + toxic], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, ddl).write.parquet(f"file://{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {d for d, _ in clean}
    assert len(kept["toxicity"].keys() & set(range(300, 400))) <= 3
    assert len(ids - kept["toxicity"].keys()) <= 3
    assert kept["near_dedup"].keys() == kept["toxicity"].keys() - {501, 502}
    assert kept["decontamination"].keys() == kept["near_dedup"].keys() - {510}
    assert kept["pii"][520].startswith("Write to [EMAIL] or ") and kept["pii"].keys() == kept["decontamination"].keys()
    final = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in final} == kept["pii"].keys()
    own = bpe.Encoder(bpe.Vocabulary(bpe.load(vocabulary("byte_bpe_50k.json"))))
    assert all(bytes(r.ids) == own.packed(kept["pii"][r.doc_id] or "") for r in final)

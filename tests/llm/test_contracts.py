"""Every query opN_ over the smallest tables, against DuckDB or an independent recomputation, and every
operator and stage over odd rows."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import tokenizers
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import bpe, chat, decontaminate, minhash, pii, quality, queries, repeats, secret_scan, token_counts, toxicity

DATA = os.environ.get("CLAIMLOOM_TESTDATA", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def texts():
    return {d: t or "" for d, t in duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()}


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def spelled(spans):
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


@tables
def test_secret_scan(spark):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    kinds = "assign", "access", "hex"
    want = texts()
    got = queries.op6_secret_scan(spark, DATA).collect()
    for r in got:
        t = want[r.doc_id]
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = spelled((s, kinds[k], e) for s, k, e in sorted(found))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[1] == k for f in found) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        own = r.spans.split(",") if r.spans else []
        assert [x for x in own if x.split(":")[0] in kinds] == (base.split(",") if base else [])
        assert all(x.split(":")[0] in secret_scan.KINDS for x in own)
    assert len(got) == len(want)


@tables
def test_pii(spark):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    want = texts()
    got = queries.op7_pii(spark, DATA).collect()
    for r in got:
        found = [(m.start(), k, m.end()) for k, (p, ok) in patterns.items() for m in re.finditer(p, want[r.doc_id]) if ok(m[0])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(f[1] == k for f in found) for k in patterns]
        assert r.base_sha256 == hashlib.sha256(spelled(found).encode()).hexdigest()
        own = r.spans.split(",") if r.spans else []
        assert [x for x in own if x.split(":")[0] in patterns] == [f"{k}:{s}:{e}" for s, k, e in found]
        at = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in own)]
        assert at == sorted(at)
    assert len(got) == len(want)


@tables
def test_bpe(spark):
    library = tokenizers.Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = texts()
    got = queries.op9_bpe(spark, DATA).collect()
    assert len(got) == len(want)
    for r in got:
        ids = library.encode(want[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@tables
def test_token_counts(spark):
    own = token_counts.Counter(bpe.load(queries.vocabulary("byte_bpe_50k.tiktoken"))).own
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    place = {r.doc_id: r.at for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), greatest(coalesce(char_length(text), 0), 1)) as at").collect()}
    want = texts()
    got = queries.op4_token_counts(spark, DATA).collect()
    assert len(got) == len(want)
    for r in got:
        t = want[r.doc_id]
        assert r.n_tokens == len(own.encode_ordinary(t))
        now = t
        for start, gone, new in ((place[r.doc_id], 7, "re-written"), (len(t) // 2, 0, " an added line,\nthen 42 more's"), (len(t) - 10, 1000, "")):
            a = min(max(start, 0), len(now))
            now = now[:a] + new + now[a + gone :]
        assert (r.n_tokens_edited, r.n_chars_edited) == (len(own.encode_ordinary(now)), len(now))


@tables
def test_toxicity(spark):
    """Scores follow from window lengths that zstandard gives without any of the operator's shortcuts."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    want = texts()
    got = queries.op5_toxicity(spark, DATA).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        if not isinstance(model, toxicity.Model):
            assert r.score == model
    sample = [want[d] for d in sorted(want)[:40]] + ["", "x"]
    built = toxicity.Model([f"lostragen word {i} vequeno".encode() * 3 for i in range(40)], [t.encode() for t in sample])
    built.calibrate([t.encode() for t in sample], built.sizers())
    shared, own = built.parts
    how = zstandard.ZstdCompressionParameters(compression_level=5, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    plain, toxic = (lambda w, d=d: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(w)) for d in (shared, own + shared))
    for t in sample:
        raw = t.encode()
        cut = [raw[i : i + 128] for i in range(0, len(raw), 128)] or [b""]
        saved = [plain(w) - toxic(w) for w in cut]
        assert np.abs(built.saved(raw, built.sizers()) - saved).max() <= 2  # a prepared dictionary may match a little otherwise


# ---- odd rows ---------------------------------------------------------------------------------

ODD = ["keep", "text_key", "_id", "_key", "_candidates", "_spans", "candidates", "spans", "row", "n", "root", "set_id", "code", "key", "gram", "window", "score", "lens", "counts", "size", "at", "content"]


def odd_rows():
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    base = say(80)
    long = say(60_000)
    out = [(1, base), (2, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, " \n\t"), (None, base), (None, None), (7, "mail a.b@c.example.com now"), (7, "mail a.b@c.example.com now"), (8, long), (9, "é日本 ﬁ \x00 ﻿" + "x" * 500), (10, say(40))]
    return out


def frame(spark, data, more=ODD):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit("en").alias(n) for n in ("lang", "source")), F.char_length("text").cast("long").alias("n_chars"), *(F.when(F.col("doc_id") != 1, F.lit("v")).alias(n) for n in more))


OPERATORS = {
    "op1": lambda s, d: decontaminate.leaks(d, s.createDataFrame([(1, odd_rows()[-1][1]), (None, None)], "item_id long, text string")),
    "op3": lambda s, d: repeats.remove_repeats(d),
    "op4": lambda s, d: token_counts.counts_after_edits(d.withColumn("edits", F.array(F.struct(F.lit(3).alias("start"), F.lit(None).cast("int").alias("gone"), F.lit("new").alias("new")))), queries.vocabulary("byte_bpe_50k.tiktoken")),
    "op5": lambda s, d: toxicity.score(d, toxicity.train(d, s.createDataFrame([(1, 1), (10, 0), (None, 1)], "doc_id long, toxic int"))),
    "op6": lambda s, d: secret_scan.scan_texts(d),
    "op7": lambda s, d: pii.find(d),
    "op8": lambda s, d: minhash.near_duplicates(d),
    "op9": lambda s, d: bpe.encode_texts(d, queries.vocabulary("byte_bpe_50k.json")),
    "op10": lambda s, d: quality.cascade(d, order=["few_words", "symbols", "letters", "word_length", "duplicate_lines", "repeated_words"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_over_odd_rows(spark, name):
    run = OPERATORS[name]
    plain = run(spark, frame(spark, odd_rows(), []))
    odd = run(spark, frame(spark, odd_rows()))
    got = sorted(map(repr, odd.collect()))
    assert odd.columns == plain.columns and got == sorted(map(repr, plain.collect()))
    assert len(got) == (1 if name == "op1" else len(odd_rows()))
    assert run(spark, frame(spark, [])).count() == 0


def test_repeated_nodes_and_long_messages(spark):
    long = "long " * 200_000
    m = [(1, 1, None, "user", "b", 0.0, "x"), (1, 1, None, "user", "a", 0.0, "x"), (1, 2, 1, "assistant", long, None, "x"), (None, 1, None, None, None, None, "x"), (2, None, None, "user", "no node", 0.0, "x")]
    df = spark.createDataFrame(m, "conv_id long, node long, parent long, role string, text string, score double, up string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_trees(df)).collect()}
    assert out.keys() == {1, None} and [t.text for t in out[1].turns] == ["a", long] and out[1].loss == [long]
    assert chat.format_trees(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('stages')}"
    spark.createDataFrame([(1, 1, 0), (10, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, odd_rows()[-1][1]), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_over_odd_rows(spark, sources, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain, odd = (stage(spark, frame(spark, odd_rows(), more), sources) for more in ([], ODD))
    if name != "bpe":
        assert odd.columns == ["doc_id", "text", "lang", "source", "n_chars", *ODD] and [f.dataType for f in odd.schema][:5] == [f.dataType for f in plain.schema][:5]
    names = plain.columns
    got = sorted(map(repr, odd.select(*names).collect()))
    assert got == sorted(map(repr, plain.collect())) and got
    assert stage(spark, frame(spark, []), sources).count() == 0


def test_pipeline_over_empty_tables(spark, sources, tmp_path):
    frame(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sources}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import bpe
from claimloom.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary("byte_bpe_50k.json")
BITS = ["a", "b", " ", "\n", "\t", "'s", "'re", "'", "é", "日本", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|endo", "1", "२", "🙂", "‍", "İ", "\x00", "!!", "  ", "the", "ing"]


@pytest.fixture(scope="module")
def pair():
    return bpe.Encoder(bpe.Vocabulary(bpe.load(PATH)), cache=50), tokenizers.Tokenizer.from_file(PATH)


def same(pair, text):
    own, ref = pair
    ids = ref.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, text
    assert own.decode(own.packed(text)) == ref.decode(ids, skip_special_tokens=False)


def test_against_the_library(pair):
    rng = random.Random(1)
    for _ in range(4000):
        same(pair, "".join(rng.choices(BITS, k=rng.randrange(12))))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(pair, text):
    same(pair, text)


def test_every_code_point_parts_alike(pair):
    for low in range(0, 0x30000, 64):
        same(pair, "".join(f"a{chr(c)}b1{chr(c)} {chr(c)}!" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000))


def test_long_pre_token_and_lone_bytes(pair):
    same(pair, "ab" * 20_000)
    assert pair[0].decode(b"\x80\x00\x00\x00"[:4]) == pair[1].decode([128], skip_special_tokens=False)


def test_table(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x"), (1, "Hello world")]
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, ids int")
    out = bpe.encode_texts(df, PATH, with_decoded=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out) == [(0, 1, "x"), (1, 2, "Hello world"), (1, 2, "Hello world"), (2, 0, ""), (3, 0, "")]
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.load(vocabulary("word_bpe_49k.json")))

"""A training corpus from `documents`: toxic texts go, one text of each group of near copies stays,
texts that hold a benchmark item go, personal data is masked, and what is left becomes tokens.

Each stage works on all rows that the one before kept and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, decontaminate, minhash, pii, toxicity
from claimloom.llm.common import written
from claimloom.llm.queries import held_out, vocabulary

#: SQL can express neither a trained classifier nor byte-pair merges.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score 0.7 or more go. Labels of the held-out third teach nothing here either."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.without_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at 0.8 or more, the one with the smallest id stays."""
    return minhash.deduplicated(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal spans become [KIND]; n_chars follows the text."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256."""
    return bpe.encode_texts(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs

"""Corpus pipeline: the toxicity, dedup, decontamination and packing operators applied to ``documents`` in turn.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet to the shared folder and read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from attemptlab.llm import decontaminate, exact_dedup, minhash, packing, toxicity
from attemptlab.llm.common import held_fold
from attemptlab.session import ensure_checkpoint_dir

#: SQL has no counterpart of the learned toxicity score; the tests compare the stages with brute-force versions.
ORACLE_SQL = None

#: Word shingles and similarity of the near-duplicate stage.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the model learns from the labels of folds 1 to 4."""
    ensure_checkpoint_dir(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(held_fold("doc_id") != 0)
    name = "__toxic_score"
    while name in docs.columns:
        name += "_"
    scored = toxicity.score_documents(docs, toxicity.fit(docs.select("doc_id", "text"), labels), score_col=name)
    return scored.where(scored[name] < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    ensure_checkpoint_dir(spark)
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays."""
    ensure_checkpoint_dir(spark)
    return minhash.keep_smallest(docs, size=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    ensure_checkpoint_dir(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("decontamination", drop_benchmark_text), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

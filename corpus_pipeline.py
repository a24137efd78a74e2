"""From documents to token digests: each stage takes all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from joinlift.functions.spread import shared_dir
from joinlift.llm import bpe, language, mixing, quality, queries, shingles

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language can be told for go."""
    return language.keep_identified(docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from this stage's own documents."""
    return quality.keep_good(docs, quality.fit(docs, queries.training_labels(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id: SimHash links of five-word shingles first, then
    MinHash bands for what they leave apart, all verified at similarity 0.8."""
    return shingles.keep_first(docs, words=queries.STAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until sources have their target shares."""
    return mixing.repeat(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    return bpe.round_trip(docs, queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.split_pattern())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("mixing", mix_sources),
    ("bpe", bpe_round_trip),
]

#: A trained model and a recursion over merges are among the stages, so there is no SQL twin; tests/llm holds it to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder that the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The operators with production parameters over their whole tables, by the name of their query."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlift.functions.spread import shared_dir
from joinlift.llm import (
    bpe, hard_negatives, language, mixing, multi_index, quality, sharding, simhash, token_file, topk, url_graph, warc, whitening,
)
from joinlift.llm.common import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the public tokenizers' files are, on every machine alike.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "")
#: Rules of host and path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block"))
SHINGLE_WORDS = 4          # of op2_simhash; the pipeline's stage takes five
STAGE_WORDS = 5
NEIGHBOURS = 20


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    found = language.identify(docs)
    return found.select("doc_id", F.col("lang").alias("declared"), "language", "confidence",
                        (F.col("language") != language.UND).alias("keep"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = simhash.near_duplicates(docs, words=SHINGLE_WORDS)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


@query
def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    token_file.write(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer("byte_bpe_50k.json"),
                     split_pattern(), added=True)
    return token_file.index(spark, path)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"), RULES)


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), split_pattern())


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return multi_index.search(vectors, lambda vec_id: F.pmod(vec_id, F.lit(20)) == 0, NEIGHBOURS)


@query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where(topk.usable(F.col("embedding")))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 64))
    rows = store(topk.one_per_id(vectors, "vec_id", whole))
    queries = rows.where("pmod(vec_id, 20) = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return topk.search_integers(rows, queries, NEIGHBOURS)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out quarter."""
    return table(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out("doc_id"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, lambda vec_id: vec_id % 100 == 0, label=label)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.catalogue(spark, path)


_SCORED = """scored AS (SELECT a.vec_id AS query_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM whole a JOIN whole b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {every} = 0)"""
_WHOLE = """whole AS (SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND {label} IS NOT NULL AND len(embedding) > 0
          AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))"""

ORACLES["op9_exact_topk"] = f"""WITH {_WHOLE.format(label="0", scale=64)}, {_SCORED.format(every=20)},
    ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

ORACLES["op11_hard_negatives"] = f"""WITH {_WHOLE.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", scale=256)}, {_SCORED.format(every=100)},
    positives AS (SELECT query_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5),
    ranked AS (SELECT p.query_id AS anchor_id, p.positive_id,
            CAST(row_number() OVER (PARTITION BY p.query_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
            s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON s.query_id = p.query_id AND s.label <> s.own
            AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
    SELECT * FROM ranked WHERE rank <= 10"""

# base32 of the SHA-1: five hex digits are four letters
ORACLES["op13_warc"] = """WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    placed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS sha,
            row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS place,
            first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS newest FROM payloads)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            CAST(((CAST('0x' || substr(sha, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
        CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN newest END AS refers_to
    FROM placed"""

"""Registry of runnable queries: a Spark plan and, where one exists, the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rnd(c: Column | str, digits: int) -> Column:
    """Rounded for comparison across engines, without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0))


def rnd_sql(e: str, digits: int) -> str:
    half = 0.5 * 10 ** -digits
    return f"(CASE WHEN abs({e}) < {half} THEN 0.0::DOUBLE ELSE round(({e})::DOUBLE, {digits}) END)"


def with_tables(body: str, **ctes: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in ctes.items()) + " " + body


def hash_sql(seed: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *parts])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


def md5_sql(seed: str, *parts: str) -> str:
    return "md5(" + " || '|' || ".join([f"'{seed}'", *parts]) + ")"

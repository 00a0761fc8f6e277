"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plyforge.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its own name, with its SQL counterpart if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, shared by all cores where the table is one small file: their texts are
    expensive to work on."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, shared in the same way, for work that is heavy per event."""
    return spread(table(spark, sf_dir, "events"), "event_id")

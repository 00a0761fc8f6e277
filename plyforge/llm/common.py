"""Helpers that the operators of this folder share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.session import remove_stored, small_batches  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share: ``spark.checkpoint.dir``, or the
    warehouse where the session names no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: a cut of the lineage that survives
    the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `written` that nothing will read any more."""
    for df in tables:
        remove_stored(df.sparkSession, df.written_to)


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column has."""
    taken, number, out = {c.lower() for c in df.columns}, 0, name
    while out.lower() in taken:
        number += 1
        out = f"{name}_{number}"
    return out


#: CTE ``crc`` with the 256 table entries of CRC-32, made bit by bit, for `crc32_sql`.
CRC_SQL = """crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS entries
  FROM range(256) r(n))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, unsigned, for a query that has ``crc`` in its FROM."""
    numbers = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    step = "xor(a >> 8, entries[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda a, b: {step}), 4294967295::BIGINT)"

"""Joins in which a few keys hold very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED = 16  # entries of the sketch for each key that can be frequent at once
FINE = 32  # shares for each part of the rows: they land on tasks by their hash, and many small ones land evenly


def _key(on: list[str]) -> Column:
    """One number for a key, NULL for a key that holds a NULL and meets nothing."""
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.xxhash64(*on))


def frequent_keys(df: DataFrame, on: list[str], parts: int) -> DataFrame:
    """DataFrame[_hot, _shares]: the keys that more than one part in ``parts`` of all rows have, and in how many
    shares each should be dealt, ``FINE`` for a part. There are ``parts`` of them at most, whatever the rows.

    They come from a mergeable sketch of frequent items: every task keeps ``TRACKED`` entries for each such key
    and none is missed, as the sketch's error is a small share of one part.
    """
    # approx_top_k gives counts that are high by its error at most.
    items = TRACKED * parts
    sketch = df.select(_key(on).alias("_k")).agg(
        F.call_function("approx_top_k", F.col("_k"), F.lit(parts), F.lit(items)).alias("top"), F.count("*").alias("_all"))
    listed = sketch.select("_all", F.explode("top").alias("t")).select(F.col("t.item").alias("_hot"), F.col("t.count").alias("_n"), "_all")
    return listed.where((F.col("_n") * parts > F.col("_all")) & F.col("_hot").isNotNull()).select(
        "_hot", F.ceil(F.col("_n") * parts * FINE / F.col("_all")).cast("int").alias("_shares"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", parts: int | None = None) -> DataFrame:
    """``left.join(right, on, how)`` for an inner or left join, with the keys that very many rows of ``left`` have
    dealt over many tasks: their rows get a random share number, and their rows of ``right`` are repeated once
    for each share. Rows without a key meet nothing and are dealt at random; all others are joined as ever.
    ``left`` is read once more, for the sketch.
    """
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(frequent_keys(left, on, parts))  # one row per part at most
    near = left.withColumn("_k", _key(on)).join(hot, F.col("_k") == F.col("_hot"), "left")
    some = F.xxhash64(F.monotonically_increasing_id())
    share = F.when(F.col("_shares").isNotNull(), F.pmod(some, F.col("_shares"))).when(F.col("_k").isNull(), F.pmod(some, F.lit(FINE * parts))).otherwise(0)
    near = near.withColumn("_share", share.cast("int")).drop("_k", "_hot", "_shares")
    far = right.withColumn("_k", _key(on)).join(hot, F.col("_k") == F.col("_hot"), "left")
    far = far.withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1)))
    return near.join(far.drop("_k", "_hot", "_shares"), [*on, "_share"], how).drop("_share")

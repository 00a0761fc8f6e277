"""Positions in a total order, hashed sampling and exact splits, all without a one-task window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.core import hash01
from plyforge.session import stored

RANGE_ROWS = 1_000_000  # rows that one task puts in order, about
PLACE_BITS = 33  # of a row's number that count within its range


def _row_hash(df: DataFrame) -> Column:
    """Hash of all columns of a row that can be hashed."""
    columns = [F.col(f"`{name}`") for name, kind in df.dtypes if not any(x in kind for x in ("map<", "variant", "void"))]
    return F.xxhash64(*columns)


def global_index(df: DataFrame, order: str, name: str = "idx", ranges: int | None = None, total: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order``, and the number of all rows as ``total``
    where that is named. Every row has a position of its own: a NULL key comes first, rows of one key are in
    the order of the hash of all their columns, and rows that are alike throughout in any order.

    Whole rows go through one range exchange, to as many ranges as their number asks for, are put in order
    within each, and stored with their place there, since a range's bounds are drawn from a sample and must
    not be drawn twice. A row's position is its place and the rows of the ranges before; the table that tells
    these has one row per range. Nothing is joined by key, and a key that most rows have is many ranges.
    """
    spark = df.sparkSession
    if ranges is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(least, -(-df.count() // RANGE_ROWS))
    told = df.select("*", _row_hash(df).alias("_tie"), F.xxhash64(F.monotonically_increasing_id()).alias("_read"))
    ranked = told.repartitionByRange(ranges, order, "_tie", "_read").sortWithinPartitions(order, "_tie", "_read")
    # The id counts rows within a partition in its low bits; the partition's number stands above.
    placed = stored(ranked.drop("_tie", "_read").withColumn("_at", F.monotonically_increasing_id()), "places")
    of_range = F.shiftright("_at", PLACE_BITS)
    counts = placed.groupBy(of_range.alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.sum("_n").over(Window.partitionBy()).alias("_total"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # One row per range, whatever the rows: small enough for every task.
    both = placed.withColumn("_range", of_range).join(F.broadcast(starts), "_range")
    more = [F.col("_total").alias(total)] if total else []
    return both.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name), *more)


def running_count(df: DataFrame, order: list[str], flag: str, name: str = "n") -> DataFrame:
    """Add the number of rows with ``flag`` up to each row, itself included, in the order of ``order``, which
    should tell all rows apart, so that rows of one value are many ranges too.

    Rows go through one range exchange and are counted within their range as they pass, with nothing kept but the
    count; the table that tells the flags of the ranges before has one row per range.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for batch in batches:
            batch[name] = batch[flag].astype("int64").cumsum() + n
            n = int(batch[name].iloc[-1]) if len(batch) else n
            yield batch

    ranked = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    told = ", ".join(f"`{c}` {kind}" for c, kind in ranked.dtypes)
    # A range's bounds are drawn from a sample and must not be drawn twice.
    placed = stored(ranked.mapInPandas(counted, f"{told}, `{name}` long"), "counts")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.max(name).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    both = placed.join(F.broadcast(starts), "_range")  # one row per range
    return both.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.col(name)).alias(name))


def slice_rows(df: DataFrame, order: str, start: int = 0, n: int | None = None) -> DataFrame:
    """Rows ``start`` to ``start + n`` in the order of a key, in this order; a NULL key comes first, and
    repeated keys count as often as they occur."""
    start = max(start, 0)
    idx = F.col("_idx")
    keep = idx >= start if n is None else (idx >= start) & (idx < start + n)
    return global_index(df, order, "_idx").where(keep).orderBy("_idx").drop("_idx")


def first_per_source(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of every source; each task keeps at most ``n`` before the shuffle."""
    w = Window.partitionBy(source).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def game_number(df: DataFrame, order: str, name: str = "game_no") -> DataFrame:
    """Running number from 1 of each distinct value of ``order``, NULL first, joined back to its rows."""
    keys = global_index(df.select(order).distinct(), order, "_idx")
    keys = keys.select(F.col(order).alias("_key"), (F.col("_idx") + 1).alias(name))
    return df.join(keys, F.col(order).eqNullSafe(F.col("_key"))).drop("_key")


def sample_by_hash(df: DataFrame, key_cols: list[str], rate: float, seed: int, rule: str) -> DataFrame:
    """Keep about ``rate`` of the rows, each decided by its own key."""
    return df.where(hash01(seed, rule, *[F.col(c) for c in key_cols]) < rate)


def _shuffle_key(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(_shuffle_key(seed, key), key)


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, the first of the shuffled order, in this order; copies count as rows."""
    hashed = df.withColumn("_h", F.concat_ws("|", _shuffle_key(seed, key), F.col(key).cast("string")))
    return slice_rows(hashed, "_h", 0, n).drop("_h")


def split_exact(df: DataFrame, key: str, ratios: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """Add ``split`` (train, val, test) with exact sizes: int(r*n) each and the rest for test.

    Rows are ordered by the hash of their key; copies of a row, which share it, are split like any rows, and
    each row comes out once.
    """
    hashed = df.withColumn("_h", F.concat_ws("|", _shuffle_key(seed, key), F.col(key).cast("string")))
    at, n = F.col("_i"), F.col("_n")
    train_end = F.floor(F.lit(float(ratios[0])) * n)
    val_end = train_end + F.floor(F.lit(float(ratios[1])) * n)
    split = F.when(at < train_end, "train").when(at < val_end, "val").otherwise("test")
    return global_index(hashed, "_h", "_i", total="_n").withColumn("split", split).drop("_h", "_i", "_n")

"""Contiguous shards of equal size in bytes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.llm.common import CRC_SQL, crc32_sql, written

SHARDS = 8
PART = 33  # the low bits of a row's number count within its range partition


def text_bytes(text: Column) -> Column:
    """Size of a document: its UTF-8 bytes and one more; a NULL text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """The rows in the order of some columns, NULL first, in range partitions of about equal length. Rows that
    agree in all these columns are told apart by where they were read, so that any number of them is many
    partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = rows.withColumn("_read", F.xxhash64(F.monotonically_increasing_id()))
    return told.repartitionByRange(parts, *order, "_read").sortWithinPartitions(*order, "_read").drop("_read")


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of `dealt`, written once (the ranges are drawn from a sample and must not be drawn twice).
    ``_at`` rises in their order: the number of the partition above bit 33, the place within it below."""
    return written(dealt(rows, *order).withColumn("_at", F.monotonically_increasing_id()), "shard-order")


def _part(at: str = "_at") -> Column:
    return F.shiftright(at, PART)


def _up(a: Column, b: Column) -> Column:
    """a / b rounded up, both whole and not negative."""
    return F.call_function("div", a + b - 1, b)


def part_totals(rows: DataFrame) -> DataFrame:
    """One row per range partition: its bytes and rows, those of all partitions before it, and the bytes of
    all rows and the size of the largest. The windows are over this list of partitions."""
    per = rows.groupBy(_part().alias("_part")).agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"), F.max("size").alias("_most"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return per.select(
        "_part", "_bytes", "_rows",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_from"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_bytes").over(every).alias("_total"), F.max("_most").over(every).alias("_largest"),
    )


def shard_starts(rows: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """(at, shard, first): where each shard starts, and the number of rows before it; at most one row per
    shard, two shards may start at one place. ``rows`` has _at, size and group.

    The cut before shard k lies at k/shards of all bytes, within the row that holds this byte. Only the
    partitions that hold a cut, one per cut at most, are summed row by row. A row belongs to the shard in
    which its middle lies. Where all rows of the holder's group together are no larger than the largest
    single row, the group is placed as one row would be, so that groups stay together and yet no shard is
    further from its target than single rows make it; larger groups are cut between their rows.
    """
    n, total = F.lit(shards), F.col("_total")
    in_part = F.filter(
        F.sequence(_up(F.col("_from") * n, total), F.greatest(_up((F.col("_from") + F.col("_bytes")) * n, total), _up(F.col("_from") * n, total))),
        lambda k: (k > 0) & (k < n) & (k * total < (F.col("_from") + F.col("_bytes")) * n))
    held = totals.withColumn("_cuts", in_part).where(F.size("_cuts") > 0)  # at most one row per cut
    near = rows.select("_at", "size", "group", _part().alias("_part")).join(F.broadcast(held), "_part")
    along = Window.partitionBy("_part").orderBy("_at")
    near = near.withColumn("_start", F.col("_from") + F.sum("size").over(along) - F.col("size"))
    own = F.least(n - 1, F.call_function("div", (F.col("_start") * 2 + F.col("size")) * n, total * 2))
    near = near.withColumn("_own", own)
    first_cut = F.element_at("_cuts", 1) - 1
    near = near.withColumn("_last", F.coalesce(F.lag("_own").over(along), first_cut))
    near = written(near, "shard-cuts")  # rows of the partitions that hold a cut
    opened = near.where("_own > _last").select(F.explode(F.sequence(F.col("_last") + 1, F.col("_own"))).alias("shard"), "_at")
    held_cuts = held.select(F.explode("_cuts").alias("shard"), (F.shiftleft("_part", PART) + F.col("_rows")).alias("_end"))
    by_rows = held_cuts.join(opened, "shard", "left").select("shard", F.coalesce("_at", "_end").alias("at"))

    lo, hi = _up(F.col("_start") * n, total), _up((F.col("_start") + F.col("size")) * n, total)
    inside = F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda k: (k > 0) & (k < n) & (k * total < (F.col("_start") + F.col("size")) * n))
    holders = near.select(F.explode(inside).alias("shard"), "group", "_start", "_at", "_largest", "_total")
    first = holders.groupBy("group").agg(F.min(F.struct("_at", "_start")).alias("_holder"))  # at most one row per cut
    whole = rows.join(F.broadcast(first), "group").groupBy("group", "_holder").agg(
        F.sum("size").alias("_size"), F.min("_at").alias("_low"), F.max("_at").alias("_high"),
        F.sum(F.when(F.col("_at") < F.col("_holder._at"), F.col("size")).otherwise(0)).alias("_ahead"))
    middle = (F.col("_holder._start") - F.col("_ahead")) * 2 + F.col("_size")
    placed = holders.join(whole, "group").where("_size <= _largest").select(
        "shard", F.when(middle * n >= total * 2 * F.col("shard"), F.col("_low")).otherwise(F.col("_high") + 1).alias("_moved"))
    cuts = by_rows.join(placed, "shard", "left").select("shard", F.coalesce("_moved", "at").alias("at"))
    cuts = cuts.join(totals, _part("at") == F.col("_part"))
    low = F.col("at").bitwiseAND(F.lit((1 << PART) - 1))
    return cuts.select("at", "shard", (F.col("_before") + low).alias("first"))


def placed(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (with size, group, and the place ``_at`` of `in_order`) with ``shard`` and ``slot``.

    Every row finds its shard by comparing its place with the starts in its own partition; the table joined
    has one row per range partition, and the starts in all are one per shard.
    """
    totals = written(part_totals(rows), "shard-totals")
    starts = written(shard_starts(rows, totals, shards), "shard-starts")
    start = F.struct("at", "shard", "first").alias("start")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"))
    marks = totals.select(F.shiftleft("_part", PART).alias("at"), "_part", F.lit(None).cast("struct<at:long,shard:long,first:long>").alias("start"))
    marks = marks.unionByName(starts.select(F.col("at"), F.lit(None).cast("long").alias("_part"), start))
    so_far = Window.orderBy("at", F.col("_part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    base = marks.withColumn("base", F.coalesce(F.max("start").over(so_far), zero)).where("_part IS NOT NULL").select("_part", "base")
    inside = starts.select(_part("at").alias("_part"), start).groupBy("_part").agg(F.collect_list("start").alias("inside"))
    none = F.array().cast("array<struct<at:long,shard:long,first:long>>")
    per = base.join(inside, "_part", "left").join(totals.select("_part", "_before"), "_part").select(
        "_part", "_before", F.concat(F.array("base"), F.coalesce("inside", none)).alias("_starts"))
    found = rows.withColumn("_part", _part()).join(F.broadcast(per), "_part")
    found = found.withColumn("_in", F.array_max(F.filter("_starts", lambda s: s["at"] <= F.col("_at"))))
    index = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PART) - 1))
    return found.withColumn("shard", F.col("_in.shard").cast("int")).withColumn("slot", index - F.col("_in.first")).drop(
        "_part", "_before", "_starts", "_in")


def _measured(docs: DataFrame) -> list[Column]:
    return [text_bytes(docs["text"]).alias("size"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias("group")]


def shard_sizes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    Documents stand in the order of the hash of their text, then doc_id, so that equal texts are side by
    side; global prefix sums of their sizes come from the totals of range partitions, and the order is cut at
    equal shares of all bytes. A NULL text has size 1 like an empty one; a NULL doc_id comes first among
    equal texts; repeated rows each get a place; an empty table gives no rows; other columns are ignored.
    ``grown_shard`` belongs to another law and is NULL.
    """
    crc = F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("text_crc32")
    rows = in_order(docs.select("doc_id", *_measured(docs), crc), "group", "doc_id")
    return placed(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Whole documents with ``shard`` and ``slot`` in place of columns of these names; their texts are
    shuffled once. Rows and places are as in `shard_sizes`."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    own = F.struct(*[docs[c] for c in kept]).alias("_doc")
    rows = in_order(docs.select(own, docs["doc_id"].alias("_id"), *_measured(docs)), "group", "_id")
    return placed(rows, shards).select("_doc.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder per shard, ``path/shard=k``, in which files and the rows in them keep the order."""
    shard_documents(docs, shards).write.partitionBy("shard").parquet(path)


#: The same in SQL, with the values of the parameters above.
SHARD_SQL = f"""
WITH {CRC_SQL},
sized AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
         md5(coalesce(text, '')) AS grp
  FROM documents, crc),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY grp, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start,
         row_number() OVER (ORDER BY grp, doc_id NULLS FIRST, size) AS place, sum(size) OVER (PARTITION BY grp) AS grp_size,
         sum(size) OVER () AS total, max(size) OVER () AS largest
  FROM sized),
units AS (
  SELECT *, CASE WHEN grp_size <= largest THEN 2 * min(start) OVER (PARTITION BY grp) + grp_size ELSE 2 * start + size END AS middle
  FROM summed),
cut AS (SELECT *, CAST(least({SHARDS} - 1, middle * {SHARDS} // (2 * total)) AS INTEGER) AS shard FROM units)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

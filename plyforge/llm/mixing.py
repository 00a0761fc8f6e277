"""Mixing sources to target weights along a curriculum, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.llm.common import word_count, written

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order of their names, repeating
SHARE = 1.5  # of all words that the mix takes
MOST = 2.0  # times that a source may be taken
#: How a source's weight runs over the training: 1 + tilt * (2 t - 1) at time t from 0 to 1, for each
#: entry of the weights. The heavy sources fade, the light ones grow.
TILTS = (-0.5, 0.0, 0.5)
KNOTS = 256  # parts of a source's order at whose ends its running size is kept


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
                   tilts: Sequence[float] = TILTS) -> DataFrame:
    """(source, source_no, source_size, target, tilt) per source of ``sizes`` (source, size).

    Sources are taken by code point, NULL last. ``share`` of all words is divided by weight; a source
    stops at ``most`` times its size and the rest is divided again. The level at which this ends is
    the largest of the levels that follow from stopping the k sources of least size by weight, because
    what is handed out is a concave function of the level. The windows are over the list of sources,
    one row each, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1)
    place = F.col("source_no") % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place))
    per = per.withColumn("tilt", F.element_at(F.array(*map(F.lit, tilts)), place))
    stops = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "source_no")
    before, after = stops.rowsBetween(Window.unboundedPreceding, -1), stops.rowsBetween(0, Window.unboundedFollowing)
    # Sums of whole numbers and of weights are exact, so that the order of adding does not matter.
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")
    every = F.sum("source_size").over(Window.partitionBy()).cast("double")
    level = (every * F.lit(share) - full * F.lit(most)) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    target = F.least(F.col("level") * F.col("weight"), F.col("source_size") * F.lit(most))
    return per.select("source", "source_no", "source_size", target.alias("target"), "tilt")


def _part(target: Column, start: Column, size: Column) -> Column:
    """Words of a document that starts at ``start`` of its source's stream which lie below the target."""
    return F.greatest(F.lit(0), F.least(size, target - start)).cast("long")


def _time(offset: Column, target: Column, tilt: Column) -> Column:
    """When a source's stream gets to ``offset`` words: the integral of its schedule up to time t,
    (1 - tilt) t + tilt t², is the share of its target, solved for t."""
    q = offset / target
    root = (F.lit(1.0) - tilt) + F.sqrt((F.lit(1.0) - tilt) * (F.lit(1.0) - tilt) + F.lit(4.0) * tilt * q)
    return F.when(offset == 0, F.lit(0.0)).otherwise(F.lit(2.0) * q / root)


def _key() -> Column:
    """By which the documents of a source are ordered."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def plan(rows: DataFrame, targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add source_size, target, tilt, the words ``first`` and ``second`` that the first and the second
    pass over its source take of each row, and the training positions ``at_first`` and ``at_second``
    (NULL where nothing is taken). ``rows`` has doc_id, source and size, and whatever else.

    A source's stream is its documents in the order of md5(doc_id), then the same once more; the mix
    takes as many words of it as the target says, so that only the document at the end is cut. The
    running size within a source is the start of the document's bucket (the first three digits of the
    md5, 4096 buckets a source) plus a running sum within the bucket, so that a source that holds a
    third of all rows is not one task.
    """
    key, bucket = _key(), F.substring(_key(), 1, 3)
    parts = sizes.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("parts")
    starts = parts.join(targets.alias("t"), F.col("parts.source").eqNullSafe(F.col("t.source"))).select(
        F.col("parts.source").alias("_source"), "_bucket", "_from", "source_size", "target", "tilt")
    inside = Window.partitionBy("source", "_at").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_key", key).withColumn("_at", bucket)
    out = out.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_bucket")))
    out = out.withColumn("_start", F.col("_from") + F.col("_within"))
    again, words = F.col("_start") + F.col("source_size"), F.floor("target")
    out = out.withColumn("first", _part(words, F.col("_start"), F.col("size")))
    out = out.withColumn("second", _part(words, again, F.col("size")))
    for name, taken, offset in (("at_first", F.col("first"), F.col("_start")), ("at_second", F.col("second"), again)):
        out = out.withColumn(name, F.when(taken > 0, _time(offset, F.col("target"), F.col("tilt"))))
    return out.drop("_key", "_at", "_within", "_source", "_bucket", "_from", "_start")


def with_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the size is the number of words, 0 for NULL."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position, second_position) for every row of ``docs`` (doc_id,
    text, source): the words the mix takes of it, repeats counted, and when it is met in training the first and
    the second time (NULL where it is not). Rows are range-sorted into training order, by the first time and
    doc_id; those that are never met come last.

    A NULL text has size 0 and nothing of it is taken; NULL is a source of its own; a NULL doc_id
    comes as the empty text would; rows that share a doc_id stand side by side in their source's
    stream; an empty table gives no rows; other columns are ignored.
    """
    sizes = written(with_sizes(docs), "mix-sizes")
    out = plan(sizes, source_targets(sizes), sizes)
    out = out.select("doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"),
                     F.col("at_first").alias("position"), F.col("at_second").alias("second_position"))
    order = F.col("position").asc_nulls_last(), F.col("doc_id").asc()
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def stream_plan(sizes: DataFrame) -> DataFrame:
    """One row per source with all that its documents need to find their place in the mix: source_size,
    target, tilt, ``knots`` (the words before each 256th part of the order, and in all), and ``cuts``, the
    first document that each of the two passes does not take whole, with the words it takes of it."""
    targets = written(source_targets(sizes), "mix-targets")
    rows = plan(sizes, targets, sizes).withColumn("key", _key())
    order = F.struct("key", "doc_id", "size")
    cut = lambda taken: F.min(F.when(F.col(taken) < F.col("size"), F.struct(order.alias("order"), F.col(taken).alias("taken"))))
    cuts = rows.groupBy("source").agg(F.array(cut("first"), cut("second")).alias("cuts"))
    parts = sizes.groupBy("source", F.conv(F.substring(_key(), 1, 2), 16, 10).cast("int").alias("part")).agg(F.sum("size").alias("n"))
    counts = parts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("counts"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(KNOTS - 1)), lambda i: F.coalesce(F.element_at("counts", i), F.lit(0).cast("long")))
    start = F.array(F.lit(0).cast("long"))
    knots = F.aggregate(filled, start, lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
    both = cuts.alias("c").join(counts.alias("n"), F.col("c.source").eqNullSafe(F.col("n.source")))
    both = both.select(F.col("c.source").alias("source"), "cuts", knots.alias("knots")).alias("b")
    joined = both.join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    return written(joined.select(F.col("t.source").alias("_source"), "source_size", "target", "tilt", "cuts", "knots"), "mix-plan")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs`` in training order, once per pass that takes them.

    The plan is made from sizes alone and comes down to one row per source, so that texts are shuffled
    once, to where they stand in training. A document lies before, at or behind the cut of a pass; its
    position follows from the words before its 256th part of the order, which are exact, and its place
    within that part, which its hash tells. The one document a source at whose words the target ends is cut
    there (its words joined by one space, ``n_chars`` to match; repeated rows of it alike); documents
    without a word are never taken. Rows are range-sorted by training position, then doc_id.
    """
    # Other columns travel under names that cannot clash with those added here.
    names = {c: c if c in ("doc_id", "source", "text", "n_chars") else f"own_{i}" for i, c in enumerate(docs.columns)}
    kept = docs.select(*[F.col(c).alias(name) for c, name in names.items()])
    per = stream_plan(written(with_sizes(docs), "mix-sizes"))
    rows = kept.withColumn("size", word_count(F.col("text"))).where("size > 0").withColumn("key", _key())
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("_source")))
    order = F.struct("key", "doc_id", "size")
    part = F.conv(F.substring("key", 1, 2), 16, 10).cast("int") + 1
    within = F.conv(F.substring("key", 3, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    low, high = F.element_at("knots", part), F.element_at("knots", part + 1)
    rows = rows.withColumn("offset", low + within * (high - low))

    def one_pass(i: int) -> Column:
        cut = F.element_at("cuts", i + 1)
        taken = F.when(cut.isNull() | (order < cut["order"]), F.col("size")).when(order == cut["order"], cut["taken"]).otherwise(F.lit(0))
        offset = F.least(F.col("offset") + F.col("source_size") * i, F.col("target"))
        return F.struct(taken.cast("long").alias("taken"), _time(offset, F.col("target"), F.col("tilt")).alias("at"))

    rows = rows.withColumn("pass", F.explode(F.filter(F.array(one_pass(0), one_pass(1)), lambda p: p["taken"] > 0)))
    is_cut = F.col("pass.taken") < F.col("size")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(is_cut, F.array_join(F.slice(words, 1, F.col("pass.taken").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(is_cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    rows = rows.repartitionByRange(F.col("pass.at"), F.col("doc_id")).sortWithinPartitions("pass.at", "doc_id")
    return rows.select(*[F.col(name).alias(c) for c, name in names.items()])


#: The same in SQL, with the values of the parameters above.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][source_no % 3 + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][source_no % 3 + 1]::DOUBLE AS tilt
  FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE)
            / sum(weight) OVER (ORDER BY source_size / weight, source_no
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, tilt, least(max(level) OVER () * weight, source_size * 2.0::DOUBLE) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.tilt, CAST(floor(t.target) AS BIGINT) AS words,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(0, least(size, words - start)) AS first,
         greatest(0, least(size, words - start - source_size)) AS second
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(first + second AS BIGINT) AS taken,
       CASE WHEN first > 0 THEN CASE WHEN start = 0 THEN 0.0::DOUBLE ELSE
         2.0::DOUBLE * (start / target) / ((1.0::DOUBLE - tilt)
           + sqrt((1.0::DOUBLE - tilt) * (1.0::DOUBLE - tilt) + 4.0::DOUBLE * tilt * (start / target))) END END AS position
FROM taken
"""

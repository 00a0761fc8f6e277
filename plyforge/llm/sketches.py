"""Document fingerprints: all shingle hashes below a fixed fraction, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.core import let

SHINGLE = 5  # words
KEPT_BITS = 3  # a hash is kept if so many leading bits are zero: one of 8
QUANTILES, BUCKET_ROWS, MOST_BUCKETS = 256, 500, 65_536


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """A hash for each run of ``shingle`` words; a text of fewer words is one shingle, one of none has
    none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(w) - shingle),
                              lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
        return F.when(F.size(w) >= shingle, several).when(
            F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)


def sketch(text: Column, shingle: int = SHINGLE, bits: int = KEPT_BITS) -> Column:
    """The distinct shingle hashes whose first ``bits`` bits are zero, in order; where there is none,
    the smallest hash alone, so that only a text without words has an empty sketch.

    The threshold is the same for every text. The sketch of a text is therefore a sample of its
    shingles at one rate, the sketches of two texts sample what they share alike however unequal they
    are, and the union of two sketches is the sketch of both texts together (less a smallest hash that
    is above the threshold, where another is below it).
    """
    sign = F.lit(-(2**63))

    def kept(h: Column) -> Column:
        below = F.filter(h, lambda x: (x >= 0) & (x < F.lit(1 << (64 - bits))))
        smallest = F.array_min(F.transform(h, lambda x: x.bitwiseXOR(sign))).bitwiseXOR(sign)
        return let(F.sort_array(F.array_distinct(below)),
                   lambda b: F.when((F.size(b) == 0) & (F.size(h) > 0), F.array(smallest)).otherwise(b))

    return let(shingle_hashes(text, shingle), kept)


def fingerprint(sketched: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketched, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of shared among all shingles of two texts, from their sketches; 1 for two without."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimate of the part of the first text's shingles that the second holds; 1 where it has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, bits: int = KEPT_BITS) -> Column:
    """The sketch of two texts together."""
    sign = F.lit(-(2**63))

    def one(u: Column) -> Column:
        below = F.filter(u, lambda x: (x >= 0) & (x < F.lit(1 << (64 - bits))))
        smallest = F.array_min(F.transform(u, lambda x: x.bitwiseXOR(sign))).bitwiseXOR(sign)
        return F.when(F.size(below) > 0, below).when(F.size(u) > 0, F.array(smallest)).otherwise(u)

    return let(F.sort_array(F.array_union(a, b)), one)


def _bucketed(docs: DataFrame) -> DataFrame:
    """Add ``bucket``: ranges of doc_id that rise with it, -1 for NULL. Quantiles of the ids are the
    outer bounds, and each is divided evenly, so that a bucket holds about ``BUCKET_ROWS`` rows."""
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    rows, cuts = docs.agg(F.count("doc_id"), F.percentile_approx("doc_id", shares, 20 * QUANTILES)).first()
    cuts = sorted(set(cuts or []))
    buckets = min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS))
    if len(cuts) < 2:
        return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    finer = max(1, round(buckets / (len(cuts) - 1)))
    if buckets < len(cuts) - 1:
        cuts = [cuts[i * (len(cuts) - 1) // buckets] for i in range(buckets + 1)]
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    doc_id = F.col("doc_id")
    place = F.greatest(F.lit(1), F.least(F.lit(len(cuts) - 1), F.size(F.filter(bounds, lambda c: c <= doc_id))))
    low, high = F.element_at(bounds, F.col("_place")), F.element_at(bounds, F.col("_place") + 1)
    share = (doc_id.cast("double") - low) / (high.cast("double") - low)
    part = F.greatest(F.lit(0), F.least(F.lit(finer - 1), F.floor(share * finer)))
    out = docs.withColumn("_place", place)
    return out.withColumn("bucket", F.when(doc_id.isNull(), F.lit(-1)).otherwise(
        F.col("_place") * finer + part).cast("long")).drop("_place")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) with the ``next_text``: that of the document that follows in descending
    order of doc_id (the first after the last).

    Neighbours lie in one bucket of ids, and a copy of the first row of the bucket below (of the
    topmost for the lowest) closes each bucket, so that one exchange by bucket does.
    """
    placed = _bucketed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    below, topmost = Window.orderBy("bucket").rowsBetween(-1, -1), Window.orderBy(F.desc("bucket"))
    ends = heads.select(
        F.col("bucket").alias("goes_to"),
        F.coalesce(F.first("bucket").over(below), F.first("bucket").over(topmost)).alias("comes_from"))
    ends = ends.join(heads, F.col("comes_from") == F.col("bucket")).select("goes_to", "comes_from", "head")
    closing = placed.join(ends, (F.col("bucket") == F.col("comes_from")) & F.col("doc_id").eqNullSafe(F.col("head")))
    closing = closing.select("doc_id", "text", F.col("goes_to").alias("bucket"), F.lit(True).alias("closing"))
    rows = placed.withColumn("closing", F.lit(False)).unionByName(closing)
    order = Window.partitionBy("bucket").orderBy("closing", F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    return rows.where(~F.col("closing")).drop("bucket", "closing")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    in_edited, in_next) per row of ``docs`` (doc_id, text).

    The edited text ends in the beginning of the next document, in descending order of doc_id, in place
    of its own last third. A NULL text is empty; an empty text has an empty fingerprint, which is like
    another empty one and unlike all others; rows that share a doc_id follow each other by text, and
    those without one come last; an only document is its own next; an empty table gives no rows; other
    columns are ignored.
    """
    # All sketches are made after the exchange: to make one twice costs less than to send it.
    rows = with_next(docs)
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("gone", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("gone")),
        F.substring(F.col("next_text"), F.lit(1), F.col("gone"))))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"),
                       sketch(F.col("next_text")).alias("next_own"), sketch(F.col("edited")).alias("theirs"))
    own, edited, following = F.col("own"), F.col("theirs"), F.col("next_own")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"),
        likeness(own, following).alias("near_next"), containment(own, edited).alias("in_edited"),
        containment(own, following).alias("in_next"))

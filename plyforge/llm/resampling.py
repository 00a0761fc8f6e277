"""Importance resampling towards a target collection, by hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.llm import ngram_table, sharding
from plyforge.llm.common import CRC_SQL, crc32_sql, small_batches, written

BUCKETS = 10_000
LONGEST = 2  # words of the longest n-gram
PERCENT = 25  # of the documents with enough words that are drawn
LEAST_WORDS = 20
SEED = 7
BATCH_LETTERS = 1 << 22  # texts of a task are worked on together up to about this many letters


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task in larger batches, so that more of a batch's n-grams are repeats of one slot."""
    held, letters = [], 0
    for frame in frames:
        held.append(frame)
        letters += int(frame["text"].str.len().sum())
        if letters >= BATCH_LETTERS:
            yield pd.concat(held, ignore_index=True)
            held, letters = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _texts(frame: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in frame["text"]]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all rows of ``texts`` (text): each task adds up its own texts and hands on one row
    per bucket at most."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for frame in _gathered(frames):
            total += ngram_table.bucket_counts(_texts(frame), longest, buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    small_batches(texts)
    return texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The gain of every bucket: a thousand times the logarithm of how much likelier its n-grams are in
    ``target`` than in ``docs``, both smoothed by one, rounded down. The driver gets the two counts per
    bucket, so ``buckets`` rows at most of either table."""
    held = []
    for texts in (docs, target):
        counts = np.zeros(buckets, np.int64)
        for row in bucket_counts(texts, buckets, longest).collect():
            counts[row["bucket"]] = row["n"]
        held.append(counts.tolist())
    (s, t), (all_s, all_t) = held, (sum(h) for h in held)
    return np.array([
        math.floor(1000 * math.log((b + 1.0) * (all_s + float(buckets)) / ((a + 1.0) * (all_t + float(buckets))))) for a, b in zip(s, t)
    ], np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the hash of seed and doc_id; a NULL doc_id counts as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text), by the gains of
    `gains`."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _gathered(frames):
            words, grams, total = ngram_table.gain_sums(_texts(frame), longest, gain)
            weight = np.where(grams > 0, total // np.maximum(grams, 1), 0)  # rounds down, below zero too
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": words, "n_features": grams, "weight": weight})

    small_batches(docs)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    # Whole numbers travel as text: pandas would turn those beside a NULL into doubles.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(score, "doc_id string, n_words long, n_features long, weight long")
    out = out.withColumn("doc_id", F.col("doc_id").cast(kind))
    return out.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, score and whatever else, stored) with ``rank``: 1 for the highest score
    among the documents with ``least_words`` words, and so on for ``percent`` of them, rounded down; NULL for
    all others. Ties go to the smaller doc_id, a NULL one first; rows alike in both stand side by side.

    Ranks are places in range partitions plus the rows of those before, so that no task orders all rows.
    """
    enough = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    ordered = sharding.in_order(scored.where(enough).withColumn("_down", -F.col("score")), "_down", "doc_id")
    before = sharding.part_totals(ordered.select("_at", F.lit(1).alias("size"))).select("_part", "_from", "_total")
    before = F.broadcast(before)  # one row per range partition
    placed = ordered.withColumn("_part", F.shiftright("_at", sharding.PART)).join(before, "_part")
    rank = F.col("_from") + F.col("_at").bitwiseAND(F.lit((1 << sharding.PART) - 1)) + 1
    most = F.call_function("div", F.col("_total") * percent, F.lit(100))
    placed = placed.withColumn("rank", F.when(rank <= most, rank)).drop("_down", "_at", "_part", "_from", "_total")
    return placed.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text); ``target`` (text)
    is what the drawn documents should be like.

    Words are runs of letters beyond ASCII, a-z, A-Z (as a-z) and digits; features are all runs of 1 to
    ``longest`` of them, and those of one batch are interned in a table of NumPy arrays (`ngram_table`), in
    which hash, bytes, bucket and count of each are looked up once. A NULL or empty text has no feature and
    weight 0; long texts are interned by windows of words; a NULL doc_id draws its noise as empty text would;
    repeated rows each have a rank; without documents there are no rows, without target texts all gains
    follow from the documents alone; other columns are ignored.
    """
    gain = gains(docs, target, buckets, longest)
    scored = written(weigh(docs, gain, longest, seed), "resample-scores")
    return draw(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def resampled_documents(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn documents with all their columns. Rows that share a doc_id are drawn together if any is."""
    drawn = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_id"]), "left_semi")


#: The same in SQL, with the values of the parameters above.
RESAMPLE_SQL = rf"""
WITH {CRC_SQL},
worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, 0 AS wanted FROM documents
  UNION ALL
  SELECT -row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1 FROM benchmark),
grams AS (
  SELECT r, doc_id, wanted, len(w) AS n_words,
         list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM worded),
each AS (SELECT r, wanted, unnest(f) AS f FROM grams),
hashed AS (SELECT f, {crc32_sql('f')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM each), crc),
counted AS (
  SELECT bucket, sum(1 - wanted)::DOUBLE AS s, sum(wanted)::DOUBLE AS t FROM each JOIN hashed USING (f) GROUP BY bucket),
gained AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}.0::DOUBLE)
                                 / ((s + 1) * (sum(t) OVER () + {BUCKETS}.0::DOUBLE)))) AS gain FROM counted),
weighed AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM each JOIN hashed USING (f) JOIN gained USING (bucket) WHERE wanted = 0 GROUP BY r),
scored AS (
  SELECT g.r, doc_id, n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substring(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM grams g LEFT JOIN weighed w ON g.r = w.r WHERE wanted = 0),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

"""Vocabulary and encoded rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.functions.core import alnum_tokens, words
from plyforge.operators import shaping as S
from plyforge.queries.evaluation import ALNUM
from plyforge.queries.joins import WORDS
from plyforge.queries.registry import documents, query, table
from plyforge.queries.standins import SQL_PAIRS, turn_pairs
from plyforge.session import scratch_path, stored
from plyforge.sources import sinks

SIZE, LENGTH = 2000, 64

SQL_VOCAB = f"""
tok AS (SELECT unnest({ALNUM.format('text')}) AS token FROM documents),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 2 AS id FROM (SELECT token, count(*) AS n FROM tok GROUP BY token) ORDER BY n DESC, token LIMIT {SIZE})"""


@query(f"WITH {SQL_VOCAB} SELECT token, n, CAST(id AS BIGINT) AS id FROM vocab")
def vocabulary(spark, sf_dir):
    """The most frequent tokens of all documents with their ids."""
    rows = S.build_vocab(documents(spark, sf_dir), alnum_tokens(F.col("text")), SIZE)
    return rows.withColumn("id", F.col("id").cast("long"))


SQL_ENCODED = f"""
WITH {SQL_VOCAB}, {SQL_PAIRS},
t AS (SELECT conv_id || '_' || turn AS id, {ALNUM.format('ref')} AS p, {ALNUM.format('pred')} AS o FROM pairs),
f AS (SELECT id, len(p) AS np, list_concat(p, o, ['<eos>']) AS w FROM t),
e AS (SELECT id, np, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM f),
x AS (SELECT e.id, np, pos, CASE WHEN e.token = '<eos>' THEN 2 ELSE coalesce(vocab.id, 1) END AS tid FROM e LEFT JOIN vocab USING (token) WHERE pos <= {LENGTH}),
l AS (SELECT id, any_value(np) AS np, list(tid ORDER BY pos) AS ids FROM x GROUP BY id)
SELECT id, array_to_string(list_concat(ids, list_transform(range(0, {LENGTH} - len(ids)), lambda i: 0)), ' ') AS input_ids,
  CAST(len(ids) AS BIGINT) AS attended,
  array_to_string(list_transform(range(1, {LENGTH + 1}), lambda i: CASE WHEN i <= np OR i > len(ids) THEN -100 ELSE ids[i] END), ' ') AS labels FROM l
"""


def _encoded(spark, sf_dir, hint=None):
    # The vocabulary is small and looked at twice, so it is stored once.
    vocab = stored(S.build_vocab(documents(spark, sf_dir), alnum_tokens(F.col("text")), SIZE), "vocab")
    vocab = vocab.hint(hint) if hint else vocab
    pairs = turn_pairs(spark, sf_dir).withColumn("id", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    rows = S.encode(pairs, "id", alnum_tokens(F.col("ref")), alnum_tokens(F.col("pred")), vocab, LENGTH)
    return rows.select(
        "id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"),
        F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"))


@query(SQL_ENCODED)
def encoded_rows(spark, sf_dir):
    """Prompt and output as padded ids with masked labels; Spark sends a small vocabulary to all tasks."""
    return _encoded(spark, sf_dir)


@query(SQL_ENCODED)
def encoded_rows_by_join(spark, sf_dir):
    """The same rows with a vocabulary that is shuffled, as one too large to be sent would be."""
    return _encoded(spark, sf_dir, "merge")


@query(f"""SELECT doc_id, CAST(len({WORDS.format('text')}) AS BIGINT) AS n_words FROM documents""")
def materialized_counts(spark, sf_dir):
    """A dataset computed and saved on first use and only read afterwards."""
    path = sinks.dataset_path(scratch_path(spark, "store"), "demo/model", LENGTH, "train")

    def compute():
        return documents(spark, sf_dir).select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))

    sinks.materialize(spark, compute, path, inputs=[table(spark, sf_dir, "documents")])
    return sinks.materialize(spark, compute, path, inputs=[table(spark, sf_dir, "documents")])


@query("""SELECT user_id, count(*) AS n, sum(value) AS total FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def rematerialized_totals(spark, sf_dir):
    """Totals that are saved, then computed again as a file has come to their input, and read once more."""
    base = scratch_path(spark, "inputs")
    events = table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", "value")

    def totals():
        rows = spark.read.parquet(f"{base}/in")
        made = lambda: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        return sinks.materialize(spark, made, f"{base}/out", inputs=[rows])

    for kept in ("user_id % 2 = 0", "user_id % 2 = 1"):
        events.where(kept).write.mode("append").parquet(f"{base}/in")
        totals()
    return totals()

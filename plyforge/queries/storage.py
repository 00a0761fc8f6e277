"""Readers and writers, each over a table that is written first."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.functions.core import round_mean
from plyforge.queries.registry import query, table
from plyforge.session import scratch_path
from plyforge.sources import parts, sinks, tables
from plyforge.streaming.merge import read_answer_stream, stream_counts

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def jsonl_from_many_paths(spark, sf_dir):
    """Turns written to three folders and read back by a glob and a path together."""
    conv, base = table(spark, sf_dir, "conversations"), scratch_path(spark, "paths")
    for name, kept in (("a1", "turn = 0"), ("a2", "turn = 1"), ("rest", "turn > 1")):
        sinks.write_json(conv.where(kept), f"{base}/{name}")
    rows = tables.read_jsonl(spark, [f"{base}/a*", f"{base}/rest"], TURNS)
    return rows.select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n"))


@query("""
SELECT r_name AS folder, 'nations' AS metric, CAST(count(n_nationkey) AS DOUBLE) AS value FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL
UNION ALL SELECT r_name, 'customers', CAST(count(c_custkey) AS DOUBLE) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
  LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL
UNION ALL SELECT 'NOWHERE', NULL, NULL
""")
def experiment_folders(spark, sf_dir):
    """One result file per region, read back with a folder that has none."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    held = nations.join(table(spark, sf_dir, "customer").groupBy("c_nationkey").count(), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    per = regions.join(held, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(
        F.count("n_nationkey").cast("double").alias("nations"), F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("customers"))
    base = scratch_path(spark, "experiments")
    values = F.create_map(F.lit("nations"), F.col("nations"), F.lit("customers"), F.col("customers"))
    names = [r[0] for r in regions.select("r_name").collect()]  # one folder each, as experiments are
    for name in names:
        one = per.where(F.col("r_name") == name).select(values.alias("aggregated_metrics"))
        sinks.write_json(one.coalesce(1), f"{base}/{name}/result.json")
    folders = regions.select(F.col("r_name").alias("folder")).unionByName(spark.createDataFrame([("NOWHERE",)], "folder string"))
    found = tables.read_experiments(spark, base, folders)
    return found.select("folder", F.explode_outer("aggregated_metrics").alias("metric", "value"))


@query("""
SELECT r_name AS folder, 'Name' AS name, r_name AS value, NULL::DOUBLE AS number FROM region
UNION ALL SELECT r_name, 'Nations', CAST(count(n_nationkey) AS VARCHAR), CAST(count(n_nationkey) AS DOUBLE)
  FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL
""")
def summary_folders(spark, sf_dir):
    """One summary file per region; its header ends at the blank line."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    per = regions.join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))
    text = F.concat(F.lit("Name: "), "r_name", F.lit("\nNations: "), F.col("n").cast("string"), F.lit("\n\nLater: 1"))
    base = scratch_path(spark, "summaries")
    for name in [r[0] for r in regions.select("r_name").collect()]:
        sinks.write_text(per.where(F.col("r_name") == name).select(text.alias("value")), f"{base}/{name}/summary.txt")
    return tables.read_summary_headers(spark, base).select("folder", "name", "value", "number")


@query("SELECT conv_id, turn, len(text) AS n, 2 AS parts_at_least FROM conversations")
def appended_parts(spark, sf_dir):
    """Turns appended in two runs as part files of at most 100 rows; how many files there are is checked."""
    conv, path = table(spark, sf_dir, "conversations"), scratch_path(spark, "parts")
    sinks.write_parts(conv.where("turn % 2 = 0"), path, 100)
    sinks.write_parts(conv.where("turn % 2 = 1"), path, 100)
    rows = tables.read_jsonl(spark, path, TURNS)
    held = spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).groupBy("file").count()
    fits = held.agg(F.when((F.max("count") <= 100) & (F.count("*") >= 2), 2).otherwise(0).alias("parts_at_least"))
    return rows.withColumn("k", F.lit(1)).join(fits.withColumn("k", F.lit(1)), "k").select(
        "conv_id", "turn", F.char_length("text").cast("long").alias("n"), "parts_at_least")


@query("""
SELECT event_type AS metric, round_even(avg(value), 4) AS value, CAST(count(*) AS BIGINT) AS samples FROM events GROUP BY event_type
""")
def written_results(spark, sf_dir):
    """Mean values and samples written as results of an experiment and read back."""
    events, path = table(spark, sf_dir, "events"), f"{scratch_path(spark, 'results')}/run_1"
    means = events.groupBy(F.col("event_type").alias("metric")).agg(round_mean(F.avg("value"), 4).alias("value"))
    counts = events.groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("correct"), F.count("*").alias("total"))
    sinks.write_results(spark, means, events.select("event_id", "event_type"), {"Samples": "events"}, path, counts)
    back = tables.read_experiments(spark, path.rsplit("/", 1)[0]).select(F.explode("aggregated_metrics").alias("metric", "value"))
    held = spark.read.schema("event_id BIGINT, event_type STRING").json(f"{path}/samples").groupBy("event_type").agg(F.count("*").alias("samples"))
    return back.join(held, F.col("metric") == F.col("event_type")).select("metric", "value", "samples")


@query("""
SELECT 'P2.' || (turn % 4) || '_' || role AS subtype, count(*) AS n FROM conversations GROUP BY ALL
""")
def running_counts(spark, sf_dir):
    """Answers per subtype, counted as they arrive in files; the last state of the counts."""
    conv, base = table(spark, sf_dir, "conversations"), scratch_path(spark, "counts")
    tid = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("w"),
                      F.concat(F.lit("P2."), (F.col("turn") % 4).cast("string")), "role")
    sinks.write_json(conv.select(tid.alias("task_id"), F.col("text").alias("input")).repartition(4, "task_id"), f"{base}/in")

    def keep(counts, batch):
        counts.write.mode("overwrite").parquet(f"{base}/out-{batch}")
        last["batch"] = batch

    last: dict[str, int] = {}
    counts = stream_counts(read_answer_stream(spark, f"{base}/in", files_per_batch=2))
    stream = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out-{last['batch']}")


@query("SELECT conv_id, turn, role, text FROM conversations")
def resumed_ranges(spark, sf_dir):
    """Turns appended by ranges of their order: one range breaks off after its files are written and is started
    again, and all are started a second time."""
    conv, path = table(spark, sf_dir, "conversations"), scratch_path(spark, "ranges")
    keyed = conv.withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    half = conv.count() // 2
    parts.stage(keyed.where("turn = 0").drop("at"), path, 100)  # what a write leaves that is never committed
    for _ in range(2):
        for start, n in ((0, half), (half, None)):
            parts.append_range(keyed, "at", path, start, n, 100)
    return parts.read_batches(spark, path, TURNS).drop("_batch")


@query("""
WITH u AS (SELECT sha256(text) AS prompt_hash, min(CASE WHEN conv_id % 3 = 0 THEN 'first ' END || role) AS a,
                  min('later ' || role) AS b FROM conversations GROUP BY 1)
SELECT prompt_hash, coalesce(a, b) AS response FROM u
""")
def extended_cache(spark, sf_dir):
    """A cache of answers extended twice, the second time with answers to all prompts; earlier ones stay."""
    conv, path = table(spark, sf_dir, "conversations"), scratch_path(spark, "cache")
    answers = lambda rows, word: rows.select(F.col("text").alias("input"), F.concat(F.lit(word), "role").alias("response"))
    parts.extend_cache(answers(conv.where("conv_id % 3 = 0"), "first "), path, "one")
    for _ in range(2):
        parts.extend_cache(answers(conv, "later "), path, "two")
    return parts.read_cache(spark, path)

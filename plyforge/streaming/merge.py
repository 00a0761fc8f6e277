"""Answers that arrive as JSON-line files: clean, drop what is already there, append."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from plyforge.functions.prompts import task_subtype
from plyforge.functions.responses import clean_explanation
from plyforge.operators.matching import drop_failed
from plyforge.sources.sinks import _exists

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MERGED_SCHEMA = "task_id STRING, input STRING, teacher_raw_output STRING, output STRING"
ANSWER_SCHEMA = "task_id STRING, input STRING, teacher_raw_output STRING, teacher_task_instruction STRING"


def clean_answers(raw: DataFrame, *keep: str) -> DataFrame:
    """DataFrame[task_id, input, teacher_raw_output, output] without failed or empty answers, and the
    columns ``keep``."""
    cleaned = raw.where(F.col("task_id").isNotNull()).select(
        "task_id", "input", "teacher_raw_output",
        clean_explanation(F.col("teacher_raw_output"), F.col("teacher_task_instruction")).alias("output"), *keep,
    )
    return drop_failed(cleaned, "teacher_raw_output", "output")


def first_answers(cleaned: DataFrame, file: str = "file") -> DataFrame:
    """One answer per task id: that of the first file by name, and of the answers in one file the first by
    its text, so that which one stays does not depend on the order in which they are read."""
    answer = F.struct(file, "teacher_raw_output", "input", "output")
    first = cleaned.groupBy("task_id").agg(F.min(answer).alias("a"))
    return first.select("task_id", "a.input", "a.teacher_raw_output", "a.output")


def read_answer_stream(spark: SparkSession, in_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Answer files as a stream. Files count as new however old their times are: copies often keep them."""
    reader = spark.readStream.schema(ANSWER_SCHEMA).option("maxFileAge", "36500d")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(in_dir)


class FirstAnswer(StatefulProcessor):
    """Hands on the first answer of a task id and remembers that it is there."""

    def init(self, handle) -> None:
        self.there = handle.getValueState("there", "yes BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.there.exists():
            return
        first = min(rows, key=lambda r: (r["file"], r["teacher_raw_output"], r["input"] is not None, r["input"] or "", r["output"]))
        self.there.update((True,))
        yield Row(task_id=key[0], input=first["input"], teacher_raw_output=first["teacher_raw_output"], output=first["output"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.there.update((True,))

    def close(self) -> None:
        pass


def merge_stream(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Merge all files that are there now and stop. Each task id is written once, over all runs: which ids are
    done is state, kept by key in the checkpoint, and the sink is not read. Only where the checkpoint is new and
    the sink is not, its ids are read once to begin with.

    Every batch writes a folder of its own, named after the query's id (a new checkpoint has a new one) and the
    batch, and writes it anew if it is run again, so that a batch that failed half way leaves nothing twice.
    """
    answers = read_answer_stream(spark, in_dir, files_per_batch).withColumn("file", F.col("_metadata.file_path"))
    known = None
    if not _exists(spark, f"{checkpoint}/metadata") and _exists(spark, out_dir):
        # The schema is given, as a first write that failed leaves a folder without files.
        known = spark.read.schema("task_id STRING").parquet(out_dir).select("task_id").groupBy("task_id")
    once = clean_answers(answers, "file").groupBy("task_id").transformWithState(
        FirstAnswer(), MERGED_SCHEMA, "Append", "None", initialState=known)

    def write(batch: DataFrame, number: int) -> None:
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        batch.write.mode("overwrite").parquet(f"{out_dir}/run={run}/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # the store that keeps state by key; read when the query starts
    try:
        return (
            once.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, before)


def merge_stream_bounded(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, delay: str = "1 hour"
) -> StreamingQuery:
    """As `merge_stream`, but repeats are only looked for within ``delay`` of an answer's arrival in the
    stream, so the state does not grow with the sink. No answer comes too late, whatever its file's time."""
    raw = read_answer_stream(spark, in_dir).withColumn("arrived", F.current_timestamp())
    cleaned = drop_failed(
        raw.withColumn(
            "output", clean_explanation(F.col("teacher_raw_output"), F.col("teacher_task_instruction"))
        ),
        "teacher_raw_output", "output",
    )
    once = cleaned.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["task_id"])
    return (
        once.select("task_id", "input", "teacher_raw_output", "output")
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_counts(df: DataFrame) -> DataFrame:
    """Running number of rows per task subtype; write with ``outputMode('update')``."""
    return df.groupBy(task_subtype(F.col("task_id")).alias("subtype")).agg(F.count("*").alias("n"))

"""Tables that grow by whole batches: part files, and a log that tells which of them count.

A batch is written to a folder of its own and then committed by one small file, which is made under the next
free number or not at all. A write that ends half way leaves files that no reader looks at; a batch that is
committed twice counts once; of two writers that want one number the second takes the next.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.functions.core import prompt_key
from plyforge.operators.ordering import slice_rows

LOG = "_log"
TRIES = 100  # writers that may come before one that commits
CACHE = "prompt_hash STRING, response STRING"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def committed(spark: SparkSession, path: str) -> list[dict]:
    """What the log holds, in order: batch, folder and rows of every committed batch."""
    fs, where = _fs(spark, f"{path}/{LOG}")
    if not fs.exists(where):
        return []
    numbers = sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))
    return [json.loads(_read(spark, f"{path}/{LOG}/{n:012d}.json")) for n in numbers]


def _read(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text under a name that is free; False if it is taken. The text is there in full
    before the name is."""
    jvm = spark._jvm
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    fs, where = _fs(spark, draft)
    stream = fs.create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    final = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.valueOf("NONE")
    try:
        context.rename(where, final, options)  # fails where the name is taken
        return True
    except Exception as failed:
        fs.delete(where, False)
        if "FileAlreadyExists" in str(failed):
            return False
        raise


def stage(df: DataFrame, path: str, rows_per_part: int | None = None, kind: str = "json") -> str:
    """Write the rows where no reader looks yet; returns the folder's name."""
    folder = f"batch-{uuid.uuid4().hex}"
    writer = df.write if rows_per_part is None else df.write.option("maxRecordsPerFile", rows_per_part)
    writer.format(kind).save(f"{path}/{folder}")
    return folder


def commit(spark: SparkSession, path: str, batch: str, folder: str, **more: object) -> bool:
    """Let a staged folder count as ``batch``. False, and nothing changes, if this batch counts already."""
    for _ in range(TRIES):
        log = committed(spark, path)
        if any(entry["batch"] == batch for entry in log):
            return False
        entry = json.dumps({"batch": batch, "folder": folder, **more})
        if _put(spark, f"{path}/{LOG}/{len(log):012d}.json", entry):
            return True
    raise RuntimeError(f"{path}: others commit without end")


def append_batch(df: DataFrame, path: str, batch: str, rows_per_part: int | None = None, kind: str = "json") -> bool:
    """The rows as part files of ``batch``, all of them or none. A batch that is there already is not written."""
    spark = df.sparkSession
    if any(entry["batch"] == batch for entry in committed(spark, path)):
        return False
    return commit(spark, path, batch, stage(df, path, rows_per_part, kind))


def read_batches(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """The rows of all committed batches; the log's place of each row's batch is ``_batch``."""
    log = committed(spark, path)
    # A batch without rows may have no file; what is not committed is not listed.
    if not log:
        return spark.createDataFrame([], T.StructType.fromDDL(schema)).withColumn("_batch", F.lit(0))
    rows = spark.read.schema(schema).format(kind).load([f"{path}/{entry['folder']}" for entry in log])
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(batch-[0-9a-f]{32})/", 1)
    order = F.create_map(*[F.lit(x) for i, entry in enumerate(log) for x in (entry["folder"], i)])
    return rows.select("*", F.element_at(order, folder).alias("_batch"))


def batch_name(start: int, n: int | None) -> str:
    """Of the rows from ``start`` on: the same for the same range."""
    return f"{start}-{'end' if n is None else start + n}"


def append_range(df: DataFrame, order: str, path: str, start: int = 0, n: int | None = None, rows_per_part: int | None = None) -> bool:
    """Rows ``start`` to ``start + n`` in the order of a key as the batch of this range, so that a job that is
    started again for a range goes on where nothing was committed and does nothing where it was."""
    name = batch_name(start, n)
    if any(entry["batch"] == name for entry in committed(df.sparkSession, path)):
        return False
    return append_batch(slice_rows(df, order, start, n), path, name, rows_per_part)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """DataFrame[prompt_hash, response] of a cache written by `extend_cache`: of several answers to a prompt the
    one that was committed first counts."""
    rows = read_batches(spark, path, CACHE, "parquet")
    first = F.min(F.struct("_batch", "response"))
    return rows.groupBy("prompt_hash").agg(first.alias("a")).select("prompt_hash", "a.response")


def extend_cache(answers: DataFrame, path: str, batch: str, prompt: str = "input", response: str = "response") -> bool:
    """Commit the answers to prompts that are not in the cache yet. Two writers may add the same prompt at one
    time; readers then take the first."""
    known = read_cache(answers.sparkSession, path).select("prompt_hash")
    new = answers.where(F.col(response).isNotNull()).groupBy(prompt_key(F.col(prompt)).alias("prompt_hash")).agg(F.min(response).alias("response"))
    return append_batch(new.join(known, "prompt_hash", "left_anti"), path, batch, kind="parquet")

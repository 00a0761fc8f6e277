"""Writers and the parameter-keyed store of computed datasets."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.session import remove_stored


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one part file per partition."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_text(df: DataFrame, path: str, column: str | None = None, mode: str = "errorifexists") -> None:
    """One line per row. Line breaks inside a value stay, as in a plain dump."""
    df.select(column or df.columns[0]).write.mode(mode).text(path)


def write_parts(df: DataFrame, path: str, rows_per_part: int) -> None:
    """Append JSON-line part files of at most ``rows_per_part`` rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_part).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One sub-folder per split value, written in one pass."""
    df.write.partitionBy(split).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def dataset_path(base: str, model: str, max_len: int, split: str, top_n: int | None = None) -> str:
    """``base/{model}_seq{L}_{split}[_topN]`` with unsafe characters of the model name replaced."""
    name = "".join(c if c.isalnum() or c in "_-" else "_" for c in model)
    return f"{base}/{name}_seq{max_len}_{split}" + (f"_top{top_n}" if top_n is not None else "")


def content_key(*inputs: DataFrame, **params: object) -> str:
    """What a computed dataset depends on: its parameters, and for each input the logical plan and the path,
    length and time of every file that it reads."""
    told: list = [{k: str(v) for k, v in sorted(params.items())}]
    for df in inputs:
        spark, files = df.sparkSession, []
        for uri in sorted(df.inputFiles()):
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            files.append([uri, status.getLen(), status.getModificationTime()])
        # Numbers given to columns differ between two runs of the same code.
        plan = re.sub(r"#\d+L?|plan_id=\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
        told.append([plan, files])
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def materialize(spark: SparkSession, compute: Callable[[], DataFrame], path: str, overwrite: bool = False,
                inputs: Sequence[DataFrame] = (), **params: object) -> DataFrame:
    """Read the dataset at ``path`` if a finished write is there that was made from the same ``inputs`` and
    parameters, else compute, save and read it.

    What it was made from is kept beside it as a key, removed before a write and written after it, so that a
    write that ends half way is made again. Without inputs and parameters only the path tells what it is.
    """
    key, beside = content_key(*inputs, **params), f"{path.rstrip('/')}.key"
    there = _exists(spark, f"{path}/_SUCCESS") and _exists(spark, f"{beside}/_SUCCESS")
    if overwrite or not there or spark.read.text(beside).first()[0] != key:
        remove_stored(spark, beside)
        compute().write.mode("overwrite").parquet(path)
        spark.range(1).select(F.lit(key).alias("value")).write.text(beside)
    return spark.read.parquet(path)


def write_results(spark: SparkSession, metrics: DataFrame, samples: DataFrame, args: dict, path: str,
                  counts: DataFrame | None = None) -> None:
    """``path/samples`` as JSON lines, ``path/metrics`` as a table, and ``path/result.json`` and
    ``path/summary.txt`` as folders with one small part each. Metrics are one row per name, so they
    fit one file; samples are not gathered.
    """
    samples.write.mode("overwrite").json(f"{path}/samples")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    metrics = spark.read.parquet(f"{path}/metrics")
    by_name = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))
    result = metrics.agg(by_name.alias("aggregated_metrics")).withColumn(
        "args", F.from_json(F.lit(json.dumps({k: str(v) for k, v in args.items()})), "map<string,string>")
    )
    result.coalesce(1).write.mode("overwrite").json(f"{path}/result.json")
    head = spark.createDataFrame(
        [(0, i, f"{k}: {v}") for i, (k, v) in enumerate(args.items())]
        + [(1, 0, ""), (1, 1, "--- Aggregated Metrics ---")],
        "section int, place int, line string",
    )
    shown = F.coalesce(F.col("value").cast("string"), F.lit("N/A"))
    body = metrics.select(F.lit(2).alias("section"), F.lit(0).alias("place"),
                          F.concat_ws(": ", "metric", shown).alias("line"))
    lines = head.unionByName(body)
    if counts is not None:
        title = spark.createDataFrame(
            [(3, 0, ""), (3, 1, "--- Rule-Based Task Counts (Correct/Total) ---")], head.schema
        )
        ratio = F.format_string("%s_counts: %d/%d", "task", "correct", "total")
        lines = lines.unionByName(title).unionByName(
            counts.where("total > 0").select(F.lit(4).alias("section"), F.lit(0).alias("place"), ratio.alias("line"))
        )
    ordered = lines.coalesce(1).sortWithinPartitions("section", "place", "line")
    ordered.select("line").write.mode("overwrite").text(f"{path}/summary.txt")

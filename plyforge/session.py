"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plyforge", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC timestamps switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in storage that the session names and all executors share: ``spark.checkpoint.dir``,
    else the warehouse. The code never picks a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove_stored(spark: SparkSession, path: str) -> bool:
    """Delete a stored table that is no longer read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(df: DataFrame, rows: int = 256) -> None:
    """Let the session hand at most ``rows`` rows at a time to Python. Texts may be long: the default of
    10,000 takes hundreds of megabytes off the heap and again in each Python worker. Results do not depend
    on it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > rows:
        conf.set(name, str(rows))


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """Share the rows of a scan that has fewer pieces than there are cores, by the hash of ``keys``.

    A table of many files is left as it is. ``like`` is the scan to look at where ``df`` itself has
    been joined already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if (df if like is None else like).rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back: computed once, and safe when
    executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

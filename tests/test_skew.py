"""Joins of keys that half of all rows have."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plyforge.operators import matching as J
from plyforge.operators import skew


@pytest.fixture
def many_tasks(spark):
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_frequent_keys(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 11 == 1, F.lit(None)).when(F.col("id") % 10 == 1, 8).otherwise(F.col("id")).alias("k"))
    named = df.select("k", F.xxhash64("k").alias("_hot")).distinct().join(skew.frequent_keys(df, ["k"], 16), "_hot")
    found = {r["k"]: r["_shares"] for r in named.collect()}
    assert found[7] == -(-5001 * 16 * skew.FINE // 10_000) and set(found) <= {7, 8}
    assert skew.frequent_keys(spark.range(0), ["id"], 8).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_hot_position_is_many_tasks(spark, many_tasks, how):
    """Half of the rows have one key: no task has more than twice the rows of the middle one, and the rows are
    those of a plain join."""
    left = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 3001).alias("pos"), "id").withColumn(
        "pos", F.when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.col("pos")))
    right = spark.range(3000).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("score"))
    joined = skew.spread_join(left, right, ["pos"], how)
    held = sorted(Counter(r[0] for r in joined.select(F.spark_partition_id()).collect()).values())
    plain = left.join(right, "pos", how)
    assert joined.columns == plain.columns
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0
    assert held[-1] <= 2 * held[len(held) // 2]
    worst = sorted(Counter(r[0] for r in plain.select(F.spark_partition_id()).collect()).values())
    assert worst[-1] > 5 * worst[len(worst) // 2]


def test_engine_facts_of_a_hot_position(spark):
    preds = spark.createDataFrame([(1, "a", "b")] * 300 + [(2, "b", "a"), (None, "a", "a"), (3, None, "b")], "pos_id int, move string, reference string")
    engine = spark.createDataFrame([(1, 1, "a", 10), (1, 2, "b", 5), (2, 1, "b", 1)], "pos_id int, rank int, move string, score int")
    for attach in (lambda s: J.attach_engine(preds, engine, [1, 2], spread=s), lambda s: J.attach_move_scores(preds, engine.select("pos_id", "move", "score"), spread=s)):
        plain, spread = attach(False), attach(True)
        assert plain.columns == spread.columns
        assert Counter(map(str, plain.collect())) == Counter(map(str, spread.collect()))


def test_criteria_with_a_constant_first_column(spark):
    """All experiments agree in the first close column; candidate pairs stay few."""
    exps = spark.range(400).select(F.format_string("e%04d", "id").alias("folder"), F.lit(1.0).alias("a"), (F.col("id") * 0.5).cast("double").alias("b"))
    crit = spark.range(200).select("id", F.lit(1.0).alias("a"), (F.col("id") * 1.0 + 1e-7).alias("b"))
    found = J.match_criteria(crit, exps, "id", ["a", "b"], [])
    assert {r["id"]: r["folder"] for r in found.collect()} == {i: f"e{2 * i:04d}" if i else None for i in range(200)}

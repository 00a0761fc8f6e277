"""Batches that count whole or not at all, caches that grow, datasets that notice their inputs."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from plyforge.functions.core import prompt_key
from plyforge.sources import parts, sinks

ROW = "id LONG, v STRING"


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], ROW)


def test_a_batch_counts_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    assert parts.read_batches(spark, path, ROW).count() == 0
    assert parts.append_batch(rows(spark, 1, 2), path, "a")
    parts.stage(rows(spark, 3, 4), path)  # a write that was killed before its commit
    assert sorted(r["id"] for r in parts.read_batches(spark, path, ROW).collect()) == [1, 2]
    assert parts.append_batch(rows(spark, 3, 4), path, "b") and not parts.append_batch(rows(spark, 3, 4), path, "b")
    # A commit that is repeated after it was made changes nothing either.
    assert not parts.commit(spark, path, "a", parts.stage(rows(spark, 1, 2), path))
    got = parts.read_batches(spark, path, ROW).collect()
    assert sorted((r["id"], r["_batch"]) for r in got) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_a_broken_write_is_taken_up_again(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "out"), parts._put
    df = spark.range(100).selectExpr("id", "'x' v").repartition(3)
    monkeypatch.setattr(parts, "_put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        parts.append_range(df, "id", path, 0, 40, 7)
    monkeypatch.setattr(parts, "_put", real)
    for start, n in ((0, 40), (0, 40), (40, 40), (80, None)):
        parts.append_range(df, "id", path, start, n, 7)
    got = parts.read_batches(spark, path, ROW)
    assert sorted(r["id"] for r in got.collect()) == list(range(100))
    assert [e["batch"] for e in parts.committed(spark, path)] == ["0-40", "40-80", "80-end"]


def test_writers_at_one_time_take_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "out")
    folders = [parts.stage(rows(spark, i), path) for i in range(6)]
    threads = [threading.Thread(target=parts.commit, args=(spark, path, f"b{i % 5}", f)) for i, f in enumerate(folders)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = parts.committed(spark, path)
    assert len({e["folder"] for e in log}) == len(log) and {e["batch"] for e in log} == {f"b{i}" for i in range(5)}
    assert not parts._put(spark, f"{path}/{parts.LOG}/{0:012d}.json", "taken") and json.loads(parts._read(spark, f"{path}/{parts.LOG}/{0:012d}.json"))


def test_the_cache_keeps_first_answers(spark, tmp_path):
    path = str(tmp_path / "cache")
    answers = lambda *r: spark.createDataFrame(r, "input STRING, response STRING")
    assert parts.extend_cache(answers(("p", "b"), ("p", "a"), ("q", None)), path, "1")
    assert parts.extend_cache(answers(("p", "z"), ("r", "c")), path, "2")
    # A writer that did not see the second batch.
    late = answers(("r", "late")).select(prompt_key(F.col("input")).alias("prompt_hash"), "response")
    assert parts.append_batch(late, path, "3", kind="parquet")
    got = {r["prompt_hash"]: r["response"] for r in parts.read_cache(spark, path).collect()}
    keys = {r["input"]: r["k"] for r in answers(("p", ""), ("r", "")).select("input", prompt_key(F.col("input")).alias("k")).collect()}
    assert got == {keys["p"]: "a", keys["r"]: "c"}


def test_a_changed_input_is_computed_again(spark, tmp_path):
    path, src, calls = str(tmp_path / "out"), str(tmp_path / "in"), []

    def made(least=0, **params):
        df = spark.read.parquet(src).where(f"id >= {least}")

        def compute():
            calls.append(1)
            return df

        return sorted(r[0] for r in sinks.materialize(spark, compute, path, inputs=[df], **params).collect())

    spark.range(3).write.parquet(src)
    assert made() == made() == [0, 1, 2] and len(calls) == 1
    spark.range(3, 5).write.mode("append").parquet(src)
    assert made() == made() == [0, 1, 2, 3, 4] and len(calls) == 2
    assert made(least=2) == [2, 3, 4] and len(calls) == 3
    assert made(least=2, size=1) == [2, 3, 4] and made(least=2, size=1) == [2, 3, 4] and len(calls) == 4
    # A write that ended before its key was there is made again.
    from plyforge.session import remove_stored
    remove_stored(spark, f"{path}.key")
    assert made(least=2, size=1) == [2, 3, 4] and len(calls) == 5

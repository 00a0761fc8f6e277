"""Shards against plain prefix sums."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plyforge.llm import sharding


def simple_shards(rows, shards):
    """(doc_id, size, crc, shard, slot) of (doc_id, text), by one pass over the sorted rows."""
    key = lambda r: hashlib.md5((r[1] or "").encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (key(r), r[0] is not None, r[0] or 0))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, starts, at = sum(sizes), [], 0
    for s in sizes:
        starts.append(at)
        at += s
    groups = {}
    for r, s, a in zip(rows, sizes, starts):
        first, held = groups.get(key(r), (a, 0))
        groups[key(r)] = (first, held + s)
    out, slots = [], [0] * shards
    for r, s, a in zip(rows, sizes, starts):
        first, held = groups[key(r)]
        middle = 2 * first + held if held <= max(sizes) else 2 * a + s
        shard = min(shards - 1, middle * shards // (2 * total))
        out.append((r[0], s, zlib.crc32((r[1] or "").encode()), shard, slots[shard]))
        slots[shard] += 1
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def tables():
    rng = random.Random(3)
    mixed = [(rng.choice([None, *range(60)]), rng.choice(["", None, "same text", "über " * rng.randint(1, 400), "x" * rng.randint(0, 900)])) for _ in range(400)]
    hot = [(i, "copy of one text that a third of all rows hold") for i in range(300)] + [(i, f"own {i}") for i in range(600)]
    return {"mixed": mixed, "hot": hot, "equal rows": [(None, None)] * 200, "few": [(1, "a"), (2, "b" * 5000)]}


@pytest.mark.parametrize("kind", tables())
@pytest.mark.parametrize("shards", [1, 8, 50])
def test_shards_by_bytes(spark, kind, shards):
    rows = tables()[kind]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in sharding.shard_sizes(docs, shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert order(got) == order(simple_shards(rows, shards))
    total, largest = sum(r[1] for r in got), max(r[1] for r in got)
    for k in range(shards):
        assert abs(sum(r[1] for r in got if r[3] == k) - total / shards) <= largest
        assert sorted(r[4] for r in got if r[3] == k) == list(range(sum(r[3] == k for r in got)))


def test_awkward_documents(spark, docs, rows, none):
    got = sharding.shard_documents(docs.withColumn("Shard", F.lit("own")).withColumn("group", F.lit(1)), 4)
    assert got.columns == [*docs.columns, "group", "shard", "slot"]
    want = order([(r[0], r[3], r[4]) for r in simple_shards([(r[1], r[2]) for r in rows], 4)])
    assert order([(r["doc_id"], r["shard"], r["slot"]) for r in got.collect()]) == want
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(r[1], r[2]) for r in rows}
    assert sharding.shard_sizes(none).count() == 0 and sharding.shard_documents(none).count() == 0


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i // 4} " * 9) for i in range(2000)]
    got = sharding.shard_sizes(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"))
    # Five rows are larger together than the largest row: such groups lie in one shard or in two neighbours.
    assert got.where("n > 2").count() == 0 and got.where("n = 2").count() <= 7


def test_written_shards_keep_their_order(spark, docs, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, "shard", "slot"}
    for k in range(3):
        slots = [r[0] for r in back.where(F.col("shard") == k).select("slot").collect()]
        assert sorted(slots) == list(range(len(slots)))

import collections
import random

import pytest
from pyspark.sql import functions as F

from plyforge.functions.core import hash01
from plyforge.operators import games as G
from plyforge.operators import ordering as O


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
@pytest.mark.parametrize("text", [False, True])
def test_global_index(spark, buckets, text):
    keys = random.Random(buckets).sample(range(10_000), 500)
    keys = [f"k{k}" for k in keys] if text else keys
    df = spark.createDataFrame([(k,) for k in keys], ["key"]).repartition(5)
    got = {r["key"]: r["idx"] for r in O.global_index(df, "key", ranges=buckets).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_global_index_of_few_rows(spark):
    assert O.global_index(spark.range(0), "id").collect() == []
    assert O.global_index(spark.range(1), "id").first()["idx"] == 0


def test_slices(spark):
    df = spark.range(100).repartition(3)
    assert [r[0] for r in O.slice_rows(df, "id", 90, 30).collect()] == list(range(90, 100))
    assert [r[0] for r in O.slice_rows(df, "id", -5, 3).collect()] == [0, 1, 2]
    assert O.slice_rows(df, "id", 40).count() == 60
    assert O.slice_rows(df, "id", 200, 5).count() == 0


@pytest.mark.parametrize("n", [2, None])
def test_a_null_key_comes_first(spark, n):
    df = spark.createDataFrame([(2, "b"), (None, "x"), (1, "a"), (3, "c")], "id int, v string")
    assert [r["v"] for r in O.slice_rows(df, "id", 0, n).collect()] == ["x", "a", "b", "c"][:n]


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 3)
    got = {r["id"]: r["idx"] for r in O.global_index(spark.range(5000).repartition(7), "id").collect()}
    assert got == {i: i for i in range(5000)}


def test_sample_n(spark):
    want = [r[0] for r in O.shuffle(spark.range(200), "id", 7).collect()][:20]
    assert [r[0] for r in O.sample_n(spark.range(200).repartition(3), "id", 20, 7).collect()] == want


@pytest.mark.parametrize("n, seed", [(0, 1), (1, 2), (9, 0), (10, 3), (399, 5)])
def test_split_sizes(spark, n, seed):
    got = O.split_exact(spark.range(n), "id", seed=seed)
    sizes = collections.Counter(r["split"] for r in got.collect())
    assert sizes["train"] == int(0.8 * n) and sizes["val"] == int(0.1 * n) and sum(sizes.values()) == n


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(300)
    a = {r["id"]: r["split"] for r in O.split_exact(df, "id").collect()}
    b = {r["id"]: r["split"] for r in O.split_exact(df.repartition(7), "id").collect()}
    assert a == b


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(2000)
    a = {r[0] for r in O.sample_by_hash(df, ["id"], 0.25, 1, "r").collect()}
    assert a == {r[0] for r in O.sample_by_hash(df.repartition(9), ["id"], 0.25, 1, "r").collect()}
    assert 400 < len(a) < 600
    assert a != {r[0] for r in O.sample_by_hash(df, ["id"], 0.25, 1, "other").collect()}
    low, high = df.select(F.min(hash01(1, "r", F.col("id"))), F.max(hash01(1, "r", F.col("id")))).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1


def hot_rows(n_hot=700):
    rng = random.Random(5)
    rows = [("hot", i, "m" if rng.random() < 0.7 else None) for i in range(n_hot)]
    rows += [(f"g{g}", i, "m" if rng.random() < 0.7 else None) for g in range(30) for i in range(rng.randint(1, 20))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [3, 64, 4096])
def test_half_move_index_with_a_hot_group(spark, chunk):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, o int, uci string")
    got = {(r["g"], r["o"]): r["half_move"] for r in G.half_move_index(df, "g", "o", "uci", chunk=chunk).collect()}
    seen = collections.Counter()
    for g, o, u in sorted(rows, key=lambda r: (r[0], r[1])):
        assert got[g, o] == seen[g]
        seen[g] += u is not None
    assert len(got) == len(rows)


@pytest.mark.parametrize("chunk, n", [(10, 10), (16, 4), (4096, 10), (1, 1), (4, 12)])
def test_history_with_a_hot_group(spark, chunk, n):
    rows = [(g, o, f"{g}{o}") for g, o, _ in hot_rows(200)]
    df = spark.createDataFrame(rows, "g string, o int, t string")
    got = {(r["g"], r["o"]): r["history"] for r in G.recent_history(df, "g", "o", "t", n, chunk=chunk).collect()}
    assert len(got) == len(rows)
    for g, o, _ in rows:
        assert got[g, o] == " ".join(f"{g}{i}" for i in range(max(0, o - n), o))


def test_game_number_and_first_per_source(spark):
    df = spark.createDataFrame([(g, i) for g in ("b", "a", "c") for i in range(3)], "g string, i int")
    got = {(r["g"], r["game_no"]) for r in O.game_number(df, "g").collect()}
    assert got == {("a", 1), ("b", 2), ("c", 3)}
    assert O.first_per_source(df, "g", "i", 2).count() == 6


def test_shuffle_is_a_permutation(spark):
    df = spark.range(50)
    a, b = ([r[0] for r in O.shuffle(x, "id", 3).collect()] for x in (df, df.repartition(4)))
    assert a == b and sorted(a) == list(range(50)) and a != list(range(50))


KEYED = [(1, "a"), (1, "a"), (1, "b"), (None, "x"), (None, "y"), (None, "x"), (2, "c"), (3, None), (2, "c"), (1, "a")]


def test_repeated_and_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame(KEYED, "k int, v string").repartition(3)
    rows = O.global_index(df, "k", total="n").collect()
    assert sorted(r["idx"] for r in rows) == list(range(10)) and {r["n"] for r in rows} == {10}
    assert sorted((str(r["k"]), str(r["v"])) for r in rows) == sorted((str(k), str(v)) for k, v in KEYED)
    keys = [r["k"] for r in sorted(rows, key=lambda r: r["idx"])]
    assert keys == [None] * 3 + [1] * 4 + [2] * 2 + [3]
    # The order does not depend on how the rows are dealt.
    again = {(r["idx"], r["k"], r["v"]) for r in O.global_index(df.repartition(7), "k", ranges=5).collect()}
    assert again == {(r["idx"], r["k"], r["v"]) for r in rows}
    assert [r["k"] for r in O.slice_rows(df, "k", 0, 3).collect()] == [None] * 3
    assert [r["k"] for r in O.slice_rows(df, "k", 2, 4).collect()] == [None, 1, 1, 1]
    assert O.sample_n(df, "k", 4, 7).count() == 4 and O.sample_n(df, "k", 40, 7).count() == 10


def test_split_writes_each_row_once(spark):
    df = spark.createDataFrame(KEYED, "k int, v string").withColumn("m", F.create_map(F.lit("a"), "v")).repartition(3)
    rows = O.split_exact(df, "k").collect()
    assert collections.Counter(r["split"] for r in rows) == {"train": 8, "val": 1, "test": 1}
    assert sorted((str(r["k"]), str(r["v"])) for r in rows) == sorted((str(k), str(v)) for k, v in KEYED)
    one_key = O.split_exact(spark.range(50).select(F.lit(7).alias("k"), "id"), "k").collect()
    assert sorted(r["id"] for r in one_key) == list(range(50)) and sum(r["split"] == "train" for r in one_key) == 40


def test_game_number_of_a_null_key(spark):
    df = spark.createDataFrame(KEYED, "k int, v string")
    got = sorted((r["game_no"], r["k"]) for r in O.game_number(df, "k").collect())
    assert got == [(1, None)] * 3 + [(2, 1)] * 4 + [(3, 2)] * 2 + [(4, 3)]

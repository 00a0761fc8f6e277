"""Joins: caches, resume, alignment, criteria and engine facts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions.core import prompt_key
from plyforge.operators.ordering import global_index, running_count
from plyforge.operators.skew import spread_join
from plyforge.session import stored


def probe_cache(prompts: DataFrame, cache: DataFrame, prompt: str = "input") -> tuple[DataFrame, DataFrame]:
    """(rows with their cached ``response``, distinct prompts that still need one)."""
    keyed = prompts.withColumn("prompt_hash", prompt_key(F.col(prompt)))
    hits = keyed.join(cache.select("prompt_hash", "response"), "prompt_hash")
    # Copies of a prompt are merged before the join, so a prompt with very many is joined once.
    misses = keyed.select("prompt_hash", prompt).distinct().join(cache, "prompt_hash", "left_anti")
    return hits, misses


def extend_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers added; a prompt that is already there keeps its answer."""
    once = answers.groupBy("prompt_hash").agg(F.min("response").alias("response"))
    return cache.select("prompt_hash", "response").unionByName(once.join(cache, "prompt_hash", "left_anti"))


def pending(df: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def align(samples: DataFrame, predictions: DataFrame, on: str = "sample_id", raw: str = "raw") -> DataFrame:
    """Samples with their prediction, or the error mark where there is none."""
    joined = samples.join(predictions.select(on, raw), on, "left")
    return joined.withColumn(raw, F.coalesce(F.col(raw), F.lit(K.GENERATION_ERROR)))


def drop_failed(df: DataFrame, raw: str, clean: str) -> DataFrame:
    return df.where((F.col(raw) != K.GENERATION_ERROR) & (F.col(clean) != ""))


def cross_inputs(df: DataFrame, models: list[str] | DataFrame, name: str = "model") -> DataFrame:
    """Every input once per model. A list of names becomes a constant array. Of a table of models (its
    first column) the names are gathered into one row that is joined on a constant; none reaches the
    driver."""
    if not isinstance(models, DataFrame):
        return df.withColumn(name, F.explode(F.array(*[F.lit(m) for m in models])))
    listed = models.select(F.col(models.columns[0]).alias("_m")).agg(F.collect_list("_m").alias("_models"))
    listed = listed.withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(listed, "_one").drop("_one")
    return joined.withColumn(name, F.explode("_models")).drop("_models")


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    bits = values.view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _double(numbers: np.ndarray) -> np.ndarray:
    """The doubles of `_ordered` numbers."""
    return np.where(numbers < 0, np.int64(-(2**63)) - numbers, numbers).view(np.float64)


def reach(wanted: np.ndarray, rtol: float, atol: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest double that `is_close` finds near each wanted value; the first is above the second
    where there is none. What is near lies in one piece, as rounded differences rise with the value, so that either
    end is found by halving; as in Spark, NaN is above all numbers and equal to itself."""
    with np.errstate(all="ignore"):
        c = np.asarray(wanted, np.float64) + 0.0  # no negative zero
        t = atol + rtol * np.abs(c)
        finite = np.isfinite(c)
        middle = _ordered(np.where(finite, c, 0.0))
        ends = []
        for far in (-np.inf, np.inf):
            near, out = middle.copy(), np.full(len(c), _ordered(np.array([far]))[0])
            for _ in range(64):
                # The mean of two numbers whose sum may be too large.
                half = (near >> 1) + (out >> 1) + (near & out & 1)
                half = np.where(half == near, out, half)
                fits = np.abs(_double(half) - c) <= t
                near, out = np.where(fits, half, near), np.where(fits, out, half)
            ends.append(np.where(t == np.inf, far, _double(near)))
        low, high = ends
        most = np.finfo(np.float64).max
        low = np.where(finite, low, np.where(c == -np.inf, -most, -np.inf))
        high = np.where(finite, high, np.where(c == np.inf, most, np.inf))
        none, every = finite & (t < 0), np.isnan(t)
        return np.where(every, -np.inf, np.where(none, np.inf, low)), np.where(every, np.nan, np.where(none, -np.inf, high))


def _spans(wanted: DataFrame, known: DataFrame, k: str, rtol: float, atol: float) -> tuple[DataFrame, DataFrame]:
    """Of one close column: (value, _first, _last) of the wanted values, the places of the first and last known value
    that are near, for those with any; and (value, _at) of the known values. Places count distinct known values in
    their order."""

    @F.pandas_udf("low double, high double")
    def ends(c: pd.Series) -> pd.DataFrame:
        low, high = reach(c.to_numpy(np.float64), rtol, atol)
        return pd.DataFrame({"low": low, "high": high})

    def values(rows: DataFrame) -> DataFrame:
        # Adding zero makes a negative zero a plain one.
        return rows.select((F.col(k).cast("double") + 0.0).alias("value")).where("value IS NOT NULL").distinct()

    # Where values are equal, a low end comes before a known value and a high end after it.
    asked = values(wanted).withColumn("end", ends("value")).select("value", F.explode(F.array(
        F.struct(F.col("end.low").alias("place"), F.lit(0).alias("kind")), F.struct(F.col("end.high").alias("place"), F.lit(2).alias("kind")))).alias("p"))
    points = asked.select("value", "p.*").unionByName(values(known).select("value", F.col("value").alias("place"), F.lit(1).alias("kind")))
    points = stored(points.withColumn("known", F.col("kind") == 1), "points")
    counted = running_count(points, ["place", "kind", "value"], "known")
    spans = counted.where("kind <> 1").groupBy("value").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("_first"), (F.max(F.when(F.col("kind") == 2, F.col("n"))) - 1).alias("_last"))
    return spans.where("_first <= _last"), counted.where("kind = 1").select("value", (F.col("n") - 1).alias("_at"))


def _node(level: Column, number: Column) -> Column:
    return F.shiftleft(level.cast("long"), 56).bitwiseOR(number)


def _covering(first: Column, last: Column) -> Column:
    """The blocks that make up the places ``first`` to ``last``: two at most of each size 1, 2, 4 and so on, a block
    of a size beginning at a multiple of it."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low = F.call_function("shiftright", first + size - 1, level)
        high = F.call_function("shiftright", last + 1, level)
        odd = lambda n: (low < high) & (n.bitwiseAND(F.lit(1)) == 1)
        return F.array(F.when(odd(low), _node(level, low)), F.when(odd(high), _node(level, high - 1)))

    levels = F.sequence(F.lit(0), F.length(F.bin(last - first + 1)) - 1)
    return F.array_compact(F.flatten(F.transform(levels, at)))


def match_criteria(
    criteria: DataFrame, experiments: DataFrame, id: str, close: list[str], exact: list[str],
    folder: str = "folder", rtol: float = 1e-5, atol: float = 1e-8,
) -> DataFrame:
    """For each criterion the first experiment by folder name whose values match: ``close`` columns (compared as
    doubles) within a tolerance taken from the criterion, ``exact`` ones equally. No match leaves NULL.

    What is near a criterion in a column are neighbours in the order of the experiments' values there. Experiments
    are entered, with the least number of a folder, into the blocks of 1, 2, 4 and so on neighbours that hold them,
    and a criterion looks up the few blocks that make up its neighbours: their least is the answer, and no criterion
    meets the experiments one by one, however many are near. Rows are as many as experiments and criteria, times
    the number of block sizes at most (twice that for criteria) for each close column. Equal experiments and equal
    criteria are merged first; folders are compared as numbers, which take little room.
    """
    named = global_index(experiments.select(F.col(folder).alias("_folder")).where("_folder IS NOT NULL").distinct(), "_folder", "_number")
    keys = [f"_key_{i}" for i in range(len(exact))]
    known = experiments.select(F.col(folder).alias("_folder"), *[F.col(x).alias(k) for x, k in zip(exact, keys)], *close).join(named, "_folder")
    known = known.groupBy(*keys, *close).agg(F.min("_number").alias("_number"))
    wanted = criteria.select(*[F.col(x).alias(k) for x, k in zip(exact, keys)], *close).distinct()
    nodes = [f"_node_{i}" for i in range(len(close))]
    c, e = wanted, known
    for k, at in zip(close, nodes):
        spans, places = _spans(wanted, known, k, rtol, atol)
        levels = spans.agg(F.max(F.length(F.bin(F.col("_last") - F.col("_first") + 1)))).first()[0] or 1
        blocks = F.array(*[_node(F.lit(h), F.shiftright("_at", h)) for h in range(levels)])
        same = F.col(k).cast("double") + 0.0 == F.col("value")
        c = c.join(spans, same).withColumn(at, F.explode(_covering(F.col("_first"), F.col("_last")))).drop("value", "_first", "_last")
        e = e.join(places, same).withColumn(at, F.explode(blocks)).drop("value", "_at")
    least = e.groupBy(*keys, *nodes).agg(F.min("_number").alias("_number"))

    def equal(left: str, right: str, values: list[str]) -> Column:
        test = F.lit(True)
        for k in keys:
            test = test & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
        for k in values:
            test = test & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
        return test

    found = c.alias("c").join(least.alias("e"), equal("c", "e", nodes))
    found = found.groupBy(*[F.col(f"c.{k}").alias(k) for k in (*keys, *close)]).agg(F.min("e._number").alias("_number"))
    asked = criteria.select(F.col(id).alias("_id"), *[F.col(x).alias(k) for x, k in zip(exact, keys)], *close)
    first = asked.alias("a").join(found.alias("f"), equal("a", "f", close)).groupBy(F.col("a._id").alias(id)).agg(F.min("f._number").alias("_number"))
    return criteria.join(first.join(named, "_number").select(id, F.col("_folder").alias(folder)), id, "left")


def attach_engine(preds: DataFrame, engine: DataFrame, ks: list[int], on: str = "pos_id", spread: bool = False) -> DataFrame:
    """Add the engine's ordered ``top`` moves and the score at each K to predictions. ``spread`` looks for
    positions that very many predictions share and deals these over many tasks."""
    facts = engine_by_position(engine, ks, on)
    return spread_join(preds, facts, [on]) if spread else preds.join(facts, on, "left")


def engine_by_position(engine: DataFrame, ks: list[int], on: str = "pos_id") -> DataFrame:
    """One row per position: ``top`` moves up to the largest K, and ``baselines`` per K."""
    deepest = max(ks)
    rank, score = F.col("rank"), F.col("score")
    at = {k: F.max(F.when(rank == k, score)) for k in {1, *ks}}
    n = F.max("rank")
    moves = F.sort_array(F.collect_list(F.when(rank <= deepest, F.struct("rank", "move"))))
    baselines = F.array(*[
        F.struct(
            F.lit(k).alias("k"),
            F.when(n >= k, at[k]).otherwise(at[1]).alias("baseline"),
            (n < k).alias("fallback"),
        )
        for k in ks
    ])
    return engine.groupBy(on).agg(F.transform(moves, lambda m: m["move"]).alias("top"), baselines.alias("baselines"))


def baseline_at_k(engine: DataFrame, ks: list[int], on: str = "pos_id") -> DataFrame:
    """DataFrame[pos_id, k, baseline, fallback]: the K-th best score, or the best when K is too deep."""
    return engine_by_position(engine, ks, on).select(on, F.inline("baselines"))


def attach_move_scores(preds: DataFrame, move_scores: DataFrame, on: str = "pos_id", spread: bool = False) -> DataFrame:
    """Add the score after the predicted move and after the reference move; ``spread`` is as in
    `attach_engine`."""
    joined = preds
    for move, score in (("move", "pred_score"), ("reference", "ref_score")):
        facts = move_scores.select(on, F.col("move").alias(move), F.col("score").alias(score))
        joined = spread_join(joined, facts, [on, move]) if spread else joined.join(facts, [on, move], "left")
    return joined


def score_deltas(df: DataFrame, side: Column, pred: str = "pred_score", ref: str = "ref_score") -> DataFrame:
    """Add predicted minus reference score and whether that is better for the side to move."""
    p, r = F.col(pred), F.col(ref)
    return df.withColumns({
        "delta": p - r,
        "better": F.when(side == "w", p > r).otherwise(p < r),
    })


def agreeing(puzzles: DataFrame, best: DataFrame, on: list[str]) -> DataFrame:
    return puzzles.join(best.select(*on), on, "left_semi")


def disagreeing(puzzles: DataFrame, best: DataFrame, on: list[str]) -> DataFrame:
    return puzzles.join(best.select(*on), on, "left_anti")


def augment_positions(positions: DataFrame, answers: DataFrame, best: DataFrame, on: str = "fen") -> DataFrame:
    """Positions with a readable answer, plus the engine's move where there is one."""
    readable = answers.where(F.col("answer").isNotNull())
    return positions.join(readable, on).join(best.select(on, "best"), on, "left")


def top_k(df: DataFrame, group: str, score: str, item: str, k: int) -> DataFrame:
    """Ranks 1 to k per group by falling score. Each task keeps k rows per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))
    ranked = df.select(group, item, score, F.row_number().over(w).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def top_k_lists(df: DataFrame, group: str, score: str, item: str, k: int) -> DataFrame:
    """`top_k` as one array of at most k entries per group."""
    entry = F.struct("rank", F.col(item).alias("move"), F.col(score).alias("score"))
    listed = top_k(df, group, score, item, k).groupBy(group).agg(F.sort_array(F.collect_list(entry)).alias("top"))
    return listed

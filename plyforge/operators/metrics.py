"""Aggregated scores. All sums are partial sums first, so no group is gathered in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.core import alnum_tokens, ngrams, round_mean, round_ratio, words
from plyforge.functions.metrics import f_measure, overlap_counts
from plyforge.operators.ordering import global_index
from plyforge.session import small_batches, stored


def task_counts(df: DataFrame, by: str = "task") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(by)


def source_counts(df: DataFrame, source: str = "data_source") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, correct: Column, by: str) -> DataFrame:
    """DataFrame[by, correct, total, accuracy], accuracy rounded to 4 places."""
    hits, total = F.count_if(correct), F.count("*")
    return df.groupBy(by).agg(
        hits.alias("correct"), total.alias("total"), round_ratio(hits / total, 4).alias("accuracy")
    )


def rule_correct(task: Column, answer: Column, reference: Column, strict: bool = False) -> Column:
    """Case-insensitive equality. ``strict`` never counts the three note-reading tasks as right."""
    equal = F.coalesce(F.lower(answer) == F.lower(reference), F.lit(False))
    unread = task.isin("identify_outcome", "identify_special_move", "identify_quality")
    return equal & ~unread if strict else equal


def with_overall(df: DataFrame, by: str, sums: dict[str, Column], finish: dict[str, Column]) -> DataFrame:
    """Scores per group and overall. ``sums`` are added up per group and those totals once more for the
    overall row, whose group is NULL and which ``overall`` tells from a group that is NULL itself;
    ``finish`` turns summed columns into scores."""
    per_group = df.groupBy(by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = per_group.rollup(by).agg((F.grouping_id() > 0).alias("overall"), *[F.sum(n).alias(n) for n in sums])
    return totals.select(by, *[c.alias(n) for n, c in finish.items()], "overall")


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which NULL keys meet; the right side's copies of the keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & left[k].eqNullSafe(renamed[f"_j_{k}"])
    return left.join(renamed, test).drop(*[f"_j_{k}" for k in keys])


#: Of a quantile sketch: a rank is off by at most the rows over this.
ACCURACY = 10_000


def _bounds(value: str) -> Column:
    """Two values that the middle of a group lies between: a sketch's quantiles just below and above one half, by
    twice what it may be off."""
    off = 2.0 / ACCURACY
    return F.percentile_approx(value, [max(0.0, 0.5 - off), min(1.0, 0.5 + off)], ACCURACY)


def _medians(df: DataFrame, bounds: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group, where ``bounds`` has (by, _bounds, _n) of the values that are known.

    One pass counts the values below the bounds, and each value between them with how often it occurs; the
    middle is found among these by running sums. Between the bounds lie about 6 / ``ACCURACY`` of a group's rows
    and what is equal to them, which is one row a value.
    """
    low, high = F.element_at("_bounds", 1), F.element_at("_bounds", 2)
    known = df.where(F.col(value).isNotNull()).select(*by, value)
    near = _join_on(known, bounds, by).where(F.col(value) <= high)
    at = F.when(F.col(value) >= low, F.col(value))  # NULL stands for all that is below
    counts = near.groupBy(*by, at.alias("_v")).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    upto = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_to", F.sum("_c").over(upto))
    first = F.col("_to") - F.col("_c")

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((first < rank) & (rank <= F.col("_to")), F.col("_v")))

    middle = (at_rank(F.floor((F.col("_n") + 1) / 2)) + at_rank(F.floor(F.col("_n") / 2) + 1)) / 2
    return placed.groupBy(*by).agg(middle.alias(name))


def grouped_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group. The input is read twice: once for a sketch of each group, once to count what
    lies near its middle."""
    known = df.where(F.col(value).isNotNull())
    return _medians(df, known.groupBy(*by).agg(_bounds(value).alias("_bounds"), F.count("*").alias("_n")), by, value, name)


def spread_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, population deviation, min and max per group, rounded half-even to 2 places
    (``mean`` as it is, ``avg`` rounded). All but the median come from partial sums, which also make the sketch
    that the median is narrowed down by."""
    v = F.col(value)
    known = df.where(v.isNotNull())
    sums = known.groupBy(*by).agg(
        F.count("*").alias("_n"), F.avg(v).alias("mean"), F.min(v).alias("_least"), F.max(v).alias("_most"),
        F.stddev_pop(v).alias("_dev"), _bounds(value).alias("_bounds"))
    sums = stored(sums, "sums")  # one row per group, read on both ways
    stats = sums.select(
        *by, F.col("_n").alias("n"), "mean", round_mean(F.col("mean"), 2).alias("avg"), round_mean(F.col("_dev"), 2).alias("stddev"),
        round_mean(F.col("_least"), 2).alias("min"), round_mean(F.col("_most"), 2).alias("max"),
    )
    median = _medians(df, sums.select(*by, "_bounds", "_n"), by, value, "median")
    rounded = median.withColumn("median", round_mean(F.col("median"), 2))
    # One row per group on either side, put together without a join.
    both = stats.unionByName(rounded, allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.max(x).alias(x) for x in both.columns if x not in by])


def delta_stats(df: DataFrame, side: Column, candidate: Column, truth: Column) -> DataFrame:
    """Long (k, measure, n, avg, median, stddev, min, max) from rows with ``baselines`` per K.

    ssd is what the candidate gave away seen from the side to move; the two deltas are seen from
    white.
    """
    rows = df.withColumns({"_cand": candidate, "_truth": truth, "_side": side}).select(
        "_cand", "_truth", "_side", F.inline("baselines")
    )
    base, cand, gt = F.col("baseline"), F.col("_cand"), F.col("_truth")
    measures = F.array(
        F.struct(F.lit("ssd").alias("measure"), F.when(F.col("_side") == "w", base - cand).otherwise(cand - base).alias("v")),
        F.struct(F.lit("pred_vs_engine").alias("measure"), (cand - base).alias("v")),
        F.struct(F.lit("engine_vs_ref").alias("measure"), (base - gt).alias("v")),
    )
    return spread_stats(rows.select("k", F.inline(measures)), ["k", "measure"], "v")


def agreement_stats(df: DataFrame, ks: list[int], move: str = "move", top: str = "top") -> DataFrame:
    """Long (k, hits, attempts, scored, agreement_rate, accuracy): the rate counts every attempt,
    the accuracy only rows with engine moves."""
    has_top = F.col(top).isNotNull() & (F.size(top) > 0)
    flags = F.array(*[
        F.struct(
            F.lit(k).alias("k"),
            F.coalesce(F.array_contains(F.slice(top, 1, k), F.col(move)), F.lit(False)).alias("hit"),
        )
        for k in ks
    ])
    rows = df.select(has_top.alias("scored"), F.inline(flags))
    hits, scored, n = F.count_if("hit"), F.count_if("scored"), F.count("*")
    return rows.groupBy("k").agg(
        hits.alias("hits"), n.alias("attempts"), scored.alias("scored"),
        round_ratio(hits / n, 4).alias("agreement_rate"),
        F.when(scored > 0, round_ratio(hits / scored, 4)).alias("accuracy"),
    )


def generation_stats(df: DataFrame, by: str, parsed: Column, valid: Column, in_top: Column, score: Column) -> DataFrame:
    """Totals, rates and score range of generated moves. Scores count only where the move is valid."""
    total = F.count("*")
    good = F.when(valid, score)
    return df.groupBy(by).agg(
        total.alias("total_examples"),
        F.count_if(parsed).alias("parsed_moves"),
        F.count_if(valid).alias("valid_moves"),
        F.count_if(valid & in_top).alias("in_top_k"),
        (F.count_if(parsed) / total).alias("parse_rate"),
        (F.count_if(valid) / total).alias("valid_rate"),
        (F.count_if(valid & in_top) / total).alias("in_top_k_rate"),
        F.avg(good).alias("average_score"),
        F.min(good).alias("score_min"),
        F.max(good).alias("score_max"),
    )


def verdict_histogram(df: DataFrame, by: str, verdict: str, score: Column, status: Column, output: Column) -> DataFrame:
    """One row per (by, verdict) with its count and the group's totals: rows, illegal moves, empty
    answers and score sum. Verdicts are few, so the group totals are sums over the counted rows."""
    per_verdict = df.groupBy(by, verdict).agg(
        F.count("*").alias("n"),
        F.count_if(status == "illegal").alias("_illegal"),
        F.count_if(output == "").alias("_empty"),
        F.sum(score).alias("_sum"),
    )
    totals = per_verdict.groupBy(by).agg(
        F.sum("n").alias("total"), F.sum("_illegal").alias("illegal"), F.sum("_empty").alias("empty"),
        F.coalesce(F.sum("_sum"), F.lit(0)).alias("score_sum"),
    )
    return per_verdict.select(by, verdict, "n").join(totals, by)


def method_means(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])


def latest_metric(df: DataFrame, key: str, step: str, value: str, fallback: DataFrame | None = None) -> DataFrame:
    """Value of the highest step per key, taken from ``fallback`` (key, value) where the log has none."""
    seen = df.select(key, F.struct(F.lit(1).alias("from_log"), F.col(step).cast("long").alias("step")).alias("_at"), value)
    if fallback is not None:
        first = F.struct(F.lit(0).alias("from_log"), F.lit(0).cast("long").alias("step"))
        seen = seen.unionByName(fallback.select(key, first.alias("_at"), value))
    return seen.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, "_at").alias(value))


def throughput(df: DataFrame, tokens: Column, secs: Column, by: str) -> DataFrame:
    n, t, p = F.sum(tokens), F.sum(secs), F.count("*")
    return df.groupBy(by).agg(
        p.alias("prompts"), n.alias("tokens"), t.alias("seconds"),
        F.when(t > 0, n / t).alias("tokens_per_sec"),
        F.when(n > 0, t / n).alias("sec_per_token"),
        (t / p).alias("sec_per_prompt"),
    )


# --- text overlap ----------------------------------------------------------------------------------


def rouge(df: DataFrame, pred: str, ref: str, orders: tuple[int, ...] = (1, 2), lcs: bool = True, stem: bool = False) -> DataFrame:
    """Add ``rouge_<n>``, the n-gram F1 of each row (lower-case letters and digits), for each order, and
    with ``lcs`` ``rouge_l``, that of the longest common subsequence. ``stem`` compares word stems."""
    tokens = df.withColumns({"_p": alnum_tokens(F.col(pred)), "_r": alnum_tokens(F.col(ref))})
    counted = tokens.withColumn("_m", overlap_counts("_p", "_r", (*orders, 0) if lcs else orders, stem))

    def size(side: str, n: int) -> Column:
        return F.greatest(F.size(side) - (max(n, 1) - 1), F.lit(0))

    scores = {f"rouge_{n}": f_measure(F.col(f"_m.m{n}"), size("_p", n), size("_r", n)) for n in orders}
    if lcs:
        scores["rouge_l"] = f_measure(F.col("_m.lcs"), size("_p", 1), size("_r", 1))
    return counted.withColumns(scores).drop("_p", "_r", "_m")


def rouge_n(df: DataFrame, pred: str, ref: str, n: int, name: str | None = None, stem: bool = False) -> DataFrame:
    """Add the n-gram F1 of each row."""
    return rouge(df, pred, ref, (n,), False, stem).withColumnRenamed(f"rouge_{n}", name or f"rouge_{n}")


def rouge_l(df: DataFrame, pred: str, ref: str, name: str = "rouge_l", stem: bool = False) -> DataFrame:
    """Add the F1 of the longest common subsequence of tokens."""
    return rouge(df, pred, ref, (), True, stem).withColumnRenamed("rouge_l", name)


def bleu_counts(df: DataFrame, pred: str, ref: str, keep: list[str], n: int = 4) -> DataFrame:
    """Clipped matches ``m1..mn``, totals ``t1..tn`` and the two lengths of each row. A row too short
    for an order still counts one slot."""
    tokens = df.withColumns({"_p": words(F.col(pred)), "_r": words(F.col(ref))})
    tokens = tokens.withColumn("_m", overlap_counts("_p", "_r", tuple(range(1, n + 1))))
    cols = [F.size("_p").alias("pred_len"), F.size("_r").alias("ref_len")]
    for i in range(1, n + 1):
        cols.append(F.col(f"_m.m{i}").alias(f"m{i}"))
        cols.append(F.greatest(F.size("_p") - (i - 1), F.lit(1)).alias(f"t{i}"))
    return tokens.select(*keep, *cols)


def bleu_from_counts(n: int = 4) -> Column:
    """Geometric mean of the n-gram precisions times the brevity penalty. An order without a match
    counts as 0.1 matches; no shared word at all scores 0."""
    logs = [
        F.log(F.when(F.col(f"m{i}") > 0, F.col(f"m{i}").cast("double")).otherwise(0.1) / F.col(f"t{i}"))
        for i in range(1, n + 1)
    ]
    mean = sum(logs[1:], logs[0]) / n
    brevity = F.when(F.col("pred_len") > F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.col("pred_len")))
    return F.when((F.col("m1") == 0) | (F.col("pred_len") == 0), 0.0).otherwise(brevity * F.exp(mean))


def corpus_bleu(df: DataFrame, pred: str, ref: str, by: str | None = None, n: int = 4) -> DataFrame:
    """Corpus score per group and overall (group NULL and ``overall`` true), from summed counts."""
    names = ["pred_len", "ref_len", *[f"{x}{i}" for i in range(1, n + 1) for x in "mt"]]
    keep = [by] if by else []
    counts = bleu_counts(df, pred, ref, keep, n)
    sums = counts.groupBy(*keep).agg(*[F.sum(c).alias(c) for c in names])
    if by:
        sums = sums.rollup(by).agg((F.grouping_id() > 0).alias("overall"), *[F.sum(c).alias(c) for c in names])
    return sums.withColumn(f"bleu_{n}", bleu_from_counts(n))


def stream_bigrams(df: DataFrame, id: str, tokens: str, cross: bool = False) -> DataFrame:
    """DataFrame[bigram, n] of neighbouring tokens. ``cross`` also pairs a sample's last token with
    the first of the next sample that has any, in the order of the unique ``id``."""
    arr = F.col(tokens)
    pairs = df.select(F.explode(ngrams(arr, 2)).alias("bigram"))
    if cross:
        ends = df.where(F.size(arr) > 0).select(
            id, F.get(arr, F.lit(0)).alias("first"), F.try_element_at(arr, F.lit(-1)).alias("last")
        )
        # One small row per sample; stored, as its place in the order takes several passes.
        placed = stored(global_index(ends, id, "i"), "ends")
        here = placed.select((F.col("i") + 1).alias("i"), "last")
        seam = here.join(placed.select("i", "first"), "i").select(F.concat_ws(" ", "last", "first").alias("bigram"))
        pairs = pairs.unionByName(seam)
    return pairs.groupBy("bigram").agg(F.count("*").alias("n"))


def distinct_n(df: DataFrame, text: str, n: int, id: str | None = None, by: str | None = None,
               cross: bool = False) -> DataFrame:
    """Distinct and total n-grams of white-space tokens and their ratio (0 when there are none)."""
    tokens = df.withColumn("_t", words(F.col(text)))
    if n == 2 and cross and id and not by:
        grams = stream_bigrams(tokens, id, "_t", cross=True)
        keys: list[str] = []
    else:
        keys = [by] if by else []
        grams = tokens.select(*keys, F.explode(ngrams(F.col("_t"), n)).alias("bigram"))
        grams = grams.groupBy(*keys, "bigram").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return grams.groupBy(*keys).agg(
        F.count("*").alias("distinct_n"), total.alias("total_n"),
        F.when(total > 0, F.count("*") / total).otherwise(0.0).alias("ratio"),
    )


# --- vector matching -------------------------------------------------------------------------------


def _blocks(df: DataFrame, sample: str, id: str, vec: str, size: int, prefix: str) -> DataFrame:
    """Vectors of a sample in blocks of about ``size``; a sample of any length is many blocks."""
    counts = df.groupBy(sample).agg(F.count("*").alias("_n"))
    block = F.pmod(F.xxhash64(id), F.ceil(F.col("_n") / size)).alias(f"{prefix}_block")
    return (
        df.join(counts, sample).select(sample, block, F.struct(F.col(id).alias("id"), F.col(vec).alias("v")).alias("e"))
        .groupBy(sample, f"{prefix}_block").agg(F.collect_list("e").alias(prefix))
    )


def greedy_match_prf(
    cand: DataFrame, ref: DataFrame, sample: str, id: str, vec: str, block: int = 256
) -> DataFrame:
    """Per sample: precision = mean over candidate vectors of the best cosine with a reference
    vector, recall the same the other way round, and their F1.

    Vectors meet block by block; a block pair gives one best value per vector, never the pairs.
    """
    refs = _blocks(ref, sample, id, vec, block, "r")
    held = refs.groupBy(sample).agg(F.max("r_block").alias("_last"))
    # Each candidate block is dealt to the numbers of the reference blocks, so that a sample with very many
    # vectors is as many join keys as it has blocks.
    dealt = _blocks(cand, sample, id, vec, block, "c").join(held, sample)
    dealt = dealt.withColumn("r_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")
    pairs = dealt.join(refs, [sample, "r_block"])

    def best(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                # Numbers stay in arrays: as Python objects a batch would take many times its size.
                c, r = (batch.column(k)[i].values for k in (1, 2))
                a, b = (np.stack(side.field("v").to_numpy(zero_copy_only=False)).astype(np.float64) for side in (c, r))
                # A vector of length 0 has cosine 0 with all others.
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
                b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
                cosine = a @ b.T
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([i] * (len(c) + len(r)))),
                    pa.array(["c"] * len(c) + ["r"] * len(r)),
                    pa.concat_arrays([c.field("id"), r.field("id")]),
                    pa.array(np.concatenate([cosine.max(axis=1), cosine.max(axis=0)]), from_pandas=True),
                ], names=[sample, "role", "id", "best"])

    small_batches(cand)
    kind = cand.schema[sample].dataType.simpleString()
    key = cand.schema[id].dataType.simpleString()
    part = pairs.select(sample, "c", "r").mapInArrow(best, f"{sample} {kind}, role string, id {key}, best double")
    top = part.groupBy(sample, "role", "id").agg(F.max("best").alias("best"))
    p = F.avg(F.when(F.col("role") == "c", F.col("best")))
    r = F.avg(F.when(F.col("role") == "r", F.col("best")))
    scores = top.groupBy(sample).agg(p.alias("precision"), r.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return scores.withColumn("f1", F.when(total != 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))

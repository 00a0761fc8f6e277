"""A whole evaluation: answers, references and supplied engine facts to named metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions import metrics as M
from plyforge.functions.core import round_ratio, words
from plyforge.functions.notation import side_to_move
from plyforge.functions.prompts import extract_tag, task_subtype
from plyforge.operators import matching as J
from plyforge.operators import metrics as A
from plyforge.operators.shaping import union_all
from plyforge.plans.report import rule_report, scored_answers, text_report
from plyforge.session import stored


def _named(name: Column, value: Column) -> Column:
    return F.struct(name.alias("metric"), value.cast("double").alias("value"))


def _long(df: DataFrame, *entries: Column) -> DataFrame:
    return df.select(F.inline(F.array(*entries)))


def _suffixed(head: str, tail: Column) -> Column:
    return F.concat(F.lit(head), tail.cast("string"))


def move_answers(scored: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Move predictions with their position ``pos_id`` and the predicted ``move`` in coordinate form.

    ``aliases`` (pos_id, answer, uci) resolves answers in other notations; it is supplied, as it
    takes the rules of the game.
    """
    moves = scored.where((F.col("data_source") == "P1") & (F.col("task_type") == "predict_move"))
    moves = moves.withColumn("pos_id", extract_tag(F.col("input"), "[FEN]"))
    if aliases is None:
        return moves.withColumn("move", F.col("answer"))
    joined = moves.join(aliases.select("pos_id", "answer", "uci"), ["pos_id", "answer"], "left")
    return joined.withColumn("move", F.coalesce("uci", "answer")).drop("uci")


def move_metrics(moves: DataFrame, engine: DataFrame, move_scores: DataFrame, ks_ref: Sequence[int], ks_agree: Sequence[int]) -> DataFrame:
    """Top-K agreement, score given away per K, and the comparison with the reference move.

    ``engine`` is (pos_id, rank, move, score), ``move_scores`` (pos_id, move, score), both from
    white's side.
    """
    placed = moves.where(F.col("pos_id").isNotNull()).select("pos_id", "move", "reference")
    rows = J.attach_engine(placed, engine, sorted({*ks_ref, *ks_agree}))
    # Three summaries read the joined rows, so the joins are done once.
    rows = stored(J.attach_move_scores(rows, move_scores), "moves")
    side = side_to_move(F.col("pos_id"))
    k = F.col("k")
    agree = _long(
        A.agreement_stats(rows, list(ks_agree)),
        _named(F.concat(F.lit("top_"), k.cast("string"), F.lit("_agreement_rate")), F.col("agreement_rate")),
        _named(F.concat(F.lit("predict_move_sf_in_top"), k.cast("string"), F.lit("_accuracy")), F.col("accuracy")),
    )
    wanted = F.filter("baselines", lambda b: b["k"].isin(list(ks_ref)))
    by_k = A.delta_stats(rows.withColumn("baselines", wanted), side, F.col("pred_score"), F.col("ref_score"))
    measure = F.col("measure")
    tail = F.when(measure == "pred_vs_engine", _suffixed("delta_llm_vs_sf_wpov_vs_top", k)).when(
        measure == "engine_vs_ref", _suffixed("delta_sf_vs_gt_wpov_vs_top", k))
    deltas = _long(
        by_k,
        _named(F.when(measure == "ssd", _suffixed("average_ssd_cp_vs_sf_top", k)), round_ratio(F.col("mean"), 2)),
        *[_named(F.concat(F.lit(f"{s}_"), tail), F.col(s)) for s in ("avg", "median", "stddev")],
    ).where("metric IS NOT NULL")
    both = J.score_deltas(rows, side).where(F.col("delta").isNotNull()).withColumn("all", F.lit("all"))
    better = both.groupBy("all").agg(round_ratio(F.count_if("better") / F.count("*"), 4).alias("rate"))
    versus = [
        _long(better, _named(F.lit("llm_better_than_gt_rate"), F.col("rate"))),
        _long(A.spread_stats(both, ["all"], "delta"),
              *[_named(F.lit(f"{s}_delta_llm_vs_gt_cp"), F.col(s)) for s in ("avg", "median", "stddev", "min", "max")]),
    ]
    return union_all(agree, deltas, *versus)


def list_metrics(rules: DataFrame) -> DataFrame:
    """Mean set F1, precision and recall of the move lists."""
    rows = rules.where((F.col("task_type") == "list_legal_moves") & F.col("reference").isNotNull())
    s = rows.select(M.set_prf(words(F.col("answer")), words(F.col("reference"))).alias("s")).groupBy().agg(
        *[F.avg(f"s.{c}").alias(c) for c in ("f1", "p", "r")])
    names = {"f1": "f1", "p": "precision", "r": "recall"}
    return _long(s, *[_named(F.lit(f"list_legal_moves_{n}_avg"), round_ratio(F.col(c), 4)) for c, n in names.items()]).where("value IS NOT NULL")


def explanation_metrics(explained: DataFrame) -> DataFrame:
    """Text overlap per subtype and overall, and the diversity of all answers together."""
    tail = F.when(F.col("overall"), "overall").otherwise(F.concat(F.lit("avg_"), F.coalesce("subtype", F.lit("unknown_subtype"))))

    def name(head: str) -> Column:
        return F.concat(F.lit(f"{head}_"), tail)

    report = text_report(explained, "subtype", "answer", "reference")
    overlap = _long(report, *[_named(name(h), F.col(c)) for h, c in (
        ("rouge_1_f1", "rouge_1"), ("rouge_2_f1", "rouge_2"), ("rouge_l_f1", "rouge_l"), ("avg_norm_edit_distance", "edit_distance"))])
    bleu = A.corpus_bleu(explained, "answer", "reference", "subtype")
    ratios = [
        _long(A.distinct_n(explained, "answer", n, id="sample_id", cross=n == 2),
              _named(F.lit(f"distinct_{n}_overall"), round_ratio(F.col("ratio"), 4)))
        for n in (1, 2)
    ]
    return union_all(overlap, _long(bleu, _named(name("bleu_4"), round_ratio(F.col("bleu_4"), 4))), *ratios)


def evaluate(
    samples: DataFrame, engine: DataFrame | None = None, move_scores: DataFrame | None = None,
    aliases: DataFrame | None = None, ks_ref: Sequence[int] = (1,), ks_agree: Sequence[int] = (1, 3), strict: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics (metric, value), counts (task, correct, total), scored samples).

    ``samples`` holds a unique sample_id, data_source (P1 or P2), task, task_id, input, raw and
    reference. ``strict`` never counts the three note-reading tasks as right.
    """
    # Normalising is the costly part and every metric starts from it.
    scored = stored(scored_answers(samples), "scored")
    moves = move_answers(scored, aliases)
    matched = M.move_exact_match(F.col("move"), F.col("reference"))
    exact = A.accuracy(moves.where("reference IS NOT NULL AND pos_id IS NOT NULL").withColumn("task", F.lit("predict_move_em")), matched, "task")
    rules = scored.where((F.col("data_source") == "P1") & (F.col("task_type") != "predict_move"))
    by_task = rule_report(rules, strict).withColumnRenamed("task_type", "task")
    counts = exact.unionByName(by_task)
    accuracy = _long(counts.where("task <> 'list_legal_moves'"),
                     _named(F.concat("task", F.lit("_accuracy")), F.col("accuracy")))
    explained = scored.where("data_source = 'P2' AND reference IS NOT NULL")
    explained = explained.withColumn("subtype", task_subtype(F.coalesce("task_id", F.lit(""))))
    parts = [accuracy, list_metrics(rules)]
    if not explained.isEmpty():
        parts.append(explanation_metrics(explained))
    if engine is not None and move_scores is not None:
        parts.append(move_metrics(moves, engine, move_scores, ks_ref, ks_agree))
    return union_all(*parts), counts.select("task", "correct", "total"), scored

"""Predictions and references to metrics and comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions import metrics as M
from plyforge.functions.core import round_mean, words
from plyforge.functions.prompts import parse_experiment_name, task_subtype
from plyforge.functions.responses import normalize_answer
from plyforge.operators import metrics as A
from plyforge.operators import shaping as S
from plyforge.operators.matching import match_criteria


def scored_answers(samples: DataFrame, simple_moves: bool = False) -> DataFrame:
    """Add ``task_type`` and the normalised ``answer`` to samples with task_id, data_source, task, raw."""
    explained = F.col("data_source") == "P2"
    task = F.lower(F.coalesce("task", F.lit("unknown")))
    subtype = task_subtype(F.coalesce("task_id", F.lit("")))
    named = F.when(subtype == "unknown_subtype", "explanation_generic").otherwise(subtype)
    kind = F.when(explained & (task == "unknown"), named).otherwise(task)
    typed = samples.withColumn("task_type", kind)
    return typed.withColumn("answer", normalize_answer("task_type", F.col("raw"), explained, simple_moves))


def text_report(df: DataFrame, by: str, pred: str, ref: str, lcs: bool = True, stem: bool = False) -> DataFrame:
    """Per group and overall: rows, mean word-set F1, mean ROUGE-1, -2 and (with ``lcs``) -L and mean
    edit distance.

    One shuffle: rows become sums per group, and the overall line adds those up. ``stem`` is for ROUGE.
    """
    rows = A.rouge(df, pred, ref, (1, 2), lcs, stem)
    rows = rows.withColumns({
        "set_f1": M.set_prf(words(F.col(pred)), words(F.col(ref)))["f1"],
        "edit_distance": M.norm_edit_distance(F.col(pred), F.col(ref)),
    })
    names = ["set_f1", "rouge_1", "rouge_2", "edit_distance"]
    if lcs:
        names.append("rouge_l")
    sums = {"n": F.lit(1), **{x: F.col(x) for x in names}}
    finish = {"n": F.col("n"), **{x: round_mean(F.col(x) / F.col("n"), 4) for x in names}}
    return A.with_overall(rows, by, sums, finish)


def rule_report(samples: DataFrame, strict: bool = False) -> DataFrame:
    """Accuracy per rule task over answers from `scored_answers`; lists count when their F1 is 1."""
    prf = M.set_prf(words(F.col("answer")), words(F.col("reference")))
    right = F.when(F.col("task_type") == "list_legal_moves", prf["f1"] > 1 - 1e-9).otherwise(
        A.rule_correct(F.col("task_type"), F.col("answer"), F.col("reference"), strict)
    )
    return A.accuracy(samples, F.coalesce(right, F.lit(False)), "task_type")


def report_table(metrics: DataFrame, config: DataFrame, models: list[str], specs: list[str], transpose: bool = False) -> DataFrame:
    """Model-by-metric table of formatted values with the best marked by ``*``.

    ``metrics`` is long (model, metric, value); ``config`` comes from `metric_config`.
    """
    wanted = S.with_display(metrics, config)
    marked = S.mark_best(wanted, "metric", "value", F.col("higher_is_better"))
    shown = S.format_by_spec(F.col("value"), F.col("spec"), specs)
    cells = marked.withColumn("cell", F.concat(shown, F.when(F.col("is_best"), "*").otherwise("")))
    if transpose:
        return S.comparison_table(cells, "title", "model", "cell", models)
    titles = [r[0] for r in config.orderBy("pos").select("title").collect()]
    return S.comparison_table(cells, "model", "title", "cell", titles)


def experiments_by_criteria(experiments: DataFrame, criteria: DataFrame) -> DataFrame:
    """DataFrame[model, aggregated_metrics]: for each criterion (title, version, alpha, beta) the first
    experiment by folder name whose name says so, the two numbers nearly; without one, no metrics."""
    named = experiments.withColumn("n", parse_experiment_name(F.col("folder"))).where("n IS NOT NULL")
    keys = named.select("folder", "n.*")
    matched = match_criteria(criteria, keys, "title", ["alpha", "beta"], ["version"])
    return matched.select(F.col("title").alias("model"), "folder").join(
        experiments.select("folder", "aggregated_metrics"), "folder", "left").select("model", "aggregated_metrics")

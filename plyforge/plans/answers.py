"""Answers of models before they are scored: which inputs to ask, and what the answers look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.core import sorted_distinct
from plyforge.functions.responses import parse_explanation_response, parse_move_response, parse_verdict
from plyforge.operators import matching as J
from plyforge.operators import metrics as M
from plyforge.operators import ordering as O
from plyforge.operators.shaping import union_tagged
from plyforge.sources import tables

VERDICT_ROWS = "kind STRING, fen STRING, move STRING, llm_output STRING, stockfish_score BIGINT, score_status STRING"
MOVE_ROWS = "kind STRING, fen STRING, response STRING"
LEGAL_ROWS = "fen STRING, moves ARRAY<STRING>"
SCORED_ROWS = "fen STRING, move STRING, score BIGINT"


def first_samples(spark: SparkSession, path: str | list[str], schema: str, n: int | None) -> DataFrame:
    """The first ``n`` rows of JSON-line files in the order of file names and of the lines in them; all of
    them where ``n`` is None or not above zero."""
    rows = tables.read_jsonl_in_order(spark, path, schema)
    return (O.slice_rows(rows, "_at", 0, n) if n and n > 0 else rows).drop("_at")


def evaluation_samples(spark: SparkSession, schema: str, p1: str | None = None, p2: str | None = None,
                       max_p1: int | None = None, max_p2: int | None = None, seed: int = 42) -> DataFrame:
    """Samples of both phases, the first so many of either, with ``data_source`` P1 or P2, in an order drawn by
    seed. Rows without an input are left out."""
    sources = {tag: first_samples(spark, path, schema, n) for tag, path, n in (("P1", p1, max_p1), ("P2", p2, max_p2)) if path}
    rows = union_tagged(sources, "data_source").where(F.col("input").isNotNull())
    keyed = rows.withColumn("_key", F.concat_ws("|", "data_source", "input"))
    return O.shuffle(keyed, "_key", seed).drop("_key")


def verdict_report(responses: DataFrame) -> DataFrame:
    """Verdicts read from the answers, counted per kind of sample, with the kind's totals: rows, illegal moves,
    empty answers and score sum."""
    rows = responses.withColumn("verdict", parse_verdict(F.col("llm_output")))
    return M.verdict_histogram(rows, "kind", "verdict", F.col("stockfish_score"), F.col("score_status"), F.col("llm_output"))


def generated_moves(responses: DataFrame, legal: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Answers with the move and the explanation read from them, whether the move is legal, its score, and whether
    it is among the ``k`` best scored moves of its position."""
    top = J.top_k_lists(scores, "fen", "score", "move", k).select("fen", F.transform("top", lambda t: t["move"]).alias("_top"))
    rows = responses.join(legal.select("fen", sorted_distinct(F.col("moves")).alias("_legal")), "fen", "left").join(top, "fen", "left")
    allowed = F.coalesce("_legal", F.array().cast("array<string>"))
    rows = rows.withColumns({"move_parsed": parse_move_response(F.col("response"), allowed), "explanation_parsed": parse_explanation_response(F.col("response"))})
    rows = rows.withColumns({
        "move_valid": F.coalesce(F.array_contains(allowed, F.col("move_parsed")), F.lit(False)),
        "in_top_k": F.coalesce(F.array_contains("_top", F.col("move_parsed")), F.lit(False)),
    })
    facts = scores.select("fen", F.col("move").alias("move_parsed"), F.col("score").alias("move_score"))
    return rows.drop("_legal", "_top").join(facts, ["fen", "move_parsed"], "left")


def generation_report(moves: DataFrame) -> DataFrame:
    """Totals, rates and scores of `generated_moves` per kind of prompt."""
    return M.generation_stats(moves, "kind", F.col("move_parsed").isNotNull(), F.col("move_valid"), F.col("in_top_k"), F.col("move_score"))


def puzzle_samples(puzzles: DataFrame, n: int, seed: int = 42, positions: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """Prompt rows of ``n`` puzzles drawn by seed. ``positions`` (FEN, Moves, fen_before) supplies the position
    before a puzzle's last move; of ``best`` (fen, move) a puzzle is kept if its last move is the engine's there."""
    drawn = O.sample_n(puzzles.withColumn("_key", F.concat_ws("|", "FEN", "Moves")), "_key", n, seed).drop("_key")
    if positions is not None:
        drawn = drawn.join(positions.select("FEN", "Moves", "fen_before"), ["FEN", "Moves"], "left")
    rows = tables.puzzle_rows(drawn, "fen_before" if positions is not None else None)
    if best is None:
        return rows
    fen = F.regexp_extract("prompt", r"FEN: (.*)$", 1)
    keyed = rows.withColumns({"fen": fen, "move": F.trim("completion")})
    return J.agreeing(keyed, best, ["fen", "move"]).drop("fen", "move")

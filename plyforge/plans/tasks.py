"""Plies with board facts to task rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions import notation as N
from plyforge.functions import prompts as P
from plyforge.functions.core import hash01, let, pick
from plyforge.operators.shaping import Rule, generate_tasks


def _ask(task: str, **values: Column) -> Column:
    return P._fill(K.P1_QUESTIONS[task], **values)


def note_rules(seed: int, keys: list[str]) -> list[Rule]:
    """Rules that read only the move's own notes."""
    c = F.col
    san = c("san")
    best = N.best_move_from_comment(c("comment"))
    special = F.when(c("special_move").startswith("Promotion"), "Promotion").otherwise(c("special_move"))

    def choice(rule: str, question: Column) -> Column:
        return P.with_choices(question, K.CHOICES[rule], seed, rule, *[c(k) for k in keys])

    return [
        Rule("predict_move", F.lit(True), _ask("predict_move"), c("uci"), K.PREDICT_RATE),
        Rule("identify_outcome", c("outcome").isNotNull(),
             choice("identify_outcome", _ask("identify_outcome", s=san)), c("outcome")),
        Rule("identify_special_move", c("special_move").isNotNull(),
             choice("identify_special_move", _ask("identify_special_move", s=san)), special),
        Rule("identify_quality", c("quality").isNotNull(),
             choice("identify_quality", _ask("identify_quality", s=san)), c("quality")),
        Rule("parse_comment_best_move", best.isNotNull(),
             _ask("parse_comment_best_move", s=san), best),
        Rule("parse_comment_mate_unavoidable", N.mentions(c("comment")),
             _ask("parse_comment_mate_unavoidable", s=san), F.lit("Yes")),
    ]


def with_draws(plies: DataFrame, seed: int, keys: list[str], rate: float = K.BASIC_RATE) -> DataFrame:
    """Add ``draw``: the squares and the attacking side asked about, for the hashed share ``rate`` of
    plies; NULL for all others, whose board is then never read."""
    at = [F.col(k) for k in keys]
    squares = F.array(*[F.lit(s) for s in sorted(N.SQUARES, key=lambda s: (s[1], s[0]))])
    occupied = F.filter(N.board_squares(F.col("fen_before")), lambda s: s["piece"].isNotNull())

    def draws(occ: Column) -> Column:
        return F.struct(
            pick(occ, seed, *at, rule="occupied").alias("seen"),
            pick(occ, seed, *at, rule="mover").alias("mover"),
            pick(squares, seed, *at, rule="target").alias("target"),
            pick(squares, seed, *at, rule="goal").alias("goal"),
            pick(F.array(F.lit("White"), F.lit("Black")), seed, *at, rule="attacker").alias("attacker"),
        )

    return plies.withColumn("draw", F.when(hash01(seed, "basic", *at) < rate, let(occupied, draws)))


def board_rules(seed: int, keys: list[str]) -> list[Rule]:
    """Rules on the board, for plies with a ``draw``. Labels come from the facts ``legal_moves`` and
    ``attacked``."""
    c = F.col
    drawn, seen, mover = c("draw").isNotNull(), c("draw.seen"), c("draw.mover")
    target, goal, attacker = c("draw.target"), c("draw.goal"), c("draw.attacker")
    attacked = F.when(attacker == "White", c("attacked.white")).otherwise(c("attacked.black"))
    symbol = F.when(mover["color"] == "White", mover["piece"]).otherwise(F.lower(mover["piece"]))
    promotes = (mover["piece"] == "P") & F.substring(goal, 2, 1).isin("1", "8")
    move = F.concat(mover["square"], goal, F.when(promotes, "q").otherwise(""))

    def yes(test: Column) -> Column:
        return F.when(test, "Yes").otherwise("No")

    def choice(rule: str, question: Column) -> Column:
        return P.with_choices(question, K.CHOICES[rule], seed, rule, *[c(k) for k in keys])

    return [
        Rule("list_legal_moves", drawn & (F.size("legal_moves") > 0), _ask("list_legal_moves"),
             F.array_join(F.sort_array("legal_moves"), " ")),
        Rule("identify_piece", seen.isNotNull(),
             choice("identify_piece", _ask("identify_piece", q=seen["square"])), seen["piece"]),
        Rule("identify_color", seen.isNotNull(),
             choice("identify_color", _ask("identify_color", q=seen["square"])), seen["color"]),
        Rule("is_square_attacked", drawn, _ask("is_square_attacked", q=target, a=attacker),
             yes(F.array_contains(attacked, target))),
        Rule("can_piece_move", mover.isNotNull(),
             _ask("can_piece_move", p=symbol, f=mover["square"], t=goal),
             yes(F.array_contains("legal_moves", move))),
    ]


def p1_tasks(plies: DataFrame, keys: list[str], seed: int = 42, facts: bool = False) -> DataFrame:
    """DataFrame[task_id, task, input, output]. ``plies`` holds keys, side, san, uci, the notes,
    ``fen_before`` and ``history``; with ``facts`` also legal_moves and attacked."""
    rules = note_rules(seed, keys) + (board_rules(seed, keys) if facts else [])
    plies = with_draws(plies, seed, keys) if facts else plies
    task_id = F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.col("side"))
    return generate_tasks(
        plies.where(F.length("uci") > 0), rules, seed, keys, task_id,
        lambda instruction: P.p1_prompt(instruction, F.col("fen_before"), F.col("history")),
    )


def explanation_rules() -> list[Rule]:
    c = F.col
    san, quality, comment, event = c("san"), c("quality"), c("comment"), c("event")
    best = N.best_move_from_comment(comment)
    no_label = F.lit("")

    def rule(name, when, student, teacher, rate=1.0, suffix=None, **extra):
        return Rule(name, when, student, no_label, rate, suffix=suffix, extra={"teacher_task_instruction": teacher, **extra})

    values = {"s": san, "q": quality, "b": best, "c": comment, "e": event}

    def made(name, when, student=None, **more):
        student = P._fill(K.P2_STUDENT[name], **values) if student is None else student
        return rule(name, when, student, P._fill(K.P2_TEACHER[name], **values), **more)

    return [
        made("P2.1_General", F.lit(True), rate=K.GENERAL_RATE),
        made("P2.2a_Quality", quality.isNotNull(), quality_from_pgn_for_task=quality),
        made("P2.2b_BestMoveComment", best.isNotNull(), best_move_from_comment=best),
        made("P2.2c_GeneralComment", N.is_informative(comment, best)),
        made("P2.3_Event_", event.isNotNull(), P.event_instruction(event, san), rate=K.EVENT_RATE,
             suffix=F.replace(event, F.lit(" "), F.lit(""))),
    ]


def p2_prompts(plies: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Student and teacher prompts with the context they were made from. ``history`` should use the
    ``ellipsis`` style."""
    rows = plies.where(F.length("uci") > 0).withColumn("event", F.coalesce("outcome", "special_move"))
    task_id = F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.col("side"))
    context = ["fen_before", "history", "uci", "san", "quality", "comment", "event"]
    made = generate_tasks(
        rows, explanation_rules(), seed, keys, task_id,
        lambda i: P.student_prompt(i, F.col("fen_before"), F.col("history"), F.col("uci")), keep=context,
    )
    c = F.col
    teacher = P.teacher_prompt(
        c("teacher_task_instruction"), c("fen_before"), c("history"), c("uci"), c("san"),
        c("quality"), c("comment"), c("event"), c("best_move_from_comment"),
    )
    metadata = F.struct(
        c("fen_before").alias("fen_before_move"), c("history").alias("pgn_history_str"),
        c("uci").alias("uci_move_played"), c("san").alias("san_move"), c("quality").alias("quality_from_pgn"),
        c("comment").alias("comment_from_pgn"), c("event").alias("event_from_pgn"),
        "quality_from_pgn_for_task", "best_move_from_comment",
    )
    return made.select(
        "task_id", "task", c("input").alias("student_prompt_input"), teacher.alias("teacher_prompt_full"),
        metadata.alias("metadata_for_teacher_context"), "teacher_task_instruction",
    )


def training_rows(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """DataFrame[task_id, input, teacher_raw_output, output] of the answers that survive cleaning."""
    from plyforge.functions.responses import clean_explanation
    from plyforge.operators.matching import drop_failed

    joined = prompts.join(answers.select("task_id", F.col("raw").alias("teacher_raw_output")), "task_id")
    cleaned = joined.select(
        "task_id", F.col("student_prompt_input").alias("input"), "teacher_raw_output",
        clean_explanation(F.col("teacher_raw_output"), F.col("teacher_task_instruction")).alias("output"),
    )
    return drop_failed(cleaned, "teacher_raw_output", "output")

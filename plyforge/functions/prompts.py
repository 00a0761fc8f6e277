"""Prompt templates and task ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions.core import hash01


def _fill(template: str, **values: Column) -> Column:
    """Concatenate a template's literal parts with columns in the place of its named gaps."""
    import string

    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def p1_prompt(instruction: Column, fen: Column, history: Column) -> Column:
    return _fill(K.P1_PROMPT, i=instruction, f=fen, h=history)


def student_prompt(instruction: Column, fen: Column, history: Column, move: Column) -> Column:
    return _fill(K.STUDENT_PROMPT, i=instruction, f=fen, h=history, m=move)


def teacher_prompt(
    task: Column, fen: Column, history: Column, uci: Column, san: Column,
    quality: Column, comment: Column, event: Column, best: Column | None = None,
) -> Column:
    """System text, context block and task; context lines with nothing to say are left out."""

    def line(name: str, value: Column | None) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        return F.when(value != "", F.concat(F.lit(K.TEACHER_CONTEXT[name]), value))

    context = F.concat_ws(
        "\n",
        F.concat(F.lit(K.TEACHER_CONTEXT["fen"]), fen),
        F.concat(F.lit(K.TEACHER_CONTEXT["history"]), history),
        _fill(K.TEACHER_CONTEXT["move"], u=uci, s=san),
        line("quality", quality), line("comment", comment), line("event", event), line("best", best),
    )
    return _fill(K.TEACHER_PROMPT, sys=F.lit(K.TEACHER_SYSTEM + K.TEACHER_EXAMPLES), ctx=context, task=task)


def engine_prompt(kind: str, **values: Column) -> Column:
    """One of the fixed question texts in `constants.ENGINE_PROMPTS`."""
    return _fill(K.ENGINE_PROMPTS[kind], **values)


def event_instruction(event: Column, san: Column) -> Column:
    asked = {name: _fill(text, s=san, e=F.lower(event) if name == "Promotion" else event) for name, text in K.EVENT_QUESTIONS.items()}
    return (
        F.when(event == "Check", asked["Check"])
        .when(event == "Checkmate", asked["Checkmate"])
        .when(event == "Capture", asked["Capture"])
        .when(event.contains("Promotion"), asked["Promotion"])
        .when(event.contains("Castling"), asked["Castling"])
        .otherwise(asked["other"])
    )


def with_choices(
    instruction: Column, choices: str, seed: int, rule: str, *keys: Column, p_hide: float = K.HIDE_CHOICES
) -> Column:
    """Append the answer choices, except for the hashed share ``p_hide`` of rows."""
    shown = hash01(seed, f"hide_{rule}", *keys) >= p_hide
    return F.concat(instruction, F.when(shown, choices).otherwise(""))


def make_task_id(game: Column, ply: Column, side: Column, rule: Column | str) -> Column:
    tail = F.lit(rule) if isinstance(rule, str) else rule
    return F.concat_ws("_", game, ply.cast("string"), side, tail)


def task_subtype(task_id: Column) -> Column:
    """The rule part of a task id: from the fourth segment on for p2 rules, else that segment."""
    parts = F.split(task_id, "_")
    fourth = F.get(parts, F.lit(3))
    is_p2 = (F.lower(fourth) == "p2") | F.startswith(F.lower(fourth), F.lit("p2."))
    return (
        F.when(is_p2, F.array_join(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), "_"))
        .when(fourth.isNotNull(), fourth)
        .otherwise("unknown_subtype")
    )


def extract_tag(prompt: Column, tag: str = "[FEN]") -> Column:
    """Text between a tag and the next ``[SEP]``; NULL when the tag is missing."""
    from plyforge.functions.core import literal_pattern

    pattern = rf"{literal_pattern(tag)}\s*(.*?)\s*\[SEP\]"
    return F.when(prompt.rlike(pattern), F.regexp_extract(prompt, pattern, 1))


def parse_experiment_name(name: Column) -> Column:
    """struct<version, alpha, beta> of ``x_version_alpha_beta``; NULL when it does not parse."""
    parts = F.split(name, "_")
    alpha = F.get(parts, F.lit(2)).try_cast("double")
    beta = F.get(parts, F.lit(3)).try_cast("double")
    ok = alpha.isNotNull() & beta.isNotNull()
    return F.when(ok, F.struct(F.get(parts, F.lit(1)).alias("version"), alpha.alias("alpha"), beta.alias("beta")))

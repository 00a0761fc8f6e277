"""Reading, cleaning and normalising generated answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions.core import (
    as_col,
    let,
    literal_pattern,
    none_if_empty,
    sentences,
    sorted_distinct,
    strip,
)


def _is_object(text: Column) -> Column:
    return strip(text).startswith("{")


def _json(text: Column) -> Column:
    """The text as the one element of a JSON array, NULL if malformed: text after the closing
    brace then makes the whole malformed too."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(wrapped, "$[1]", "variant").isNull(), wrapped)


def _read(response: Column) -> Column:
    """struct<text, json, open>: the answer, its JSON if it has any, and whether it opens like an
    object. JSON is only read where it can be there, and once."""
    opens = _is_object(response)
    return F.struct(response.alias("text"), F.when(opens, _json(response)).alias("json"), opens.alias("open"))


def _field(r: Column, name: str) -> Column:
    return F.try_variant_get(r["json"], f"$[0].{name}", "string")


def parse_move_response(response: Column, allowed: Column) -> Column:
    """The ``move`` of a JSON answer, else the first allowed four-character move in the text.

    An answer that opens like JSON but does not parse gives NULL.
    """

    def first_allowed(r: Column) -> Column:
        found = F.regexp_extract_all(F.lower(r["text"]), F.lit(rf"\b{K.UCI_PLAIN}\b"), F.lit(0))
        return F.try_element_at(F.array_intersect(found, allowed), F.lit(1))

    def move(r: Column) -> Column:
        named = strip(F.lower(_field(r, "move")))
        usable = (F.length(named) == 4) & F.array_contains(allowed, named)
        return F.when(r["open"] & r["json"].isNull(), F.lit(None).cast("string")).otherwise(
            F.coalesce(F.when(usable, named), first_allowed(r))
        )

    return let(_read(response), move)


def parse_explanation_response(response: Column) -> Column:
    """The ``explanation`` of a JSON answer, else what follows the first colon of the line that
    holds ``explanation:``."""

    def explanation(r: Column) -> Column:
        told = F.regexp_extract(r["text"], r"(?im)^(?=.*explanation:)[^:]*:(.*)$", 1)
        has_line = F.contains(F.lower(r["text"]), F.lit("explanation:"))
        return F.when(r["open"], _field(r, "explanation")).otherwise(F.when(has_line, strip(told)))

    return let(_read(response), explanation)


def parse_verdict(response: Column) -> Column:
    """The ``verdict`` of a JSON answer, else the first of four keywords by rank."""

    def by_keyword(text: Column) -> Column:
        return F.coalesce(*[F.when(text.contains(v), v) for v in K.VERDICTS], F.lit("parse_error"))

    def verdict(r: Column) -> Column:
        named = F.lower(F.coalesce(_field(r, "verdict"), F.lit("unknown")))
        return F.when(r["json"].isNotNull(), named).otherwise(by_keyword(F.lower(r["text"])))

    return let(_read(response), verdict)


def parse_labelled_lines(response: Column, labels: tuple[str, str] = ("move: ", "explanation: ")) -> Column:
    """struct<move, explanation> from the first two lines; both NULL when there is one line only."""
    lines = F.split(strip(response), "\n")

    def value(i: int) -> Column:
        after = F.substring_index(F.get(lines, F.lit(i)), labels[i], -1)
        return F.when(F.size(lines) > 1, strip(after))

    return F.struct(value(0).alias("move"), value(1).alias("explanation"))


def parse_reasoning(response: Column) -> Column:
    """struct<explanation, move> of ``Reasoning: ... Move: ...``; the move defaults to ``0000``."""
    parts = F.split(response, literal_pattern("Move:"))
    move = F.regexp_extract(F.get(parts, F.lit(1)), r"^\s*(\S+)", 1)
    ok = F.coalesce(move != "", F.lit(False))
    reason = strip(F.replace(F.get(parts, F.lit(0)), F.lit("Reasoning:"), F.lit("")))
    return F.struct(
        F.when(ok, reason).otherwise(response).alias("explanation"),
        F.when(ok, move).otherwise("0000").alias("move"),
    )


def _end_mark(t: Column) -> Column:
    return F.when((t == "") | t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def _one_line(t: Column) -> Column:
    return strip(F.replace(strip(F.regexp_replace(t, r"\s\s+", " ")), F.lit("\n"), F.lit(" ")))


def _first_sentences(t: Column, n: int) -> Column:
    return F.array_join(F.slice(sentences(t), 1, n), " ")


def clean_explanation(raw: Column, instruction: Column | None = None, max_sentences: int = 4) -> Column:
    """Teacher text without its opening phrase or an echo of the task, cut to whole sentences."""
    prefixes = "|".join(literal_pattern(p) for p in K.CLEANER_PREFIXES)
    echoes = "|".join(literal_pattern(p) for p in K.CLEANER_ECHOES)
    text = strip(F.regexp_replace(strip(raw), rf"(?i)^\s*(?:{prefixes})\s*", ""))
    if instruction is not None:
        first_line = strip(F.get(F.split(instruction, "\n"), F.lit(0)))

        def drop_echo(t: Column) -> Column:
            echoed = (first_line != "") & F.startswith(F.lower(t), F.lower(first_line))
            rest = strip(F.substring(t, F.length(first_line) + 1, F.length(t)))
            other = strip(F.regexp_replace(t, rf"(?i)^\s*(?:{echoes})\s*", ""))
            return F.when(instruction.isNull() | (instruction == ""), t).when(echoed, rest).otherwise(other)

        text = let(text, drop_echo)
    cut = let(text, lambda t: F.when(t == "", strip(raw)).otherwise(_first_sentences(t, max_sentences)))
    return _one_line(let(cut, _end_mark))


def strip_boilerplate(raw: Column) -> Column:
    """Scorer-side clean-up: every known opening in turn, then every known echo in turn."""
    t = strip(raw)
    for prefix in K.SCORER_PREFIXES:
        t = F.regexp_replace(t, rf"(?is)^\s*{prefix}\s*", "")
    t = strip(t)
    for echo in K.SCORER_ECHOES:
        t = F.regexp_replace(t, rf"(?is)^\s*{echo}\s*(?:\[assistant\]\s*)?", "")
    return strip(t)


def _first_word(t: Column) -> Column:
    return F.get(F.split(t, " "), F.lit(0))


def _predicted_move(t: Column) -> Column:
    word = _first_word(t)
    return F.coalesce(
        none_if_empty(F.regexp_extract(t, rf"\b({K.UCI})\b", 1)),
        none_if_empty(F.regexp_extract(t, K.ANSWER_SAN, 0)),
        none_if_empty(F.regexp_extract(t, rf"(?iu){K.MOVE_PHRASES}\s*{K.ANSWER_NOTATION}\b", 1)),
        none_if_empty(F.regexp_extract(t, rf"(?i){K.ANSWER_NOTATION}\.\s*$", 1)),
        F.when(F.length(word).between(2, 7), word),
        F.lit(""),
    )


def _leading_move(t: Column) -> Column:
    """The older, simpler reading: a move at the very start, else the first word."""
    return F.coalesce(none_if_empty(F.regexp_extract(t, rf"^\s*({K.UCI})", 1)), _first_word(t))


def _piece(t: Column) -> Column:
    return F.coalesce(
        *[none_if_empty(F.regexp_extract(t, pattern, 1)) for pattern in K.ANSWER_PIECE],
        _first_word(t),
    )


def _one_of(t: Column, *answers: str) -> Column:
    hits = [F.when(t.rlike(rf"(?i)\b{a}\b"), a) for a in answers]
    return F.coalesce(*hits, none_if_empty(_first_word(t)), F.when(t == "", "Unknown"), F.lit(""))


def _explanation(t: Column) -> Column:
    return let(_first_sentences(t, 4), _end_mark)


def normalize_answer(
    task: Column | str, raw: Column, is_explanation: Column | bool = False, simple_moves: bool = False
) -> Column:
    """The part of a generated answer that is compared with the reference, by task."""
    kind = F.lower(as_col(task))
    explained = F.lit(is_explanation) if isinstance(is_explanation, bool) else is_explanation
    moves = _leading_move if simple_moves else _predicted_move

    def by_task(t: Column) -> Column:
        listed = F.regexp_extract_all(t, F.lit(K.UCI), F.lit(0))
        best = F.regexp_extract(t, rf"^\s*({K.SAN_CORE})\b", 1)
        general = _one_line(F.when(explained, _explanation(t)).otherwise(t))
        return (
            F.when(kind == "predict_move", moves(t))
            .when(kind == "identify_piece", _piece(t))
            .when(kind == "identify_color", _one_of(t, "White", "Black"))
            .when(kind.isin(K.YES_NO_TASKS), _one_of(t, "Yes", "No"))
            .when(kind == "list_legal_moves", F.array_join(sorted_distinct(listed), " "))
            .when(kind.isin(K.BEST_MOVE_TASKS), F.coalesce(none_if_empty(best), _first_word(t)))
            .otherwise(strip(F.regexp_replace(general, r"(?i)^\[assistant\]", "")))
        )

    return let(strip_boilerplate(raw), by_task)

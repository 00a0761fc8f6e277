"""Archive text, move notation and board strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions.core import let, none_if_empty, strip

HEADER_LINE = r'(?m)^\[[^\S\n]*(\w+)[^\S\n]*"(.*)"[^\S\n]*\]'
COMMENT = r"\{[^}]*\}"


def parse_headers(text: Column) -> Column:
    """Map of ``[Key "Value"]`` lines; a repeated key keeps its last value."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(HEADER_LINE), F.lit(1)).alias("k"),
        F.regexp_extract_all(text, F.lit(HEADER_LINE), F.lit(2)).alias("v"),
    )

    def last_wins(f: Column) -> Column:
        keys = f["k"]
        pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.get(f["v"], i).alias("v")))
        kept = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))
        return F.map_from_entries(kept)

    return let(found, last_wins)


def parse_eval(text: Column) -> Column:
    """Pawns to centipawns; ``#n`` to mate scores; anything else to NULL."""
    top = F.lit(float(K.MATE_SCORE))

    def mate_score(t: Column) -> Column:
        n = F.substring(t, 2, 20).try_cast("int")
        signed = (top - F.abs(n)) * F.signum(n.cast("double"))
        return F.when(t == "#0", top).when(n == 0, -top).otherwise(signed)

    def score(t: Column) -> Column:
        pawns = F.regexp_extract(t, r"^\+*(-?(?:\d+\.?\d*|\.\d+))$", 1)
        return F.when(t.rlike(r"^#[+-]?\d+$"), mate_score(t)).otherwise(none_if_empty(pawns).try_cast("double") * 100)

    return let(strip(text), score)


def parse_annotations(text: Column) -> Column:
    """struct<eval_cp, clock, comment> of the text that follows a move."""
    bare = F.regexp_replace(text, K.ANY_TAG, "")
    spans = F.regexp_extract_all(bare, F.lit(r"(?s)\{(.*?)\}"), F.lit(1))
    kept = F.filter(F.transform(spans, strip), lambda c: c != "")
    return F.struct(
        parse_eval(F.regexp_extract(text, K.EVAL_TAG, 1)).alias("eval_cp"),
        none_if_empty(F.regexp_extract(text, K.CLOCK_TAG, 1)).alias("clock"),
        none_if_empty(F.array_join(kept, " ")).alias("comment"),
    )


def clock_seconds(clock: Column) -> Column:
    """``H:MM:SS`` or ``MM:SS`` as seconds."""
    parts = F.transform(F.split(clock, ":"), lambda p: p.try_cast("int"))
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc * 60 + p)


def comments_in(text: Column) -> Column:
    """Every ``{...}`` span, trimmed, that passes `is_valid_comment`."""
    spans = F.regexp_extract_all(text, F.lit(r"(?s)\{(.*?)\}"), F.lit(1))
    return F.filter(F.transform(spans, strip), is_valid_comment)


def is_valid_comment(comment: Column) -> Column:
    c = strip(comment)
    return (c != "") & ~c.startswith("[%eval") & ~c.startswith("[%clk")


def quality_label(nag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.QUALITY.items() for x in pair])
    return F.try_element_at(table, nag)


def classify_move(san: Column) -> Column:
    """struct<outcome, special_move> read off the marks in the notation."""
    promoted = F.regexp_extract(san, "=([NBRQK])", 1)
    return F.struct(
        F.when(san.contains("#"), "Checkmate")
        .when(san.contains("+"), "Check")
        .when(san.contains("x"), "Capture")
        .alias("outcome"),
        F.when(promoted != "", F.concat(F.lit("Promotion to "), promoted))
        .when(san.startswith("O-O-O"), "Queenside Castling")
        .when(san.startswith("O-O"), "Kingside Castling")
        .alias("special_move"),
    )


def without_variations(text: Column) -> Column:
    """The text without what stands in parentheses outside comments, however deep. Parentheses that do
    not match leave the text as it is."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{COMMENT}|[()]|[^(){{}}]+|[{{}}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"), F.array().cast("array<string>").alias("kept"))

    def step(seen: Column, piece: Column) -> Column:
        turn = F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0)
        outside = (seen["depth"] == 0) & (turn == 0)
        return F.struct(
            (seen["depth"] + turn).alias("depth"), (seen["bad"] | (seen["depth"] + turn < 0)).alias("bad"),
            F.when(outside, F.concat(seen["kept"], F.array(piece))).otherwise(seen["kept"]).alias("kept"),
        )

    def joined(seen: Column) -> Column:
        return F.when((seen["depth"] != 0) | seen["bad"], text).otherwise(F.array_join(seen["kept"], ""))

    return F.when(F.contains(text, F.lit("(")) | F.contains(text, F.lit(")")), let(F.aggregate(pieces, start, step), joined)).otherwise(text)


def strip_movetext(text: Column) -> Column:
    """Drop the result mark and the variations that stand outside comments."""
    t = F.regexp_replace(text, r"\s*(?:1-0|0-1|1/2-1/2|\*)\s*$", "")
    return strip(F.regexp_replace(let(t, without_variations), r"\s+", " "))


# Comments come first so that a move named inside one is never taken for a ply.
_MOVE = (
    rf"(?:(\d+)\s*\.{{1,3}}\s*)?({K.SAN_CORE})([+#]*)([?!]{{0,2}})([+#]*)"
    rf"((?:\s*(?:{COMMENT}|\[[^\]]*\]))*)"
)
_SCAN = rf"{COMMENT}|{_MOVE}"


def movetext_plies(movetext: Column, fen: Column | None = None) -> Column:
    """array<struct<ply, move_number, side, san, nag, suffix, annotation>> of one game's movetext.

    The side alternates from the side to move in ``fen``; a number in the text wins over counting.
    """
    start = F.lit(K.START_FEN) if fen is None else F.coalesce(fen, F.lit(K.START_FEN))
    opening = F.struct(
        (side_to_move(start) == "b").cast("int").alias("black"),
        F.coalesce(F.get(F.split(start, " "), F.lit(5)).try_cast("int"), F.lit(1)).alias("number"),
    )
    found = F.filter(
        F.regexp_extract_all(strip_movetext(movetext), F.lit(_SCAN), F.lit(0)),
        lambda t: ~t.startswith("{"),
    )

    def parts(token: Column) -> Column:
        names = ["number", "core", "mark", "nag", "late_mark", "note"]
        return F.struct(*[F.regexp_extract(token, f"^{_MOVE}", i + 1).alias(n) for i, n in enumerate(names)])

    def ply(first: Column, p: Column, i: Column) -> Column:
        # A failed cast costs far more than this test, and half of all moves have no number.
        written = none_if_empty(p["number"]).try_cast("int")
        return F.struct(
            i.alias("ply"),
            F.coalesce(
                F.when(written > 0, written), first["number"] + F.floor((i + first["black"]) / 2).cast("int")
            ).alias("move_number"),
            F.when((i + first["black"]) % 2 == 0, "w").otherwise("b").alias("side"),
            F.concat(p["core"], p["mark"], p["nag"], p["late_mark"]).alias("san"),
            none_if_empty(p["nag"]).alias("nag"),
            none_if_empty(F.concat(p["mark"], p["late_mark"])).alias("suffix"),
            strip(p["note"]).alias("annotation"),
        )

    return let(opening, lambda first: F.transform(F.transform(found, parts), lambda p, i: ply(first, p, i)))


def unread_movetext(movetext: Column) -> Column:
    """What is left of a movetext once moves, numbers, comments and ``$n`` marks are taken out."""
    rest = F.regexp_replace(strip_movetext(movetext), rf"{_SCAN}|\$\d+|\d+\s*\.{{1,3}}", " ")
    return none_if_empty(strip(rest))


def best_move_from_comment(comment: Column) -> Column:
    return none_if_empty(F.regexp_extract(comment, K.BEST_MOVE, 1))


def mentions(comment: Column, phrase: str = K.MATE_PHRASE) -> Column:
    return F.coalesce(F.contains(F.lower(comment), F.lit(phrase)), F.lit(False))


def is_informative(comment: Column, best: Column, min_len: int = 10) -> Column:
    return F.coalesce((F.length(comment) > min_len) & best.isNull(), F.lit(False))


def side_to_move(fen: Column) -> Column:
    return F.get(F.split(fen, " "), F.lit(1))


SQUARES = [f"{f}{r}" for r in range(8, 0, -1) for f in "abcdefgh"]  # in the order of a board field


def board_squares(fen: Column) -> Column:
    """array<struct<square, piece, color>> with one entry per square of the board field."""
    board = F.replace(F.get(F.split(fen, " "), F.lit(0)), F.lit("/"), F.lit(""))
    for n in range(1, 9):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    return F.zip_with(
        F.split(board, ""), F.array(*[F.lit(s) for s in SQUARES]),
        lambda p, square: F.struct(
            square.alias("square"),
            F.when(p != ".", F.upper(p)).alias("piece"),
            F.when(p == ".", F.lit(None)).when(p == F.upper(p), "White").otherwise("Black").alias("color"),
        ),
    )


def scores_agree(
    a: Column, b: Column, threshold: float = 50.0, mate_floor: float = K.MATE_FLOOR
) -> Column:
    """A missing side agrees; two mate scores must be equal; others may differ by ``threshold``."""
    both_mate = (F.abs(a) > mate_floor) & (F.abs(b) > mate_floor)
    return (
        F.when(a.isNull() | b.isNull(), True).when(both_mate, a == b).otherwise(F.abs(a - b) <= threshold)
    )

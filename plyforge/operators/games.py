"""Games, plies and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions import notation as N
from plyforge.functions.core import let, none_if_empty


def with_headers(df: DataFrame, text: str = "header_text") -> DataFrame:
    return df.withColumn("headers", N.parse_headers(F.col(text)))


def passes_filter(
    result: Column, variant: Column, white_elo: Column, black_elo: Column, *, skip_unfinished: bool = False,
    only_standard: bool = False, only_complete: bool = False, min_elo: int | None = None,
    max_elo: int | None = None,
) -> Column:
    """Whether a game passes every switched-on test; a missing or bad rating counts as 0."""
    keep = F.lit(True)
    white = F.coalesce(white_elo.try_cast("int"), F.lit(0))
    black = F.coalesce(black_elo.try_cast("int"), F.lit(0))
    if skip_unfinished:
        keep = keep & F.coalesce(result != "*", F.lit(True))
    if only_standard:
        keep = keep & (F.lower(F.coalesce(variant, F.lit("Standard"))) == "standard")
    if only_complete:
        keep = keep & F.coalesce(result.isin(K.RESULTS), F.lit(False))
    if min_elo is not None:
        keep = keep & (white >= min_elo) & (black >= min_elo)
    if max_elo is not None:
        keep = keep & (white <= max_elo) & (black <= max_elo)
    return keep


def filter_games(df: DataFrame, headers: str = "headers", **switches) -> DataFrame:
    """Keep games whose tags pass. The tag map is bound once, since a filter that moves below the
    projection that makes the map would otherwise parse the header for every tag."""

    def test(tags: Column) -> Column:
        return passes_filter(*[F.try_element_at(tags, F.lit(t)) for t in ("Result", "Variant", "WhiteElo", "BlackElo")],
                             **switches)

    return df.where(let(F.col(headers), test))


def game_record(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Add the game's fields: a missing rating is 0, a bad one NULL."""

    def fields(tags: Column) -> Column:
        def tag(name: str) -> Column:
            return F.try_element_at(tags, F.lit(name))

        def elo(name: str) -> Column:
            return F.coalesce(tag(name), F.lit("0")).try_cast("int")

        return F.struct(
            F.coalesce(tag("FEN"), F.lit(K.START_FEN)).alias("fen"),
            tag("Result").alias("result"),
            elo("WhiteElo").alias("white_elo"),
            elo("BlackElo").alias("black_elo"),
            tag("ECO").alias("eco"),
            F.coalesce(tag("Variant"), F.lit("Standard")).alias("variant"),
            F.coalesce(none_if_empty(tag("GameURL")), tag("Site")).alias("game_url"),
        )

    return df.withColumn("_game", let(F.col(headers), fields)).select("*", "_game.*").drop("_game")


def with_plies(df: DataFrame, text: str = "movetext", fen: str | None = None) -> DataFrame:
    """Add ``plies``: the game's moves as one array, still one row per game."""
    return df.withColumn("plies", N.movetext_plies(F.col(text), F.col(fen) if fen else None))


def tokenize_movetext(
    df: DataFrame, id: str, text: str, on_bad: str = "drop_game", fen: str | None = None
) -> DataFrame:
    """One row per half-move. A game with text that reads as no move is dropped whole, or keeps its
    readable moves with ``on_bad='skip_move'``."""
    games = df.where(N.unread_movetext(F.col(text)).isNull()) if on_bad == "drop_game" else df
    plies = N.movetext_plies(F.col(text), F.col(fen) if fen else None)
    return games.select(id, F.inline(plies))


def with_move_facts(df: DataFrame) -> DataFrame:
    """Add quality, outcome, special move, score, clock and comment to tokenised plies."""
    seen = N.parse_annotations(F.col("annotation"))
    kind = N.classify_move(F.col("san"))
    return (
        df.withColumns({"_a": seen, "_k": kind, "quality": N.quality_label(F.col("nag"))})
        .select("*", "_a.*", "_k.*")
        .drop("_a", "_k")
    )


def pair_moves(
    df: DataFrame, group: str, number: Column, is_white: Column, cols: list[str]
) -> DataFrame:
    """DataFrame[group, move_number, white, black] from one row per half-move."""
    move = F.struct(*cols)
    return df.groupBy(group, number.alias("move_number")).agg(
        F.max(F.when(is_white, move)).alias("white"), F.max(F.when(~is_white, move)).alias("black")
    )


def require(df: DataFrame, cols: list[str], arrays: list[str] | None = None) -> DataFrame:
    """Rows in which the named columns are there and not blank, and the arrays hold something."""
    for c in cols:
        df = df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    for c in arrays or []:
        df = df.where(F.size(c) > 0)
    return df


def half_move_index(
    df: DataFrame, group: str, order: str, uci: str, name: str = "half_move", chunk: int = 4096
) -> DataFrame:
    """Number of earlier rows of the group that have a move.

    Rows are counted inside chunks of the numeric order, so a group of any size is spread over many
    tasks; only groups longer than one chunk have rows in the table of chunk starts.
    """
    parts = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    inside = Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_seen", F.count(uci).over(inside))
    sizes = parts.groupBy(group, "_chunk").agg(F.count(uci).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.sum("_n").over(earlier)).where(F.col("_start") > 0).drop("_n")
    total = F.col("_seen") + F.coalesce(F.col("_start"), F.lit(0))
    return local.join(starts, [group, "_chunk"], "left").withColumn(name, total).drop("_chunk", "_seen", "_start")


def history_token(number: Column, is_white: Column, san: Column, style: str = "plain",
                  opens_black: Column | None = None) -> Column:
    """One half-move as text. ``ellipsis`` marks a black move whose pair has no white move."""
    token = F.when(is_white, F.concat(number.cast("string"), F.lit(". "), san)).otherwise(san)
    if style == "ellipsis" and opens_black is not None:
        token = F.when(opens_black & ~is_white, F.concat(number.cast("string"), F.lit("... "), san)).otherwise(token)
    return token


def recent_history(
    df: DataFrame, group: str, order: str, token: str, n: int = K.HISTORY_LEN, name: str = "history",
    chunk: int = 4096,
) -> DataFrame:
    """Add the last ``n`` tokens before each row, joined by spaces.

    ``order`` counts 0, 1, 2, ... inside the group (see `half_move_index`). Rows are worked on in
    chunks of it, of ``n`` rows at least; a chunk's last ``n`` rows are copied to the next chunk, where
    they are only read.
    """
    at, chunk = F.col(order), max(chunk, n, 1)
    home = F.floor(at / chunk)
    homes = F.when(at % chunk >= chunk - n, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_chunk", F.explode(homes))
    w = Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(-n, -1)
    seen = spread.withColumn(name, F.array_join(F.collect_list(token).over(w), " "))
    return seen.where(F.col("_chunk") == home).drop("_chunk")


def score_outcome(existing: Column, supplied: Column, threshold: float = 50.0) -> Column:
    """filled, validated, mismatch, kept or missing."""
    agree = N.scores_agree(existing, supplied, threshold)
    return (
        F.when(existing.isNull() & supplied.isNull(), "missing")
        .when(existing.isNull(), "filled")
        .when(supplied.isNull(), "kept")
        .when(agree, "validated")
        .otherwise("mismatch")
    )


def fill_scores(
    plies: DataFrame, scores: DataFrame, key: str, overwrite: bool = False, threshold: float = 50.0,
    computed: DataFrame | None = None,
) -> DataFrame:
    """Left-join supplied scores (unique by key, column ``value``): fill missing ones, check the
    others, and replace them when ``overwrite`` is set. ``computed`` are new scores for keys that
    ``scores`` does not hold; ``recomputed`` marks the rows that took one of them."""
    supplied = scores.select(key, F.col("value").alias("_held"))
    joined = plies.join(supplied, key, "left")
    if computed is None:
        joined = joined.withColumn("_new", F.lit(None).cast("double"))
    else:
        joined = joined.join(new_scores(scores, computed, key).withColumnRenamed("value", "_new"), key, "left")
    old, new = F.col("eval_cp"), F.coalesce("_held", "_new")
    joined = joined.withColumn("score_status", score_outcome(old, new, threshold))
    chosen = F.coalesce(new, old) if overwrite else F.coalesce(old, new)
    marked = joined.withColumn("recomputed", F.col("_held").isNull() & F.col("_new").isNotNull())
    return marked.withColumn("eval_cp", chosen).drop("_held", "_new")


def score_counters(filled: DataFrame, by: str | list[str], had_score: Column) -> DataFrame:
    """How many scores were there, checked, found wrong, newly computed and filled, from rows of
    `fill_scores`."""
    status = F.col("score_status")
    return ingest_counters(filled, by, {
        "moves_total": F.lit(1),
        "moves_with_pgn_eval": had_score,
        "moves_validated": status.isin("validated", "mismatch"),
        "moves_mismatch": status == "mismatch",
        "moves_recomputed": F.col("recomputed"),
        "moves_missing_eval": status == "filled",
    })


def new_scores(scores: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Computed scores that the score table does not hold yet, one per key."""
    once = computed.where(F.col("value").isNotNull()).groupBy(key).agg(F.min("value").alias("value"))
    return once.join(scores, key, "left_anti")


def attach_positions(plies: DataFrame, positions: DataFrame, on: list[str], on_bad: str = "keep") -> DataFrame:
    """Join supplied board facts. With ``on_bad='drop_game'`` a game is dropped whole when one of its
    plies has no facts (an illegal move has none); with ``skip_move`` only such plies are."""
    if on_bad == "skip_move":
        return plies.join(positions, on, "inner")
    if on_bad == "drop_game":
        bad = plies.join(positions, on, "left_anti").select(on[0]).distinct()
        plies = plies.join(bad, on[0], "left_anti")
    return plies.join(positions, on, "left")


def attach_moves(plies: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Join supplied board facts and coordinate moves (column ``uci``) to plies that were read from
    notation alone. A ply without facts stays, with NULLs; a coordinate move that it has is kept."""
    supplied = facts.withColumnRenamed("uci", "_uci")
    joined = plies.join(supplied, on, "left")
    return joined.withColumn("uci", F.coalesce("uci", "_uci")).drop("_uci")


def ingest_counters(df: DataFrame, by: str | list[str], counters: dict[str, Column]) -> DataFrame:
    """Sums of numbers or conditions per file, then over all files: there the file is NULL and ``level``
    above 0 (with several keys it tells the subtotals apart, as ``grouping_id`` does). The second step
    adds up the per-file sums instead of reading the rows twice."""
    keys = [by] if isinstance(by, str) else by
    sums = [F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias(n) for n, c in counters.items()]
    per_file = df.groupBy(*keys).agg(*sums)
    return per_file.rollup(*keys).agg(F.grouping_id().cast("long").alias("level"), *[F.sum(n).alias(n) for n in counters])

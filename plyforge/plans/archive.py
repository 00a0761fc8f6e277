"""Archive files to games and plies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions import notation as N
from plyforge.functions.core import let
from plyforge.operators import games as G
from plyforge.sources.archive import read_games


def archive_games(spark: SparkSession, path: str | list[str], on_bad: str = "drop_game", **switches) -> DataFrame:
    """One row per kept game with its fields and its ``plies`` array.

    Games are filtered on their tags before any move is read. Nothing is shuffled.
    """
    games = G.filter_games(G.with_headers(read_games(spark, path)), **switches)
    if on_bad == "drop_game":
        games = games.where(N.unread_movetext(F.col("movetext")).isNull())
    return G.with_plies(G.game_record(games), fen="fen").drop("header_text", "movetext")


def archive_counters(spark: SparkSession, path: str | list[str], on_bad: str = "drop_game", **switches) -> DataFrame:
    """Games found, filtered out, unreadable and kept, and moves and scored moves, per file and in all,
    of what `archive_games` gives with the same arguments.

    Rejected games count nothing further; their moves are not read. With ``on_bad='skip_move'`` a game
    with unreadable text is kept, and only what is read of it counts.
    """
    games = G.with_headers(read_games(spark, path))
    tags = F.col("headers")
    passed = let(tags, lambda t: G.passes_filter(
        *[F.try_element_at(t, F.lit(n)) for n in ("Result", "Variant", "WhiteElo", "BlackElo")], **switches))
    judged = games.select("file", "movetext", passed.alias("passed"))
    whole = N.unread_movetext(F.col("movetext")).isNull() if on_bad == "drop_game" else F.lit(True)
    plies = F.when(F.col("read"), N.movetext_plies(F.col("movetext")))
    moves = judged.withColumn("read", F.col("passed") & whole).withColumn("notes", F.transform(plies, lambda p: p["annotation"]))
    scored = F.filter("notes", lambda a: N.parse_annotations(a)["eval_cp"].isNotNull())
    return G.ingest_counters(moves, "file", {
        "games_found": F.lit(1),
        "games_filtered_out": ~F.col("passed"),
        "games_skipped_parsing_error": F.col("passed") & ~F.col("read"),
        "games_processed": F.col("read"),
        "moves_total": F.size("notes"),
        "moves_with_pgn_eval": F.size(scored),
    })


def _move(ply: Column) -> Column:
    note, kind = N.parse_annotations(ply["annotation"]), N.classify_move(ply["san"])
    return F.struct(
        ply["san"].alias("san"), F.lit(None).cast("string").alias("uci"),
        kind["outcome"].alias("outcome"), kind["special_move"].alias("special_move"),
        N.quality_label(ply["nag"]).alias("quality"), note["eval_cp"].alias("eval_cp"),
        note["clock"].alias("clock"), note["comment"].alias("comment"),
    )


def nested_games(games: DataFrame) -> DataFrame:
    """The nested document form: ``game_metadata`` with move pairs in ``pgn``, and two empty lists.

    A pair opens at a white move, or at a black one that follows no white move. Plies alternate, so
    a ply's pair is found by its position and the pairs are built inside the row.
    """

    def pgn_of(plies: Column) -> Column:
        skip = F.when(F.get(plies, F.lit(0))["side"] == "b", 1).otherwise(0)
        pairs = F.floor((F.size(plies) + skip + 1) / 2).cast("int")

        def at(i: Column) -> Column:
            ply = F.get(plies, i)
            return F.when(ply.isNotNull(), _move(ply))

        def pair(p: Column) -> Column:
            white, black = p * 2 - skip, p * 2 + 1 - skip
            number = F.coalesce(F.get(plies, white)["move_number"], F.get(plies, black)["move_number"])
            return F.struct(
                number.alias("move_number"),
                F.when(white >= 0, at(white)).alias("white_move"),
                at(black).alias("black_move"),
            )

        return F.when(F.size(plies) > 0, F.transform(F.sequence(F.lit(0), pairs - 1), pair))

    pgn = let(F.col("plies"), pgn_of)
    none = F.array().cast("array<string>")
    return games.select(
        F.struct("fen", "result", "white_elo", "black_elo", "eco", "variant", "game_url", pgn.alias("pgn")).alias("game_metadata"),
        none.alias("synthetic_data"), none.alias("distilled_data"),
    )


def _with_history(plies: Column, n: int, style: str, number: str = "ply") -> Column:
    """array<struct<ply, history>>: each half-move with the text of the ``n`` before it, cut from the
    game's own array."""

    def token(p: Column) -> Column:
        return G.history_token(p["move_number"], p["side"] == "w", p["san"], style, p[number] == 0)

    def with_text(game: Column) -> Column:
        def before(p: Column, i: Column) -> Column:
            first = F.greatest(i - n, F.lit(0))
            text = F.array_join(F.slice(game["tokens"], first + 1, i - first), " ")
            return F.struct(p.alias("ply"), text.alias("history"))

        return F.transform(game["plies"], before)

    game = let(plies, lambda a: F.struct(a.alias("plies"), F.transform(a, token).alias("tokens")))
    return let(game, with_text)


def plies_with_history(
    games: DataFrame, keep: list[str], n: int = K.HISTORY_LEN, style: str = "plain", plies: str = "plies"
) -> DataFrame:
    """One row per half-move with the ``history`` text of the ``n`` before it. Nothing is shuffled."""
    rows = games.select(*keep, F.explode(_with_history(F.col(plies), n, style)).alias("_r"))
    return rows.select(*keep, "_r.ply.*", "_r.history")


def with_game_key(nested: DataFrame, name: str = "game_id") -> DataFrame:
    """Add a key made from the start position and the moves; copies of a game share it."""
    return nested.withColumn(name, F.md5(F.to_json(F.struct("game_metadata.fen", "game_metadata.pgn"))))


def listed_moves(nested: DataFrame) -> Column:
    """array<struct<half_move, move_number, side, ...>> of a game's moves."""
    fields = ["san", "uci", "outcome", "special_move", "quality", "eval_cp", "clock", "comment"]

    def rows(pair: Column) -> Column:
        def one(name: str, side: str) -> Column:
            m = pair[name]
            cells = [m[f].alias(f) for f in fields]
            return F.when(m.isNotNull(), F.struct(pair["move_number"].alias("move_number"), F.lit(side).alias("side"), *cells))

        return F.array(one("white_move", "w"), one("black_move", "b"))

    flat = F.array_compact(F.flatten(F.transform("game_metadata.pgn", rows)))
    moves = F.filter(flat, lambda m: F.length(m["san"]) > 0)
    names = ["move_number", "side", *fields]
    return F.transform(moves, lambda m, i: F.struct(i.alias("half_move"), *[m[f].alias(f) for f in names]))


def flat_plies(nested: DataFrame, id: str = "game_id", n: int = K.HISTORY_LEN, style: str = "plain") -> DataFrame:
    """One row per half-move of nested games, with its fields, half-move index and history. Games without
    a start position or moves give none. Coordinate moves that the games lack are supplied afterwards, see
    `attach_moves`."""
    games = nested.where(F.col("game_metadata.fen").isNotNull() & (F.size("game_metadata.pgn") > 0))
    if id not in games.columns:
        games = with_game_key(games, id)
    rows = games.select(id, F.explode(_with_history(listed_moves(games), n, style, "half_move")).alias("_r"))
    return rows.select(id, "_r.ply.*", "_r.history")


def position_requests(nested: DataFrame, id: str = "game_id") -> DataFrame:
    """DataFrame[id, fen, moves]: what a rules engine outside needs to supply board facts and coordinate
    moves: start position and moves as written, one row per different game."""
    games = nested if id in nested.columns else with_game_key(nested, id)
    moves = F.transform(listed_moves(games), lambda m: m["san"])
    return games.select(id, F.col("game_metadata.fen").alias("fen"), moves.alias("moves")).dropDuplicates([id])

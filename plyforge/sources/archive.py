"""Game archives and plain comment scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import notation as N
from plyforge.functions.core import strip
from plyforge.sources import ranges
from plyforge.sources.tables import file_path


def split_games(df: DataFrame, text: str = "value") -> DataFrame:
    """One row per game of a text that may hold several: a game starts at ``[Event`` after a blank
    line. Text that does not start with ``[Event`` is dropped."""
    games = F.split(strip(F.col(text)), r"\n\s*\n(?=\[Event)")
    return df.withColumn(text, F.explode(games)).where(F.startswith(strip(F.col(text)), F.lit("[Event")))


def _pieces(spark: SparkSession, path: str | list[str], newline: str | None = None) -> DataFrame:
    """DataFrame[file, value]: one row per game, one large file read by many tasks (see `ranges`). Line ends may
    differ within a file; ``newline`` is not needed any more."""
    return ranges.archive_texts(spark, path, file_path())


def read_games(spark: SparkSession, path: str | list[str], newline: str | None = None) -> DataFrame:
    """DataFrame[file, game_id, header_text, movetext] with one row per game.

    A game starts where ``[Event`` follows a blank line outside comments; text before a file's first one is
    dropped. ``game_id`` is unique within one read. ``newline`` is not needed any more.
    """
    halves = F.split(strip(F.col("value")), "\n\n", 2)
    games = _pieces(spark, path).where(F.startswith(strip(F.col("value")), F.lit("[Event")))
    return games.select(
        "file",
        F.monotonically_increasing_id().alias("game_id"),
        F.get(halves, F.lit(0)).alias("header_text"),
        strip(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("movetext"),
    )


def count_event_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """DataFrame[file, games] counting the lines that open a game."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("[Event ")))
    return lines.groupBy(file_path().alias("file")).agg(F.count("*").alias("games"))


def extract_comments(df: DataFrame, text: str = "value") -> DataFrame:
    """One row per valid ``{...}`` comment, repeats kept; the text column is replaced."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.explode(N.comments_in(F.col(text))).alias("comment"))


def read_comments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Comments of archive files, read game by game so that a large file is shared by many tasks."""
    return extract_comments(_pieces(spark, path).select("value"), "value")

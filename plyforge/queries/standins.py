"""Domain-shaped views that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.queries.registry import table
from plyforge.session import spread

GAME_LENGTH = 40  # events per derived game

# Moves, note marks and check marks that an event's numbers choose from.
SANS = ["e4", "Nf3", "Bxc4", "O-O", "e8=Q", "Qh7", "O-O-O", "Raxd1", "exd5", "b1=N"]
NAGS = {"signup": "!", "error": "??", "click": "", "purchase": "!?", "view": "?!"}
SQL_SANS = "['e4','Nf3','Bxc4','O-O','e8=Q','Qh7','O-O-O','Raxd1','exd5','b1=N']"

# One row per event: its game, its place in the game and the move it stands for.
SQL_MOVES = f"""
moves AS (
  SELECT event_id, event_id // {GAME_LENGTH} AS game_id,
         row_number() OVER (PARTITION BY event_id // {GAME_LENGTH} ORDER BY event_id) - 1 AS ply,
         ({SQL_SANS})[1 + k % 10]
           || CASE event_type WHEN 'signup' THEN '!' WHEN 'error' THEN '??' WHEN 'purchase' THEN '!?'
                              WHEN 'view' THEN '?!' ELSE '' END
           || CASE WHEN k % 7 = 0 THEN '+' WHEN k % 11 = 0 THEN '#' ELSE '' END AS san,
         CASE event_type WHEN 'signup' THEN '!' WHEN 'error' THEN '??' WHEN 'purchase' THEN '!?'
                         WHEN 'view' THEN '?!' END AS nag,
         CASE WHEN k % 7 = 0 THEN '+' WHEN k % 11 = 0 THEN '#' END AS suffix,
         event_type, value, k, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def event_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as moves: event_id, game_id, order inside the game, written move and its note text."""
    ev = table(spark, sf_dir, "events").withColumn("k", k_of())
    nag = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in NAGS.items() for x in p]), "event_type"), F.lit(""))
    mark = F.when(F.col("k") % 7 == 0, "+").when(F.col("k") % 11 == 0, "#").otherwise("")
    core = F.element_at(F.array(*[F.lit(s) for s in SANS]), (F.col("k") % 10 + 1).cast("int"))
    score = F.when(F.col("k") % 10 == 3, F.concat(F.lit("#-"), F.col("k").cast("string"))).otherwise(F.col("value").cast("string"))
    note = F.concat(
        F.lit("{[%eval "), score, F.lit("] [%clk 0:00:"), F.lpad((F.col("k") % 60).cast("string"), 2, "0"),
        F.lit("] "), F.col("event_type"), F.lit(" by "), F.col("user_id").cast("string"), F.lit("}"),
    )
    return ev.select(
        "event_id", F.floor(F.col("event_id") / GAME_LENGTH).alias("game_id"), "event_type", "value", "k", "user_id",
        F.concat(core, nag, mark).alias("san"), note.alias("note"),
    )


def event_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per derived game with its movetext. A game holds at most ``GAME_LENGTH`` events, so
    the lists gathered here are short whatever the size of the table."""
    moves = event_moves(spark, sf_dir)
    listed = moves.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "san", "note"))).alias("m"))
    body = F.transform(
        "m",
        lambda x, i: F.concat(
            F.when(i % 2 == 0, F.concat((i / 2 + 1).cast("int").cast("string"), F.lit(". "))).otherwise(""),
            x["san"], F.lit(" "), x["note"], F.when(i % 5 == 4, " (1. e4 {a (b)} e5)").otherwise(""),
        ),
    )
    return listed.select("game_id", F.concat(F.array_join(body, " "), F.lit(" 1-0")).alias("movetext"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive user and assistant turns: conv_id, turn, reference and prediction."""
    conv = table(spark, sf_dir, "conversations")
    user = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    reply = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return spread(user.join(reply, ["conv_id", "turn"]), "conv_id", "turn", like=conv)


SQL_PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS ref, a.text AS pred
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""

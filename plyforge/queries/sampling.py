"""Sampling, splitting, ordering and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.functions.core import pick, words
from plyforge.functions.prompts import with_choices
from plyforge.operators import games as G
from plyforge.operators import ordering as O
from plyforge.queries.registry import documents, query, table
from plyforge.queries.standins import SQL_MOVES, event_games, k_of


def sql_hash01(seed: str, rule: str, key: str) -> str:
    return f"CAST('0x' || substring(md5('{seed}|{rule}|' || {key}), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"""SELECT doc_id, source FROM documents WHERE {sql_hash01('42', 'predict_move', 'doc_id')} < 0.25""")
def hashed_sample(spark, sf_dir):
    rows = O.sample_by_hash(table(spark, sf_dir, "documents"), ["doc_id"], 0.25, 42, "predict_move")
    return rows.select("doc_id", "source")


@query(f"""
SELECT conv_id, turn, 'What is it?' || CASE WHEN {sql_hash01('42', 'hide_identify_color', "conv_id || '|' || turn")} >= 0.2
  THEN ' Choose: White, Black, None.' ELSE '' END AS question FROM conversations
""")
def hidden_choices(spark, sf_dir):
    q = with_choices(F.lit("What is it?"), " Choose: White, Black, None.", 42, "identify_color", F.col("conv_id"), F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("question"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1 AS place FROM documents""")
def shuffled_places(spark, sf_dir):
    """Place of every document in the shuffled order, ranked in parallel."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    key = F.concat_ws("|", F.md5(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string"))), F.col("doc_id").cast("string"))
    return O.global_index(docs.withColumn("h", key), "h", "place").select("doc_id", "place")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN i < CAST(floor(0.8 * n) AS BIGINT) THEN 'train'
  WHEN i < CAST(floor(0.8 * n) AS BIGINT) + CAST(floor(0.1 * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM r
""")
def exact_split(spark, sf_dir):
    return O.split_exact(table(spark, sf_dir, "documents"), "doc_id", seed=42).select("doc_id", "split")


@query("""SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 200""")
def fixed_sample(spark, sf_dir):
    return O.sample_n(table(spark, sf_dir, "documents"), "doc_id", 200, 42).select("doc_id", "lang")


@query(f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\s\\x0b]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, w[1 + CAST(floor({sql_hash01('42', 'pick', 'doc_id')} * len(w)) AS BIGINT)] AS word FROM t
""")
def picked_words(spark, sf_dir):
    """One word of each whole document, chosen by hash."""
    docs = documents(spark, sf_dir).select("doc_id", words(F.col("text")).alias("w"))
    return docs.select("doc_id", pick(F.col("w"), 42, F.col("doc_id")).alias("word"))


@query("""SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500 OFFSET 300""")
def event_slice(spark, sf_dir):
    return O.slice_rows(table(spark, sf_dir, "events"), "event_id", 300, 500).select("event_id", "event_type")


@query("""SELECT event_id, event_type FROM events ORDER BY event_id OFFSET 777""")
def event_tail_slice(spark, sf_dir):
    """A slice without an end, taken by position instead of an ordered limit."""
    return O.slice_rows(table(spark, sf_dir, "events"), "event_id", 777).select("event_id", "event_type")


@query("""
SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 100
""")
def first_events_per_type(spark, sf_dir):
    return O.first_per_source(table(spark, sf_dir, "events"), "event_type", "event_id", 100).select("event_type", "event_id")


@query("""SELECT conv_id, turn, 'game' || dense_rank() OVER (ORDER BY conv_id) AS game FROM conversations""")
def game_numbers(spark, sf_dir):
    rows = O.game_number(table(spark, sf_dir, "conversations"), "conv_id")
    return rows.select("conv_id", "turn", F.concat(F.lit("game"), F.col("game_no").cast("string")).alias("game"))


@query("""
SELECT event_id, user_id, count(u) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS half_move
FROM (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS u FROM events)
""")
def half_move_indices(spark, sf_dir):
    """Running count of events that are no errors, per user, in chunks of the id."""
    ev = table(spark, sf_dir, "events").withColumn("u", F.when(F.col("event_type") != "error", F.col("event_type")))
    return G.half_move_index(ev, "user_id", "event_id", "u", chunk=1000).select("event_id", "user_id", "half_move")


@query("""
WITH i AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ply FROM events),
t AS (SELECT *, CASE WHEN ply % 2 = 0 THEN (ply // 2 + 1) || '. ' || event_type ELSE event_type END AS token FROM i)
SELECT event_id, coalesce(string_agg(token, ' ') OVER (PARTITION BY user_id ORDER BY ply ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS history FROM t
""")
def recent_history(spark, sf_dir):
    """The ten half-moves before each event of a user; long histories are cut into chunks."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    placed = G.half_move_index(ev, "user_id", "event_id", "event_type", "ply")
    token = G.history_token(F.floor(F.col("ply") / 2) + 1, F.col("ply") % 2 == 0, F.col("event_type"))
    rows = G.recent_history(placed.withColumn("token", token), "user_id", "ply", "token", 10, chunk=32)
    return rows.select("event_id", "history")


@query(f"""
WITH {SQL_MOVES}, t AS (SELECT game_id, ply, CASE WHEN ply % 2 = 0 THEN (ply // 2 + 1) || '. ' || san ELSE san END AS token FROM moves)
SELECT game_id, CAST(ply AS BIGINT) AS ply,
       coalesce(string_agg(token, ' ') OVER (PARTITION BY game_id ORDER BY ply ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS history FROM t
""")
def game_history(spark, sf_dir):
    """History text cut from each game's own move list, without a window."""
    from plyforge.plans.archive import plies_with_history

    rows = plies_with_history(G.with_plies(event_games(spark, sf_dir)), ["game_id"])
    return rows.select("game_id", F.col("ply").cast("long").alias("ply"), "history")


@query("""
SELECT event_id, CASE event_type WHEN 'signup' THEN 'Describe the check delivered by the move s1.'
  WHEN 'error' THEN 'Explain how s1 leads to checkmate.' WHEN 'click' THEN 'Explain the capture made by s1.'
  WHEN 'view' THEN 'What is the significance of promotion to q by s1?' ELSE 'Why castle (s1) here?' END AS instruction,
  'The move s1 resulted in ''' || event_type || '''. Explain this event.' AS other,
  CASE WHEN k % 2 = 0 THEN 'w' ELSE 'b' END AS side
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def event_instructions(spark, sf_dir):
    from plyforge.functions.notation import side_to_move
    from plyforge.functions.prompts import event_instruction

    names = {"signup": "Check", "error": "Checkmate", "click": "Capture", "view": "Promotion to Q", "purchase": "Kingside Castling"}
    event = F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), "event_type")
    fen = F.concat(F.lit("8/8 "), F.when(k_of() % 2 == 0, "w").otherwise("b"), F.lit(" - - 0 1"))
    san = F.lit("s1")
    return table(spark, sf_dir, "events").select(
        "event_id", event_instruction(event, san).alias("instruction"),
        event_instruction(F.col("event_type"), san).alias("other"), side_to_move(fen).alias("side"),
    )


@query("""
SELECT l_orderkey, CAST(row_number() OVER (ORDER BY l_orderkey) - 1 AS BIGINT) AS place FROM lineitem
""")
def repeated_key_places(spark, sf_dir):
    """Places of line items by the order they belong to, a key that repeats; rows of one order are alike here."""
    rows = O.global_index(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "place")
    return rows.select("l_orderkey", "place")


@query("""
WITH k AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS u FROM events),
r AS (SELECT u, row_number() OVER (ORDER BY md5('42' || coalesce('|' || u, '')) || coalesce('|' || u, '')) - 1 AS i, count(*) OVER () AS n FROM k)
SELECT u, CASE WHEN i < CAST(floor(0.8 * n) AS BIGINT) THEN 'train'
  WHEN i < CAST(floor(0.8 * n) AS BIGINT) + CAST(floor(0.1 * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split, count(*) AS n
FROM r GROUP BY ALL
""")
def split_of_copies(spark, sf_dir):
    """An exact split of rows that share their key, or have none: each row comes out once."""
    user = F.when(F.col("event_type") != "error", F.col("user_id"))
    rows = O.split_exact(table(spark, sf_dir, "events").select(user.alias("u"), "event_id"), "u", seed=42)
    return rows.groupBy("u", "split").agg(F.count("*").alias("n"))

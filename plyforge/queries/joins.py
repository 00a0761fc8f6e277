"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.functions.core import overlap_size, sorted_distinct, words
from plyforge.functions.notation import scores_agree
from plyforge.operators import games as G
from plyforge.operators import matching as J
from plyforge.operators import shaping as S
from plyforge.queries.registry import documents, query, table
from plyforge.queries.standins import SQL_PAIRS, k_of, turn_pairs

EVENTS_K = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
WORDS = "list_filter(string_split_regex({}, '[\\s\\x0b]+'), lambda w: w <> '')"


@query(f"""
WITH s AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'signup' GROUP BY user_id),
p AS (SELECT event_id, user_id, CASE WHEN k % 3 = 0 THEN NULL ELSE value END AS e FROM {EVENTS_K})
SELECT event_id, coalesce(v, e) AS eval_cp,
  CASE WHEN e IS NULL AND v IS NULL THEN 'missing' WHEN e IS NULL THEN 'filled' WHEN v IS NULL THEN 'kept'
       WHEN abs(e) > 9000 AND abs(v) > 9000 THEN CASE WHEN e = v THEN 'validated' ELSE 'mismatch' END
       WHEN abs(e - v) <= 50 THEN 'validated' ELSE 'mismatch' END AS score_status
FROM p LEFT JOIN s USING (user_id)
""")
def filled_scores(spark, sf_dir):
    """Scores filled from, checked against and replaced by a score table keyed by user."""
    ev = table(spark, sf_dir, "events")
    scores = ev.where("event_type = 'signup'").groupBy("user_id").agg(F.max("value").alias("value"))
    plies = ev.select("event_id", "user_id", F.when(k_of() % 3 != 0, F.col("value")).alias("eval_cp"))
    return G.fill_scores(plies, scores, "user_id", overwrite=True).select("event_id", "eval_cp", "score_status")


@query(f"""
SELECT event_id, CASE WHEN k % 5 = 0 THEN true WHEN a > 9000 AND b > 9000 THEN a = b ELSE abs(a - b) <= 50 END AS agree
FROM (SELECT event_id, k, value * 100 AS a, value * 100 + k - 45 AS b FROM {EVENTS_K})
""")
def score_agreement(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("k", k_of())
    a = F.col("value") * 100
    b = F.when(F.col("k") % 5 != 0, F.col("value") * 100 + F.col("k") - 45)
    return ev.select("event_id", scores_agree(a, b).alias("agree"))


@query("""
WITH c AS (SELECT sha256(text) AS h, min(role || '!') AS response FROM conversations WHERE turn < 2 GROUP BY 1)
SELECT 'hit' AS kind, sha256(text) AS prompt_hash, response FROM conversations JOIN c ON c.h = sha256(text)
UNION ALL SELECT 'miss', h, NULL FROM (SELECT DISTINCT sha256(text) AS h FROM conversations) WHERE h NOT IN (SELECT h FROM c)
""")
def cache_probe(spark, sf_dir):
    """Cached answers by prompt hash, and the distinct prompts that have none."""
    conv = table(spark, sf_dir, "conversations")
    cache = (
        conv.where("turn < 2").groupBy(F.sha2("text", 256).alias("prompt_hash"))
        .agg(F.min(F.concat("role", F.lit("!"))).alias("response"))
    )
    hits, misses = J.probe_cache(conv, cache, "text")
    found = hits.select(F.lit("hit").alias("kind"), "prompt_hash", "response")
    return found.unionByName(misses.select(F.lit("miss").alias("kind"), "prompt_hash", F.lit(None).cast("string").alias("response")))


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_documents(spark, sf_dir):
    return J.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("""
SELECT u.conv_id, u.turn, u.text, coalesce(a.text, 'GENERATION_ERROR') AS raw
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
""")
def aligned_predictions(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")

    def sample(turn):
        return F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string")).alias("sample_id")

    samples = conv.where("role = 'user'").select("conv_id", "turn", "text", sample(F.col("turn")))
    preds = conv.where("role = 'assistant'").select(sample(F.col("turn") - 1), F.col("text").alias("raw"))
    return J.align(samples, preds).select("conv_id", "turn", "text", "raw")


@query("""SELECT n_nationkey, n_name, r_name AS model FROM nation CROSS JOIN region""")
def inputs_by_models(spark, sf_dir):
    """Every input once per model, without a join."""
    models = table(spark, sf_dir, "region").select("r_name")
    return J.cross_inputs(table(spark, sf_dir, "nation"), models).select("n_nationkey", "n_name", "model")


@query("""
SELECT p_partkey, min(printf('exp%08d', s_suppkey)) AS folder
FROM part LEFT JOIN supplier ON p_size % 25 = s_nationkey
  AND abs(s_acctbal - p_retailprice) <= 0.5 + 0.01 * abs(p_retailprice)
GROUP BY p_partkey
""")
def matched_criteria(spark, sf_dir):
    """First experiment by name whose nation is equal and whose balance is near the wanted price."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 25).alias("version"), F.col("p_retailprice").alias("alpha"))
    exps = table(spark, sf_dir, "supplier").select(
        F.format_string("exp%08d", "s_suppkey").alias("folder"), F.col("s_nationkey").alias("version"), F.col("s_acctbal").alias("alpha"))
    return J.match_criteria(part, exps, "p_partkey", ["alpha"], ["version"], rtol=0.01, atol=0.5).select("p_partkey", "folder")


ENGINE_SQL = """
engine AS (SELECT user_id AS pos_id, event_id AS move, value AS score,
                  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
top AS (SELECT * FROM engine WHERE rank <= 5)"""


def _engine(spark, sf_dir):
    """The five best-scored events of each user as that position's engine lines."""
    return J.top_k(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 5).select(
        F.col("user_id").alias("pos_id"), F.col("event_id").alias("move"), F.col("value").alias("score"), "rank")


@query(f"""
WITH {ENGINE_SQL}, n AS (SELECT pos_id, max(rank) AS n, max(CASE WHEN rank = 1 THEN score END) AS s1,
  max(CASE WHEN rank = 3 THEN score END) AS s3, max(CASE WHEN rank = 8 THEN score END) AS s8 FROM top GROUP BY pos_id)
SELECT pos_id, CAST(k AS BIGINT) AS k, CASE WHEN n < k THEN s1 WHEN k = 1 THEN s1 WHEN k = 3 THEN s3 ELSE s8 END AS baseline, n < k AS fallback
FROM n, (VALUES (1), (3), (8)) v(k)
""")
def engine_baselines(spark, sf_dir):
    """Score of the K-th engine move, or of the best one where the list is shorter."""
    rows = J.baseline_at_k(_engine(spark, sf_dir), [1, 3, 8])
    return rows.withColumn("k", F.col("k").cast("long"))


@query("""
SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events
QUALIFY rank <= 3
""")
def top_moves(spark, sf_dir):
    return J.top_k(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 3).withColumn("rank", F.col("rank").cast("long"))


@query("""
SELECT user_id, string_agg(event_id || ':' || event_type, ' ' ORDER BY value DESC, event_id) AS top
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 4 GROUP BY user_id
""")
def top_move_lists(spark, sf_dir):
    """The best four moves of each position as one list."""
    ev = table(spark, sf_dir, "events")
    labelled = ev.withColumn("move", F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))
    # Equal scores go by id, so the id leads the name that breaks ties.
    keyed = labelled.withColumn("name", F.concat(F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit("|"), F.col("move")))
    lists = J.top_k_lists(keyed, "user_id", "value", "name", 4)
    return lists.select("user_id", F.array_join(F.transform("top", lambda m: F.substring_index(m["move"], "|", -1)), " ").alias("top"))


@query("""
SELECT o_orderkey, 'kept' AS state FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
UNION ALL SELECT o_orderkey, 'mismatch' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def agreeing_puzzles(spark, sf_dir):
    """Orders with a returned line as puzzles the engine agrees with, and the others."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    best = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = J.agreeing(orders, best, ["o_orderkey"]).withColumn("state", F.lit("kept"))
    return kept.unionByName(J.disagreeing(orders, best, ["o_orderkey"]).withColumn("state", F.lit("mismatch")))


@query("""
SELECT l_orderkey, l_linenumber, o_orderstatus AS answer, c_name AS best
FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'
LEFT JOIN (SELECT o_orderkey AS k, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0) b ON b.k = l_orderkey
""")
def augmented_positions(spark, sf_dir):
    """Positions with a readable answer and, where there is one, the engine's move."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fen"), "l_linenumber")
    orders = table(spark, sf_dir, "orders")
    answers = orders.select(F.col("o_orderkey").alias("fen"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("answer"))
    customer = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    best = orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("o_orderkey").alias("fen"), F.col("c_name").alias("best"))
    return J.augment_positions(lines, answers, best).select(F.col("fen").alias("l_orderkey"), "l_linenumber", "answer", "best")


@query("""
WITH m AS (SELECT user_id AS pos_id, event_type AS move, max(value) AS score FROM events GROUP BY 1, 2),
p AS (SELECT event_id, user_id, event_type AS move, CASE WHEN event_type = 'click' THEN 'view' ELSE 'click' END AS reference,
        CASE WHEN event_id % 2 = 0 THEN 'w' ELSE 'b' END AS side FROM events)
SELECT event_id, a.score AS pred_score, b.score AS ref_score, a.score - b.score AS delta,
       CASE WHEN side = 'w' THEN a.score > b.score ELSE a.score < b.score END AS better
FROM p LEFT JOIN m a ON a.pos_id = user_id AND a.move = p.move LEFT JOIN m b ON b.pos_id = user_id AND b.move = p.reference
""")
def move_score_comparison(spark, sf_dir):
    """Score after the predicted move next to the score after the reference move."""
    ev = table(spark, sf_dir, "events")
    scores = ev.groupBy(F.col("user_id").alias("pos_id"), F.col("event_type").alias("move")).agg(F.max("value").alias("score"))
    preds = ev.select("event_id", F.col("user_id").alias("pos_id"), F.col("event_type").alias("move"),
                      F.when(F.col("event_type") == "click", "view").otherwise("click").alias("reference"),
                      F.when(F.col("event_id") % 2 == 0, "w").otherwise("b").alias("side"))
    rows = J.score_deltas(J.attach_move_scores(preds, scores), F.col("side"))
    return rows.select("event_id", "pred_score", "ref_score", "delta", "better")


@query("""
WITH f AS (SELECT conv_id, turn + 1 AS turn, text AS fen_before FROM conversations),
bad AS (SELECT DISTINCT conv_id FROM conversations c WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id = c.conv_id AND f.turn = c.turn))
SELECT c.conv_id, c.turn, c.role, f.fen_before FROM conversations c JOIN f USING (conv_id, turn) WHERE c.turn > 0 AND c.conv_id NOT IN (SELECT conv_id FROM bad)
""")
def attached_positions(spark, sf_dir):
    """Turns with the turn before as their position; a conversation with a gap is dropped whole."""
    conv = table(spark, sf_dir, "conversations")
    facts = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("fen_before"))
    plies = conv.where("turn > 0").select("conv_id", "turn", "role")
    return G.attach_positions(plies, facts, ["conv_id", "turn"], on_bad="drop_game")


@query("""
SELECT data_source, count(*) AS n, CAST(count(lang) AS BIGINT) AS with_lang, CAST(count(url) AS BIGINT) AS with_url,
       CAST(sum(length(coalesce(text, html))) AS BIGINT) AS chars
FROM (SELECT 'P1' AS data_source, text, lang, NULL AS url, NULL AS html FROM documents
      UNION ALL SELECT 'P2', NULL, NULL, url, html FROM pages) GROUP BY data_source
""")
def tagged_union(spark, sf_dir):
    """Documents and pages in one table with their source."""
    rows = S.union_tagged({"P1": table(spark, sf_dir, "documents"), "P2": table(spark, sf_dir, "pages")})
    return rows.groupBy("data_source").agg(
        F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count("url").alias("with_url"),
        F.sum(F.length(F.coalesce("text", "html"))).alias("chars"))


@query("""
SELECT event_id, 'move' AS task FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'piece' FROM events WHERE value > 20
UNION ALL SELECT event_id, 'color' FROM events WHERE event_type <> 'click'
""")
def task_union(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    parts = {"move": "event_type = 'click'", "piece": "value > 20", "color": "event_type <> 'click'"}
    return S.union_all(*[ev.where(c).select("event_id", F.lit(n).alias("task")) for n, c in parts.items()])


@query("""SELECT event_id, event_type FROM events WHERE value >= 10 AND event_type IN ('click', 'view')""")
def routed_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("data_source", F.when(F.col("value") >= 10, "P1").otherwise("P2"))
    return S.route(ev.withColumn("task", F.upper("event_type")), "P1", ["click", "view"]).select("event_id", "event_type")


@query(f"""
WITH {SQL_PAIRS}, w AS (SELECT conv_id, turn, {WORDS.format('pred')} AS p, {WORDS.format('ref')} AS r FROM pairs)
SELECT conv_id, turn, CAST(len(list_intersect(p, r)) AS BIGINT) AS shared FROM w
""")
def shared_words(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", overlap_size(words(F.col("pred")), words(F.col("ref"))).cast("long").alias("shared"))


@query(f"""
SELECT doc_id, array_to_string(list_sort(list_distinct({WORDS.format('text')})), ' ') AS tokens FROM documents
""")
def sorted_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(sorted_distinct(words(F.col("text"))), " ").alias("tokens"))


@query("""SELECT DISTINCT source FROM documents UNION ALL SELECT DISTINCT 'user ' || user_id FROM events""")
def distinct_sources(spark, sf_dir):
    docs = S.distinct_ids(table(spark, sf_dir, "documents"), "source")
    users = table(spark, sf_dir, "events").select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source"))
    return S.union_all(docs, S.distinct_ids(users, "source"))


@query("""SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""")
def undone_ids(spark, sf_dir):
    return S.difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id, lang FROM documents WHERE text <> '' AND lang <> '' AND len(string_split(text, ' ')) > 0""")
def required_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("words", F.split("text", " "))
    return G.require(docs, ["text", "lang"], ["words"]).select("doc_id", "lang")


@query("""
SELECT conv_id, turn, md5(text || '|' || turn || '|' || role) AS move_key, sha256(text) AS prompt_key FROM conversations
""")
def hashed_keys(spark, sf_dir):
    from plyforge.functions.core import move_key, prompt_key

    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", move_key(F.col("text"), F.col("turn"), F.col("role")).alias("move_key"), prompt_key(F.col("text")).alias("prompt_key"))


@query("""
WITH p AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS pos_id FROM events),
m AS (SELECT user_id AS pos_id, max(value) AS score FROM events GROUP BY user_id)
SELECT event_id, p.pos_id, score FROM p LEFT JOIN m ON p.pos_id = m.pos_id
""")
def hot_position_scores(spark, sf_dir):
    """Scores of positions, one of which half of all rows stand for, by a join that deals this one over many tasks."""
    from plyforge.operators.skew import spread_join

    ev = table(spark, sf_dir, "events")
    preds = ev.select("event_id", F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")).cast("long").alias("pos_id"))
    scores = ev.groupBy(F.col("user_id").alias("pos_id")).agg(F.max("value").alias("score"))
    return spread_join(preds, scores, ["pos_id"]).select("event_id", "pos_id", "score")


@query("""
WITH c AS (SELECT p_partkey, 1.0::DOUBLE AS a, p_retailprice AS b FROM part),
e AS (SELECT printf('exp%08d', s_suppkey) AS folder, 1.0::DOUBLE AS a, s_acctbal AS b FROM supplier)
SELECT p_partkey, min(folder) AS folder FROM c LEFT JOIN e
  ON abs(e.a - c.a) <= 0.5 + 0.01 * abs(c.a) AND abs(e.b - c.b) <= 0.5 + 0.01 * abs(c.b) GROUP BY p_partkey
""")
def criteria_of_two_columns(spark, sf_dir):
    """Criteria with two near-equal columns, of which the first is the same for all."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lit(1.0).alias("alpha"), F.col("p_retailprice").alias("beta"))
    exps = table(spark, sf_dir, "supplier").select(
        F.format_string("exp%08d", "s_suppkey").alias("folder"), F.lit(1.0).alias("alpha"), F.col("s_acctbal").alias("beta"))
    return J.match_criteria(part, exps, "p_partkey", ["alpha", "beta"], [], rtol=0.01, atol=0.5).select("p_partkey", "folder")

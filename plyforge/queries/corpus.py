"""Archives, headers, notes and moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.functions import notation as N
from plyforge.operators import games as G
from plyforge.operators.shaping import explode_board
from plyforge.plans.archive import archive_games, flat_plies, nested_games, position_requests
from plyforge.plans.tasks import p1_tasks
from plyforge.queries.registry import documents, events, query, table
from plyforge.queries.standins import SQL_MOVES, event_games, event_moves, k_of
from plyforge.session import scratch_path
from plyforge.sources import archive as A
from plyforge.sources import sinks, tables

PLY_SQL = f"""
WITH {SQL_MOVES}
SELECT game_id, CAST(ply AS BIGINT) AS ply, CAST(ply // 2 + 1 AS BIGINT) AS move_number,
       CASE WHEN ply % 2 = 0 THEN 'w' ELSE 'b' END AS side, san,
       CASE nag WHEN '!' THEN 'Good' WHEN '??' THEN 'Blunder' WHEN '!?' THEN 'Interesting' WHEN '?!' THEN 'Dubious' END AS quality,
       CASE WHEN suffix = '#' THEN 'Checkmate' WHEN suffix = '+' THEN 'Check' WHEN contains(san, 'x') THEN 'Capture' END AS outcome,
       CASE WHEN contains(san, '=Q') THEN 'Promotion to Q' WHEN contains(san, '=N') THEN 'Promotion to N'
            WHEN starts_with(san, 'O-O-O') THEN 'Queenside Castling' WHEN starts_with(san, 'O-O') THEN 'Kingside Castling' END AS special_move,
       CASE WHEN k % 10 = 3 THEN k - 10000.0 ELSE value * 100 END AS eval_cp,
       '0:00:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') AS clock,
       event_type || ' by ' || user_id AS comment
FROM moves"""
PLY_COLUMNS = ["game_id", "ply", "move_number", "side", "san", "quality", "outcome", "special_move", "eval_cp", "clock", "comment"]


def _typed(df):
    return df.select(*[F.col(c).cast("long") if c in ("ply", "move_number") else F.col(c) for c in PLY_COLUMNS])


@query(PLY_SQL)
def movetext_to_plies(spark, sf_dir):
    """Movetext of whole games to one row per half-move with all its facts."""
    plies = G.tokenize_movetext(event_games(spark, sf_dir), "game_id", "movetext")
    return _typed(G.with_move_facts(plies))


@query(PLY_SQL)
def archive_files_to_plies(spark, sf_dir):
    """The same plies after the games have been written to archive files and read back."""
    path = scratch_path(spark, "archive")
    tags = F.concat(
        F.lit('[Event "Game '), F.col("game_id").cast("string"), F.lit('"]\n[Site "old"]\n[Site "'),
        F.col("game_id").cast("string"), F.lit('"]\n[Result "1-0"]\n[WhiteElo "2000"]\n[BlackElo "1900"]\n\n'),
    )
    # Every other game is followed by two blank lines instead of one.
    gap = F.when(F.col("game_id") % 2 == 0, "\n").otherwise("")
    text = event_games(spark, sf_dir).select(F.concat(tags, "movetext", gap).alias("value"))
    text.write.option("lineSep", "\n\n").text(path)
    games = archive_games(spark, path, only_complete=True, only_standard=True, min_elo=1900)
    plies = games.select(F.col("game_url").cast("long").alias("game_id"), F.inline("plies"))
    return _typed(G.with_move_facts(plies))


@query("""
WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(\\w+)="([^"\\n\\r]*)"', 1)) AS key,
                  unnest(regexp_extract_all(html, '(\\w+)="([^"\\n\\r]*)"', 2)) AS value,
                  generate_subscripts(regexp_extract_all(html, '(\\w+)="([^"\\n\\r]*)"', 1), 1) AS pos FROM pages)
SELECT page_id, key, arg_max(value, pos) AS value FROM m GROUP BY page_id, key
""")
def page_attribute_headers(spark, sf_dir):
    """Attributes of a page written as header lines and parsed; a repeated key keeps its last value."""
    pages = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit(r'\w+="[^"\n\r]*"'), F.lit(0))
    lines = F.transform(found, lambda a: F.concat(F.lit("["), F.replace(a, F.lit('="'), F.lit(' "')), F.lit("]")))
    headers = pages.select("page_id", F.array_join(lines, "\n").alias("header_text"))
    return G.with_headers(headers).select("page_id", F.explode("headers").alias("key", "value"))


@query("""
SELECT event_id, CASE event_type
  WHEN 'signup' THEN value * 100 WHEN 'click' THEN value * 100
  WHEN 'error' THEN CASE WHEN floor(value) = 0 THEN 10000.0 ELSE 10000.0 - floor(value) END
  WHEN 'view' THEN CASE WHEN floor(value) = 0 THEN -10000.0 ELSE floor(value) - 10000.0 END END AS eval_cp
FROM events
""")
def eval_texts(spark, sf_dir):
    """Scores rendered as pawns, signed pawns, mates either way and a form that does not parse."""
    ev = table(spark, sf_dir, "events")
    number, whole = F.col("value").cast("string"), F.floor("value").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "signup", number).when(kind == "click", F.concat(F.lit("+"), number))
        .when(kind == "error", F.concat(F.lit("#"), whole)).when(kind == "view", F.concat(F.lit("#-"), whole))
        .otherwise(F.concat(number, F.lit("/20")))
    )
    return ev.select("event_id", N.parse_eval(text).alias("eval_cp"))


@query("""
SELECT event_id, value * 100 AS eval_cp,
       '1:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':07' AS clock,
       CAST(3600 + (k % 60) * 60 + 7 AS BIGINT) AS seconds,
       event_type || CASE WHEN k % 2 = 0 THEN ' even' ELSE '' END AS comment
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def move_annotations(spark, sf_dir):
    """Score, clock and joined comments of annotation text."""
    ev = events(spark, sf_dir).withColumn("k", k_of())
    text = F.concat(
        F.lit("{ [%eval "), F.col("value").cast("string"), F.lit("] "), "event_type", F.lit(" } { } {[%clk 1:"),
        F.lpad((F.col("k") % 60).cast("string"), 2, "0"), F.lit(":07]"), F.when(F.col("k") % 2 == 0, "\neven ").otherwise(""), F.lit("}"),
    )
    a = N.parse_annotations(text)
    return ev.select("event_id", a["eval_cp"].alias("eval_cp"), a["clock"].alias("clock"),
                     N.clock_seconds(a["clock"]).cast("long").alias("seconds"), a["comment"].alias("comment"))


@query("""
SELECT event_id, CASE event_type WHEN 'signup' THEN 'Good' WHEN 'error' THEN 'Blunder' WHEN 'click' THEN 'Brilliant'
  WHEN 'purchase' THEN 'Interesting' WHEN 'view' THEN NULL END AS quality FROM events
""")
def quality_labels(spark, sf_dir):
    marks = {"signup": "!", "error": "??", "click": "!!", "purchase": "!?", "view": "!!!"}
    nag = F.try_element_at(F.create_map(*[F.lit(x) for p in marks.items() for x in p]), "event_type")
    return table(spark, sf_dir, "events").select("event_id", N.quality_label(nag).alias("quality"))


@query(f"""
WITH {SQL_MOVES}
SELECT game_id, CAST(ply // 2 + 1 AS BIGINT) AS move_number,
       max(CASE WHEN ply % 2 = 0 THEN san END) AS white, max(CASE WHEN ply % 2 = 1 THEN san END) AS black
FROM moves GROUP BY game_id, ply // 2 + 1
""")
def nested_move_pairs(spark, sf_dir):
    """Move pairs of the nested game document, built inside each game's row."""
    from plyforge.plans.archive import nested_games

    games = event_games(spark, sf_dir).withColumn("headers", F.create_map(F.lit("Site"), F.col("game_id").cast("string")))
    docs = nested_games(G.with_plies(G.game_record(games), fen="fen"))
    pairs = docs.select(F.col("game_metadata.game_url").cast("long").alias("game_id"), F.inline("game_metadata.pgn"))
    return pairs.select("game_id", F.col("move_number").cast("long").alias("move_number"),
                        F.col("white_move.san").alias("white"), F.col("black_move.san").alias("black"))


@query("""
SELECT conv_id, turn // 2 + 1 AS move_number, max(CASE WHEN turn % 2 = 0 THEN text END) AS white,
       max(CASE WHEN turn % 2 = 1 THEN text END) AS black
FROM conversations GROUP BY conv_id, turn // 2 + 1
""")
def turn_move_pairs(spark, sf_dir):
    """One row per pair of turns of a flat table."""
    conv = table(spark, sf_dir, "conversations")
    number = F.floor(F.col("turn") / 2) + 1
    pairs = G.pair_moves(conv, "conv_id", number, F.col("turn") % 2 == 0, ["text"])
    return pairs.select("conv_id", "move_number", F.col("white.text").alias("white"), F.col("black.text").alias("black"))


@query("""
WITH c AS (SELECT doc_id, trim(unnest(regexp_extract_all('{' || replace(replace(text, '. ', '.} {'), ', ', ',}{[%clk 0:01:00] x}{') || '}',
                                                         '(?s)\\{(.*?)\\}', 1)), ' ' || chr(9) || chr(10) || chr(13)) AS comment FROM documents)
SELECT doc_id, comment FROM c WHERE comment <> '' AND NOT starts_with(comment, '[%clk') AND NOT starts_with(comment, '[%eval')
""")
def document_comments(spark, sf_dir):
    """Every comment in whole documents with braces spliced in, repeats kept."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".} {")), F.lit(", "), F.lit(",}{[%clk 0:01:00] x}{"))
    docs = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("{"), text, F.lit("}")).alias("value"))
    return A.extract_comments(docs)


@query("""
SELECT lang, count(*) AS n FROM documents
WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND NOT starts_with(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), 'The') GROUP BY lang
""")
def valid_comments(spark, sf_dir):
    """Comment filter with documents that open with `The` turned into clock tags."""
    text = F.regexp_replace("text", r"^\s*The", "[%clk")
    docs = documents(spark, sf_dir).where(N.is_valid_comment(text))
    return docs.groupBy("lang").agg(F.count("*").alias("n"))


@query(f"""
WITH {SQL_MOVES}
SELECT event_id, CASE WHEN k % 3 = 0 THEN NULL ELSE ({"['e4','Nf3','Bxc4','O-O','e8=Q','Qh7','O-O-O','Raxd1','exd5','b1=N']"})[1 + k % 10] END AS best,
       k % 3 <> 0 AND event_type = 'error' AS mate,
       k % 3 = 0 AS informative
FROM moves
""")
def comment_phrases(spark, sf_dir):
    """Best move named in a comment, the mate phrase and the test for other telling comments."""
    moves = event_moves(spark, sf_dir)
    core = F.regexp_replace("san", "[+#!?]", "")
    other = F.concat(F.lit("A comment by "), F.col("user_id").cast("string"))
    told = F.concat(core, F.lit(" WAS best."), F.when(F.col("event_type") == "error", " Checkmate is NOW unavoidable").otherwise(""))
    comment = F.when(F.col("k") % 3 == 0, other).otherwise(told)
    best = N.best_move_from_comment(comment)
    return moves.select("event_id", best.alias("best"), N.mentions(comment).alias("mate"), N.is_informative(comment, best).alias("informative"))


@query("""SELECT doc_id, contains(lower(text), 'in the') AS hit FROM documents""")
def phrase_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.mentions(F.col("text"), "in the").alias("hit"))


_RANKS = ["rnbqkbnr", "pppppppp", "8", "4P3", "1p5p", "RNBQKBNR", "PPPPPPPP", "3qk3"]


@query("""
WITH f AS (
  SELECT event_id, list_transform(range(0, 8), lambda i: (['rnbqkbnr','pppppppp','8','4P3','1p5p','RNBQKBNR','PPPPPPPP','3qk3'])[1 + (k + i) % 8]) AS ranks
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
b AS (SELECT replace(replace(replace(replace(replace(array_to_string(ranks, ''), '8', '........'), '5', '.....'), '4', '....'), '3', '...'), '1', '.') AS board FROM f),
s AS (SELECT unnest(range(1, 65)) AS i, board FROM b)
SELECT substr('abcdefgh', CAST((i - 1) % 8 + 1 AS BIGINT), 1) || CAST(8 - (i - 1) // 8 AS VARCHAR) AS square,
       upper(board[i]) AS piece, CASE WHEN upper(board[i]) = board[i] THEN 'White' ELSE 'Black' END AS color, count(*) AS n
FROM s WHERE board[i] <> '.' GROUP BY 1, 2, 3
""")
def board_occupancy(spark, sf_dir):
    """How often each piece stands on each square, over a board string per event."""
    ranks = F.array(*[F.lit(r) for r in _RANKS])
    row = [F.element_at(ranks, ((F.col("k") + i) % 8 + 1).cast("int")) for i in range(8)]
    fens = events(spark, sf_dir).select(k_of().alias("k")).select(F.concat(F.concat_ws("/", *row), F.lit(" w - - 0 1")).alias("fen"))
    placed = explode_board(fens).where("piece IS NOT NULL")
    return placed.groupBy("square", "piece", "color").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus <> 'P' AND lower(CASE WHEN c_mktsegment = 'BUILDING' THEN 'Standard' ELSE c_mktsegment END) IN ('standard')
  AND o_orderstatus IN ('F', 'O')
  AND CAST(floor(o_totalprice) AS BIGINT) >= 1000
  AND (CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(floor(c_acctbal) AS BIGINT) END) >= 1000
""")
def filtered_games(spark, sf_dir):
    """Game filter with orders as games: status as result, segment as variant, price and balance as
    ratings. A negative balance is written as text that is no number and counts as 0."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    status = F.col("o_orderstatus")
    headers = F.create_map(
        F.lit("Result"), F.when(status == "P", "*").when(status == "F", "1-0").otherwise("0-1"),
        F.lit("Variant"), F.when(F.col("c_mktsegment") == "BUILDING", "Standard").otherwise(F.col("c_mktsegment")),
        F.lit("WhiteElo"), F.floor("o_totalprice").cast("string"),
        F.lit("BlackElo"), F.when(F.col("c_acctbal") < 0, "unrated").otherwise(F.floor("c_acctbal").cast("string")),
    )
    kept = G.filter_games(joined.withColumn("headers", headers), skip_unfinished=True, only_standard=True,
                          only_complete=True, min_elo=1000)
    return kept.select("o_orderkey")


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE floor(c_acctbal) END AS white_elo,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN c_name ELSE 'home' END AS game_url,
       'Standard' AS variant
FROM customer
""")
def game_records(spark, sf_dir):
    """Game fields from tags: a rating that is no number is NULL, a missing one 0."""
    seg = F.col("c_mktsegment")
    rating = F.when(seg == "BUILDING", "n/a").otherwise(F.floor("c_acctbal").cast("string"))
    headers = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("Site").alias("k"), F.lit("home").alias("v")),
        F.when(seg != "MACHINERY", F.struct(F.lit("WhiteElo").alias("k"), rating.alias("v"))),
        F.struct(F.lit("GameURL").alias("k"), F.when(seg == "FURNITURE", F.col("c_name")).otherwise("").alias("v")),
    )))
    rows = G.game_record(table(spark, sf_dir, "customer").withColumn("headers", headers))
    return rows.select("c_custkey", F.col("white_elo").cast("double").alias("white_elo"), "game_url", "variant")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS found, CAST(count(*) FILTER (l_quantity < 5) AS BIGINT) AS filtered,
       CAST(count(*) FILTER (l_discount > 0.05) AS BIGINT) AS validated
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def ingest_counters(spark, sf_dir):
    counters = {"found": F.lit(True), "filtered": F.col("l_quantity") < 5, "validated": F.col("l_discount") > 0.05}
    return G.ingest_counters(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], counters).drop("level")


@query("""
SELECT 'row' AS kind, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS id, text FROM conversations
UNION ALL SELECT 'bad', '{"conv_id": ' || conv_id || ', "turn": oops', NULL FROM conversations WHERE turn = 0
""")
def jsonl_with_bad_lines(spark, sf_dir):
    """Turns written as JSON lines with malformed lines between them, read back without losing any."""
    path = scratch_path(spark, "jsonl")
    conv = table(spark, sf_dir, "conversations")
    sinks.write_json(conv, path)
    broken = F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string"), F.lit(', "turn": oops'))
    sinks.write_text(conv.where("turn = 0").select(broken.alias("value")), path, mode="append")
    rows = tables.read_jsonl(spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING", bad="keep")
    bad = F.col(tables.CORRUPT).isNotNull()
    return rows.select(
        F.when(bad, "bad").otherwise("row").alias("kind"),
        F.when(bad, F.col(tables.CORRUPT)).otherwise(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("id"),
        F.when(~bad, F.col("text")).alias("text"),
    )


@query("""
SELECT 'What is the best move in this position? FEN: ' || p_name AS prompt, ' ' || p_brand AS completion, p_type AS theme, p_size AS rating
FROM part
""")
def puzzle_csv(spark, sf_dir):
    """Parts written as a puzzle CSV, read with its schema and turned into prompt rows."""
    path = scratch_path(spark, "csv")
    part = table(spark, sf_dir, "part")
    move = F.replace("p_brand", F.lit(" "), F.lit("_"))
    sinks.write_csv(part.select(F.col("p_name").alias("FEN"), move.alias("Moves"), F.col("p_type").alias("Themes"), F.col("p_size").alias("Rating")), path)
    rows = tables.puzzle_rows(tables.read_puzzles(spark, path))
    return rows.withColumn("completion", F.replace("completion", F.lit("_"), F.lit(" ")))


@query("""
SELECT conv_id, turn, role, len(text) AS n FROM conversations
""")
def json_layouts(spark, sf_dir):
    """Turns written to one folder, half of them as JSON lines and half as indented arrays of 64
    conversations each, and read back."""
    conv = table(spark, sf_dir, "conversations")
    path, schema = scratch_path(spark, "layouts"), "conv_id long, turn long, role string, text string"
    conv.where("conv_id % 2 = 0").write.json(path)
    entry = F.concat(F.lit("   {"), F.substring(F.to_json(F.struct("conv_id", "turn", "role", "text")), 2, 1_000_000_000))
    arrays = conv.where("conv_id % 2 = 1").groupBy(F.floor(F.col("conv_id") / 128)).agg(F.array_join(F.collect_list(entry), ",\n").alias("body"))
    arrays.select(F.concat(F.lit("[\n"), "body", F.lit("\n]"))).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    rows = tables.read_json_auto(spark, path, schema)
    return rows.select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n"))


@query(f"""
WITH p AS ({PLY_SQL})
SELECT game_id, ply, 'identify_outcome' AS task, outcome AS output FROM p WHERE outcome IS NOT NULL
UNION ALL SELECT game_id, ply, 'identify_special_move', CASE WHEN starts_with(special_move, 'Promotion') THEN 'Promotion' ELSE special_move END FROM p WHERE special_move IS NOT NULL
UNION ALL SELECT game_id, ply, 'identify_quality', quality FROM p WHERE quality IS NOT NULL
""")
def archive_tasks(spark, sf_dir):
    """Games written to archive files, parsed, given coordinate moves and positions that are supplied, and
    made into task rows."""
    path = scratch_path(spark, "archive")
    tags = F.concat(F.lit('[Event "E"]\n[Site "'), F.col("game_id").cast("string"), F.lit('"]\n[Result "1-0"]\n\n'))
    event_games(spark, sf_dir).select(F.concat(tags, "movetext")).write.option("lineSep", "\n\n").text(path)
    nested = nested_games(archive_games(spark, path)).withColumn("game_id", F.col("game_metadata.game_url"))
    asked = position_requests(nested).select("game_id", F.posexplode("moves").alias("half_move", "san"))
    facts = asked.select("game_id", "half_move", F.concat(F.lit("u"), F.col("half_move")).alias("uci"), F.lit("8/8 w - - 0 1").alias("fen_before"))
    plies = G.attach_moves(flat_plies(nested), facts, ["game_id", "half_move"])
    rows = p1_tasks(plies, ["game_id", "half_move"])
    ids = F.split("task_id", "_")
    wanted = rows.where(F.col("task").isin("identify_outcome", "identify_special_move", "identify_quality"))
    return wanted.select(F.get(ids, F.lit(0)).cast("long").alias("game_id"), F.get(ids, F.lit(1)).cast("long").alias("ply"), "task", "output")


@query("""
SELECT event_id, user_id, event_type, NULL AS bad FROM events
UNION ALL SELECT NULL, NULL, NULL, '{"event_id": ' || event_id || ', "user_id": oops}' FROM events WHERE event_id % 500 = 7
""")
def divided_arrays(spark, sf_dir):
    """Events written as JSON arrays, one of them on a single line, with elements that cannot be read, and
    read back by ranges of their files."""
    path, schema = scratch_path(spark, "arrays"), "event_id BIGINT, user_id BIGINT, event_type STRING"
    ev = table(spark, sf_dir, "events")
    part = F.col("event_id") % 4
    good = F.to_json(F.struct("event_id", "user_id", "event_type"))
    broken = F.format_string('{"event_id": %d, "user_id": oops}', "event_id")
    texts = F.when(F.col("event_id") % 500 == 7, F.array(good, broken)).otherwise(F.array(good))
    rows = ev.select(part.alias("part"), F.lit(1).alias("place"), F.explode(texts).alias("value"))
    ends = spark.range(4).select(F.col("id").alias("part"), F.explode(F.array(F.lit(0), F.lit(2))).alias("place"))
    frame = ends.select("part", "place", F.when(F.col("place") == 0, "[").otherwise("null]").alias("value"))
    comma = F.when(F.col("place") == 1, F.concat("value", F.lit(","))).otherwise(F.col("value"))
    lines = rows.unionByName(frame).repartition("part").sortWithinPartitions("part", "place").select("part", comma.alias("value"))
    for end, kept in (("\n", "part > 0"), (" ", "part = 0")):
        lines.where(kept).write.mode("append").partitionBy("part").option("lineSep", end).text(path)
    back = tables.read_json_auto(spark, f"{path}/*", schema, bad="keep")
    bad = F.col(tables.CORRUPT)
    return back.where("event_id IS NOT NULL OR _corrupt_record IS NOT NULL").select(
        *[F.when(bad.isNull(), F.col(c)).alias(c) for c in ("event_id", "user_id", "event_type")], bad.alias("bad"))


@query("""
SELECT conv_id, turn, role, 'a note ' || turn || ' [Event "quoted"] end' AS comment FROM conversations
""")
def archives_of_mixed_lines(spark, sf_dir):
    """Games with either line end in one file, whose comments hold what looks like the start of a game."""
    path = scratch_path(spark, "mixed")
    note = F.concat(F.lit("{a note "), F.col("turn").cast("string"), F.lit('\n\n[Event "quoted"]\n\nend}'))
    text = F.concat(F.lit('[Event "E"]\n[Site "'), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit('"]\n[White "'),
                    "role", F.lit('"]\n\n1. e4 '), note, F.lit(" 1-0\n"))
    ended = F.when(F.col("conv_id") % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    table(spark, sf_dir, "conversations").select(ended.alias("value")).write.text(path)
    games = A.read_games(spark, path)
    site = F.split(F.regexp_extract("header_text", r'\[Site "([^"]*)"', 1), r"\.")
    return games.select(
        site[0].cast("long").alias("conv_id"), site[1].cast("long").alias("turn"), F.regexp_extract("header_text", r'\[White "([^"]*)"', 1).alias("role"),
        F.regexp_replace(F.regexp_extract("movetext", r"(?s)\{(.*)\}", 1), r"\s+", " ").alias("comment"))

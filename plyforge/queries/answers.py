"""Reading, cleaning and normalising answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.functions import prompts as P
from plyforge.functions import responses as R
from plyforge.functions.core import sanitize_name, split_last, words
from plyforge.operators import matching as J
from plyforge.operators.shaping import conform_schema
from plyforge.queries.registry import documents, events, query, table
from plyforge.queries.standins import k_of

# White space at both ends, as Java's \s has it, and sentence starts marked by a control character.
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_sentences(x: str, n: int = 4) -> str:
    return (
        f"array_to_string(list_slice(string_split(regexp_replace({x}, '([.!?])[\\s\\x0b]+', '\\1' || chr(1), 'g'), chr(1)), 1, {n}), ' ')"
    )


def sql_end_mark(x: str) -> str:
    return f"CASE WHEN {x} = '' OR regexp_matches({x}, '[.!?]$') THEN {x} ELSE {x} || '.' END"


def sql_one_line(x: str) -> str:
    return sql_strip(f"replace({sql_strip(f'''regexp_replace({x}, '[\\s\\x0b][\\s\\x0b]+', ' ', 'g')''')}, chr(10), ' ')")


_UCI_K = ("substr('abcdefgh', CAST(k % 8 + 1 AS BIGINT), 1) || (k % 8 + 1) || "
          "substr('abcdefgh', CAST((k + 3) % 8 + 1 AS BIGINT), 1) || ((k + 5) % 8 + 1)")


def _uci(k):
    letters = F.lit("abcdefgh")
    return F.concat(
        F.substring(letters, (k % 8 + 1).cast("int"), F.lit(1)), (k % 8 + 1).cast("string"),
        F.substring(letters, ((k + 3) % 8 + 1).cast("int"), F.lit(1)), ((k + 5) % 8 + 1).cast("string"),
    )


@query(f"""
WITH e AS (SELECT event_id, event_type, k, {_UCI_K} AS u FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
d AS (SELECT *, list_contains(['a1d6','b2e7','c3f8','d4g1'], u) AS allowed FROM e)
SELECT event_id,
  CASE event_type WHEN 'signup' THEN CASE WHEN allowed THEN u END
       WHEN 'error' THEN 'b2e7'
       WHEN 'click' THEN NULL
       WHEN 'view' THEN CASE WHEN allowed THEN u END
       ELSE 'c3f8' END AS move,
  CASE event_type WHEN 'signup' THEN 'plan ' || k WHEN 'error' THEN 'we castle ' || k WHEN 'purchase' THEN NULL END AS explanation,
  CASE event_type WHEN 'signup' THEN 'good' WHEN 'error' THEN 'excellent' WHEN 'click' THEN 'dubious' WHEN 'view' THEN 'parse_error' ELSE 'unknown' END AS verdict
FROM d
""")
def model_responses(spark, sf_dir):
    """Moves, explanations and verdicts read from JSON, broken JSON and prose answers."""
    ev = events(spark, sf_dir).withColumn("k", k_of())
    u, k, kind = _uci(F.col("k")), F.col("k").cast("string"), F.col("event_type")
    text = (
        F.when(kind == "signup", F.concat(F.lit('{"move": " '), F.upper(u), F.lit(' ", "explanation": "plan '), k, F.lit('", "verdict": "Good"}')))
        .when(kind == "error", F.concat(F.lit("I looked at a7a8 and B2E7, an excellent but dubious idea.\nNote: my Explanation: we castle "), k))
        .when(kind == "click", F.concat(F.lit('{"move": "'), u, F.lit('"} is a DUBIOUS blunder')))
        .when(kind == "view", F.concat(F.lit("Try "), u))
        .otherwise('{"move": "h1h1", "other": "c3f8"}')
    )
    allowed = F.array(*[F.lit(m) for m in ("a1d6", "b2e7", "c3f8", "d4g1")])
    explanation = R.parse_explanation_response(text)
    return ev.select(
        "event_id", R.parse_move_response(text, allowed).alias("move"),
        F.when(kind == "error", F.replace(explanation, F.lit("my Explanation: "), F.lit(""))).otherwise(explanation).alias("explanation"),
        R.parse_verdict(text).alias("verdict"),
    )


@query("""
WITH t AS (SELECT doc_id, lower(replace(replace(text, ' in ', ' EXCELLENT '), ' on ', ' blunder ')) AS x, text FROM documents)
SELECT doc_id, CASE WHEN contains(x, 'excellent') THEN 'excellent' WHEN contains(x, 'good') THEN 'good'
  WHEN contains(x, 'dubious') THEN 'dubious' WHEN contains(x, 'blunder') THEN 'blunder' ELSE 'parse_error' END AS verdict FROM t
""")
def verdict_keywords(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit(" in "), F.lit(" EXCELLENT ")), F.lit(" on "), F.lit(" blunder "))
    return documents(spark, sf_dir).select("doc_id", R.parse_verdict(text).alias("verdict"))


@query(f"""
WITH t AS (SELECT conv_id, turn, string_split({sql_strip("'move: ' || text || chr(10) || 'explanation: ' || role")}, chr(10)) AS lines, text, role FROM conversations)
SELECT conv_id, turn, {sql_strip("list_extract(string_split(lines[1], 'move: '), -1)")} AS move,
       {sql_strip("list_extract(string_split(lines[2], 'explanation: '), -1)")} AS explanation,
       {sql_strip("text")} AS reason,
       CASE WHEN role = 'user' THEN 'e2e4' ELSE '0000' END AS last_move
FROM t WHERE len(lines) > 1
""")
def labelled_answers(spark, sf_dir):
    """Answers with a line per part, and answers with reasoning before the move."""
    conv = table(spark, sf_dir, "conversations")
    two = R.parse_labelled_lines(F.concat(F.lit("move: "), "text", F.lit("\nexplanation: "), "role"))
    user = F.col("role") == "user"
    reply = F.concat(F.when(user, "Reasoning: ").otherwise(""), F.col("text"), F.when(user, " Move: e2e4 now").otherwise(""))
    reason = R.parse_reasoning(reply)
    strip = R.strip
    return conv.select("conv_id", "turn", two["move"].alias("move"), two["explanation"].alias("explanation"),
                       strip(reason["explanation"]).alias("reason"), reason["move"].alias("last_move"))


_RAW = """CASE lang WHEN 'en' THEN 'Explanation: [ASSISTANT] ' || text WHEN 'de' THEN 'Here is the explanation: ' || text
  WHEN 'fr' THEN 'Explain the text.' || text ELSE ' opening ideas).  ' || text END"""


@query(f"""
WITH a AS (SELECT doc_id, lang, {sql_strip("text")} AS t, {sql_strip(_RAW)} AS raw FROM documents),
b AS (SELECT doc_id, CASE WHEN t = '' THEN raw ELSE {sql_sentences('t')} END AS cut FROM a),
c AS (SELECT doc_id, {sql_end_mark('cut')} AS marked FROM b)
SELECT doc_id, {sql_one_line('marked')} AS output FROM c
""")
def cleaned_explanations(spark, sf_dir):
    """Teacher texts without their opening or an echo of the task, cut to four sentences."""
    lang, text = F.col("lang"), F.col("text")
    raw = (
        F.when(lang == "en", F.concat(F.lit("Explanation: [ASSISTANT] "), text))
        .when(lang == "de", F.concat(F.lit("Here is the explanation: "), text))
        .when(lang == "fr", F.concat(F.lit("Explain the text."), text))
        .otherwise(F.concat(F.lit(" opening ideas).  "), text))
    )
    instruction = F.lit("Explain the TEXT.\nIn short.")
    return documents(spark, sf_dir).select("doc_id", R.clean_explanation(raw, instruction).alias("output"))


_NOT_WORD = "[^\\p{L}\\p{M}\\p{N}_]"


def _word(w: str) -> str:
    return f"regexp_matches(t, '(?i)(^|{_NOT_WORD}){w}($|{_NOT_WORD})')"


@query(f"""
WITH a AS (SELECT doc_id, lang, {sql_strip("text")} AS t FROM documents),
x AS (SELECT doc_id, {sql_end_mark(sql_sentences('t'))} AS marked FROM a)
SELECT doc_id, CASE
    WHEN lang = 'en' THEN CASE WHEN {_word('no')} THEN 'No' WHEN t = '' THEN 'Unknown' ELSE string_split(t, ' ')[1] END
    WHEN lang = 'de' THEN array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[a-h][1-8][a-h][1-8][qrnb]?'))), ' ')
    WHEN lang = 'fr' THEN {sql_one_line('marked')}
    ELSE {sql_one_line('t')} END AS answer
FROM a JOIN x USING (doc_id)
""")
def normalized_answers(spark, sf_dir):
    """Scorer-side answers by task: yes or no, move lists, explanations and plain text."""
    docs = documents(spark, sf_dir)
    lang = F.col("lang")
    task = F.when(lang == "en", "is_square_attacked").when(lang == "de", "list_legal_moves").otherwise("identify_outcome")
    clean = F.concat(F.lit("explanation: "), F.when(lang == "en", F.regexp_replace("text", r"(?i)\byes\b", "yes ")).otherwise(F.col("text")))
    raw = F.when(lang == "en", F.col("text")).otherwise(clean)
    return docs.select("doc_id", R.normalize_answer(task, raw, lang == "fr").alias("answer"))


@query("""
SELECT event_id, CASE event_type
  WHEN 'signup' THEN 'Nf3' WHEN 'error' THEN 'e2e4' WHEN 'click' THEN 'd7d8q'
  WHEN 'view' THEN CASE WHEN length(CAST(k AS VARCHAR)) >= 2 THEN CAST(k AS VARCHAR) ELSE '' END ELSE 'O-O' END AS move,
  CASE WHEN event_type IN ('signup', 'error') THEN 'K' ELSE CASE WHEN event_type = 'click' THEN 'n' ELSE 'the' END END AS piece,
  CASE event_type WHEN 'signup' THEN 'White' WHEN 'error' THEN 'Black' WHEN 'click' THEN 'Unknown' ELSE 'grey' END AS color
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def normalized_moves(spark, sf_dir):
    """Moves, pieces and colours picked out of prose."""
    ev = events(spark, sf_dir).withColumn("k", k_of())
    kind = F.col("event_type")

    def say(signup, error, click, view, other):
        return (F.when(kind == "signup", signup).when(kind == "error", error).when(kind == "click", click)
                .when(kind == "view", view).otherwise(other))

    k = F.col("k").cast("string")
    move = say("explanation: I think Nf3 wins", "play Nf6 or e2e4 now", "[ASSISTANT] d7d8q", k, "castle with O-O")
    piece = say("it is the K there", "the K", "n", "the rook", "the bishop")
    color = say("clearly WHITE", "a black piece", "", "grey", "grey one")
    return ev.select(
        "event_id", R.normalize_answer(F.lit("predict_move"), F.concat(move, F.lit(""))).alias("move"),
        R.normalize_answer(F.lit("identify_piece"), piece).alias("piece"),
        R.normalize_answer(F.lit("identify_color"), color).alias("color"),
    )


@query("""
SELECT conv_id, turn, '[INST] Predict the next move. [SEP] [FEN] ' || role || ' [SEP] [PGN] ' || text || ' [/INST]' AS prompt, role AS fen
FROM conversations
""")
def tagged_prompts(spark, sf_dir):
    """Prompts built from a template and the position read back out of them."""
    prompt = P.p1_prompt(F.lit("Predict the next move."), F.col("role"), F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("prompt"))
    return rows.withColumn("fen", P.extract_tag(F.col("prompt"), "[FEN]"))


@query(r"""
SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[\n\r\x{85}\x{2028}\x{2029}]') THEN trim(text, ' ' || chr(9) || chr(11) || chr(12)) END AS body FROM documents
""")
def tagged_documents(spark, sf_dir):
    """Text after a tag, for whole documents; a text of several lines has no tag end on its line."""
    prompt = F.concat(F.lit("[DOC] "), "text", F.lit(" [SEP]"))
    return table(spark, sf_dir, "documents").select("doc_id", P.extract_tag(prompt, "[DOC]").alias("body"))


@query("""
SELECT event_id, 'game' || user_id || '_' || event_id || '_' || substr(event_type, 1, 1) || '_'
  || CASE event_type WHEN 'signup' THEN 'P2.1_General' WHEN 'error' THEN 'p2_x_y' WHEN 'view' THEN 'a_b' ELSE event_type END AS task_id,
  CASE event_type WHEN 'signup' THEN 'P2.1_General' WHEN 'error' THEN 'p2_x_y' WHEN 'view' THEN 'a' ELSE event_type END AS subtype,
  'unknown_subtype' AS short_subtype
FROM events
""")
def task_ids(spark, sf_dir):
    kind = F.col("event_type")
    rule = F.when(kind == "signup", "P2.1_General").when(kind == "error", "p2_x_y").when(kind == "view", "a_b").otherwise(kind)
    game = F.concat(F.lit("game"), F.col("user_id").cast("string"))
    tid = P.make_task_id(game, F.col("event_id"), F.substring(kind, 1, 1), rule)
    rows = table(spark, sf_dir, "events").select("event_id", tid.alias("task_id"), game.alias("game"))
    return rows.select("event_id", "task_id", P.task_subtype(F.col("task_id")).alias("subtype"),
                       P.task_subtype(F.col("game")).alias("short_subtype"))


@query("""
SELECT CAST(conv_id AS VARCHAR) || '_' || turn AS task_id, text AS input,
       CASE WHEN role = 'system' THEN NULL ELSE coalesce(CASE WHEN role = 'user' THEN 'raw ' || text END, text) END AS teacher_raw_output,
       CASE WHEN role = 'system' THEN NULL ELSE text END AS output, role, role = 'assistant' AS corrected
FROM conversations
""")
def conformed_rows(spark, sf_dir):
    """Differently shaped rows brought to the training schema; a missing raw text is filled."""
    conv = table(spark, sf_dir, "conversations")
    raw = F.when(F.col("role") == "user", F.concat(F.lit("raw "), "text"))
    rows = conv.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task_id"),
        F.col("text").alias("input"), raw.alias("teacher_raw_output"),
        F.when(F.col("role") != "system", F.col("text")).alias("output"), "role",
    )
    required = ["task_id", "input", "teacher_raw_output", "output"]
    return conform_schema(rows, required, {"teacher_raw_output": "output"})


@query(f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\s\\x0b]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CAST(len(w) - 1 AS BIGINT) AS n_prefix, w[1] AS first_word, w[len(w)] AS last_word FROM t WHERE len(w) > 0
""")
def last_words(spark, sf_dir):
    cut = split_last(words(F.col("text")))
    rows = documents(spark, sf_dir).select("doc_id", cut.alias("c")).where("c IS NOT NULL")
    first = F.coalesce(F.try_element_at("c.prefix", F.lit(1)), "c.last")
    return rows.select("doc_id", F.size("c.prefix").cast("long").alias("n_prefix"), first.alias("first_word"), F.col("c.last").alias("last_word"))


@query("""
SELECT doc_id, regexp_replace(source || ' / ' || lang || '.é-1', '[^\\p{L}\\p{N}_-]', '_', 'g') AS name FROM documents
""")
def sanitized_names(spark, sf_dir):
    name = F.concat("source", F.lit(" / "), "lang", F.lit(".é-1"))
    return table(spark, sf_dir, "documents").select("doc_id", sanitize_name(name).alias("name"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 10 THEN 'v' || p_size END AS version, CASE WHEN p_size > 10 THEN p_retailprice END AS alpha,
       CASE WHEN p_size > 10 THEN CAST(p_partkey AS DOUBLE) END AS beta FROM part
""")
def experiment_names(spark, sf_dir):
    size = F.col("p_size")
    name = F.concat_ws("_", F.lit("combine"), F.concat(F.lit("v"), size.cast("string")),
                       F.when(size > 10, F.col("p_retailprice").cast("string")).otherwise("none"), F.col("p_partkey").cast("string"))
    e = P.parse_experiment_name(name)
    return table(spark, sf_dir, "part").select("p_partkey", e["version"].alias("version"), e["alpha"].alias("alpha"), e["beta"].alias("beta"))


@query("""
SELECT conv_id, turn, text FROM conversations WHERE role <> 'system' AND trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''
""")
def kept_answers(spark, sf_dir):
    """Answers left after the failed and the empty ones are dropped."""
    conv = table(spark, sf_dir, "conversations")
    raw = F.when(F.col("role") == "system", "GENERATION_ERROR").otherwise(F.col("text"))
    rows = conv.withColumns({"raw": raw, "clean": R.strip(F.col("text"))})
    return J.drop_failed(rows, "raw", "clean").select("conv_id", "turn", "text")


_ANSWERS_CTE = f"""
a AS (SELECT CAST(conv_id AS VARCHAR) || '_' || turn || '_w_P2.1_General' AS task_id, text AS input, {sql_strip("text")} AS t, role FROM conversations),
b AS (SELECT task_id, input, role, {sql_end_mark(sql_sentences('t'))} AS marked FROM a WHERE role <> 'system')"""


@query(f"""
WITH {_ANSWERS_CTE}
SELECT task_id, input, {sql_one_line('marked')} AS output FROM b WHERE marked <> ''
""")
def merged_answer_stream(spark, sf_dir):
    """Answers written as JSON-line files with repeats and failures, merged twice as a stream."""
    from plyforge.session import scratch_path
    from plyforge.streaming.merge import merge_stream

    conv = table(spark, sf_dir, "conversations")
    tid = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("w"), F.lit("P2.1_General"))
    raw = F.when(F.col("role") == "system", "GENERATION_ERROR").otherwise(F.col("text"))
    rows = conv.select(tid.alias("task_id"), F.col("text").alias("input"), raw.alias("teacher_raw_output"),
                       F.lit("Explain it.").alias("teacher_task_instruction"))
    base = scratch_path(spark, "merge")
    rows.write.json(f"{base}/in")
    merge_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    rows.write.mode("append").json(f"{base}/in")
    merge_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("task_id", "input", "output")


@query("""
(SELECT 'P1' AS data_source, text AS input FROM conversations WHERE role = 'user' AND text IS NOT NULL ORDER BY conv_id, turn LIMIT 120)
UNION ALL
(SELECT 'P2', text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL ORDER BY conv_id, turn LIMIT 90)
""")
def evaluation_inputs(spark, sf_dir):
    """The first samples of two files of turns, in the order of the files, tagged and put together."""
    from plyforge.plans.answers import evaluation_samples
    from plyforge.session import scratch_path

    base = scratch_path(spark, "samples")
    conv = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    for role in ("user", "assistant"):
        rows = conv.where(F.col("role") == role).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
        rows.select(F.col("text").alias("input")).write.json(f"{base}/{role}")
    found = evaluation_samples(spark, "input STRING", f"{base}/user", f"{base}/assistant", 120, 90)
    return found.select("data_source", "input")


@query("""
WITH a AS (SELECT role AS kind, CASE turn % 4 WHEN 0 THEN '{"verdict": "Good"}' WHEN 1 THEN '' WHEN 2 THEN text || ' Dubious' ELSE text END AS o,
    CASE WHEN conv_id % 5 <> 0 THEN turn * 10 END AS s, conv_id % 5 = 0 AS illegal, turn FROM conversations),
v AS (SELECT *, CASE WHEN turn % 4 = 0 THEN 'good' WHEN contains(lower(o), 'excellent') THEN 'excellent' WHEN contains(lower(o), 'good') THEN 'good'
    WHEN contains(lower(o), 'dubious') THEN 'dubious' WHEN contains(lower(o), 'blunder') THEN 'blunder' ELSE 'parse_error' END AS verdict FROM a),
t AS (SELECT kind, count(*) AS total, count(*) FILTER (illegal) AS illegal, count(*) FILTER (o = '') AS empty, coalesce(sum(s), 0) AS score_sum FROM v GROUP BY kind)
SELECT v.kind, verdict, count(*) AS n, any_value(t.total) AS total, CAST(any_value(t.illegal) AS BIGINT) AS illegal,
       CAST(any_value(t.empty) AS BIGINT) AS empty, CAST(any_value(t.score_sum) AS BIGINT) AS score_sum
FROM v JOIN t ON v.kind = t.kind GROUP BY v.kind, verdict
""")
def verdicts_of_turns(spark, sf_dir):
    """Verdicts read from turns as answers, JSON, empty or in words, counted per role."""
    from plyforge.plans.answers import verdict_report

    kind = F.col("turn") % 4
    told = F.when(kind == 0, '{"verdict": "Good"}').when(kind == 1, "").when(kind == 2, F.concat("text", F.lit(" Dubious"))).otherwise(F.col("text"))
    illegal = F.col("conv_id") % 5 == 0
    return verdict_report(table(spark, sf_dir, "conversations").select(
        F.col("role").alias("kind"), told.alias("llm_output"), F.when(~illegal, F.col("turn") * 10).alias("stockfish_score"),
        F.when(illegal, "illegal").alias("score_status")))


@query("""
SELECT count(*) AS n, CAST(count(*) FILTER (p_size % 2 = 0) AS BIGINT) AS even, sum(p_size) AS rating FROM part WHERE p_size % 3 <> 0
""")
def puzzles_that_agree(spark, sf_dir):
    """Parts as puzzles, all of them drawn, kept where the supplied best move is their last one."""
    from plyforge.plans.answers import puzzle_samples

    part = table(spark, sf_dir, "part")
    puzzles = part.select(F.concat(F.lit("f"), "p_partkey").alias("FEN"), F.concat(F.lit("m1 m"), F.col("p_size").cast("string")).alias("Moves"),
                          F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("Themes"), F.col("p_size").alias("Rating"))
    positions = puzzles.select("FEN", "Moves", F.concat(F.lit("g"), "FEN").alias("fen_before"))
    best = part.select(F.concat(F.lit("gf"), "p_partkey").alias("fen"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("m"), F.col("p_size").cast("string"))).alias("move"))
    rows = puzzle_samples(puzzles, 10**9, 42, positions, best)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("theme") == "even").alias("even"), F.sum("rating").alias("rating"))

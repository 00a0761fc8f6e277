"""Readers of answers over the given texts, with moves and remarks spliced in at places that vary; the SQL
works every answer out."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions import metrics as M
from plyforge.functions import notation as N
from plyforge.functions import prompts as P
from plyforge.functions import responses as R
from plyforge.functions.core import words
from plyforge.queries.answers import _UCI_K, _uci, sql_strip
from plyforge.queries.joins import WORDS
from plyforge.queries.registry import documents, events, query, table
from plyforge.queries.standins import SQL_MOVES, SQL_PAIRS, event_moves, k_of, turn_pairs
from plyforge.queries.tasks import _lit, sql_fill

_EVENT_K = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

# A turn with a move after its n-th word, n and the kind of move given by its number and length. Letters
# outside ASCII are replaced, because the two engines do not agree on where words end at them.
_SANS = "['e2e4', 'Nf3', 'O-O', 'b7b8q', 'plays Rad1', 'exd5', 'h1', 'none']"
SQL_SPOKEN = f"""
a AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM conversations),
w AS (SELECT conv_id, turn, {WORDS.format('text')} AS w, length(text) AS n FROM a),
s AS (SELECT conv_id, turn, ({_SANS})[1 + n % 8] AS said, CAST(n % (len(w) + 1) AS BIGINT) AS pos, w FROM w),
t AS (SELECT conv_id, turn, array_to_string(list_concat(list_concat(w[1:pos], [said]), w[pos + 1:len(w)]), ' ') AS t FROM s)"""


def _spoken(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("e2e4", "Nf3", "O-O", "b7b8q", "plays Rad1", "exd5", "h1", "none")]),
                        (F.length("text") % 8 + 1).cast("int"))
    rows = conv.select("conv_id", "turn", said.alias("said"), words(F.col("text")).alias("w"), F.length("text").alias("n"))
    at = (F.col("n") % (F.size("w") + 1)).cast("int")
    text = F.concat(F.slice("w", F.lit(1), at), F.array("said"), F.slice("w", at + 1, F.size("w")))
    return rows.select("conv_id", "turn", F.array_join(text, " ").alias("t"))


def _first(*found: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({f}, '')" for f in found) + ", '')"


@query(f"""
WITH {SQL_SPOKEN}
SELECT conv_id, turn, {_first(
    f"regexp_extract(t, {_lit(chr(92) + 'b(' + K.UCI + ')' + chr(92) + 'b')}, 1)", f"regexp_extract(t, {_lit(K.ANSWER_SAN)}, 0)",
    "CASE WHEN length(string_split(t, ' ')[1]) BETWEEN 2 AND 7 THEN string_split(t, ' ')[1] END")} AS move,
  {_first(*[f"regexp_extract(t, {_lit(p)}, 1)" for p in K.ANSWER_PIECE], "string_split(t, ' ')[1]")} AS piece
FROM t
""")
def spoken_moves(spark, sf_dir):
    """Moves and pieces picked out of turns that hold one somewhere, in either notation, or none."""
    rows = _spoken(spark, sf_dir)
    return rows.select("conv_id", "turn", R.normalize_answer(F.lit("predict_move"), F.col("t")).alias("move"),
                       R.normalize_answer(F.lit("identify_piece"), F.col("t")).alias("piece"))


@query("""
WITH t AS (SELECT doc_id, replace(replace(text, ' the ', CASE WHEN doc_id % 3 = 0 THEN ' WHITE ' ELSE ' the ' END), ' and ', ' black ') AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\\bwhite\\b') THEN 'White' WHEN regexp_matches(t, '(?i)\\bblack\\b') THEN 'Black'
  ELSE string_split(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' ')[1] END AS color FROM t
""")
def spoken_colors(spark, sf_dir):
    """Colours named somewhere in whole documents."""
    white = F.when(F.col("doc_id") % 3 == 0, " WHITE ").otherwise(" the ")
    text = F.replace(F.replace("text", F.lit(" the "), white), F.lit(" and "), F.lit(" black "))
    return documents(spark, sf_dir).select("doc_id", R.normalize_answer(F.lit("identify_color"), text).alias("color"))


@query(f"""
WITH e AS (SELECT event_id, k, event_type, {_UCI_K} AS u, substr('abcdefgh', CAST(k % 8 + 1 AS BIGINT), 1) || '2' || substr('abcdefgh', CAST(k % 8 + 1 AS BIGINT), 1) || '4' AS v FROM {_EVENT_K}),
d AS (SELECT *, list_filter([u, 'h9', v, 'a1a1'], lambda m: list_contains(['a1d6', 'b2b4', 'c3f8', 'd2d4', 'e5h2'], m)) AS hits FROM e)
SELECT event_id, CASE WHEN k % 3 = 0 AND list_contains(hits, v) THEN v WHEN k % 3 = 1 AND event_type = 'error' THEN NULL ELSE hits[1] END AS move FROM d
""")
def allowed_moves(spark, sf_dir):
    """The allowed one of several moves in an answer: the one a JSON answer names, else the first in the text."""
    ev = events(spark, sf_dir).withColumn("k", k_of())
    k, file = F.col("k"), F.substring(F.lit("abcdefgh"), (F.col("k") % 8 + 1).cast("int"), F.lit(1))
    u, v = _uci(k), F.concat(file, F.lit("2"), file, F.lit("4"))
    prose = F.concat_ws(" ", F.lit("Maybe"), F.upper(u), F.lit("or h9 or"), v, F.lit("not a1a1."))
    text = (
        F.when(k % 3 == 0, F.concat(F.lit('{"move": "'), F.upper(v), F.lit('", "explanation": "'), prose, F.lit('"}')))
        .when((k % 3 == 1) & (F.col("event_type") == "error"), F.concat(F.lit('{"move": '), prose)).otherwise(prose)
    )
    allowed = F.array(*[F.lit(m) for m in ("a1d6", "b2b4", "c3f8", "d2d4", "e5h2")])
    return ev.select("event_id", R.parse_move_response(text, allowed).alias("move"))


@query(f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE role || chr(10) || 'My EXPLANATION: ' || text END AS t FROM conversations),
l AS (SELECT conv_id, turn, list_filter(string_split(t, chr(10)), lambda x: contains(lower(x), 'explanation:'))[1] AS line FROM t)
SELECT conv_id, turn, {sql_strip("substr(line, strpos(line, ':') + 1)")} AS explanation FROM l
""")
def told_explanations(spark, sf_dir):
    """What a turn says after the mark, wherever its line stands; NULL without one."""
    text = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat("role", F.lit("\\nMy EXPLANATION: "), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.parse_explanation_response(text).alias("explanation"))


@query(f"""
SELECT event_id, CASE substr('!?!!??!.!', CAST(k % 8 + 1 AS BIGINT), CAST(k % 3 AS BIGINT))
  {' '.join(f"WHEN {_lit(mark)} THEN {_lit(name)}" for mark, name in K.QUALITY.items())} END AS quality FROM {_EVENT_K}
""")
def quality_marks(spark, sf_dir):
    """Labels of marks of all kinds and lengths, and of what is none."""
    ev = events(spark, sf_dir).withColumn("k", k_of())
    mark = F.substring(F.lit("!?!!??!.!"), (F.col("k") % 8 + 1).cast("int"), (F.col("k") % 3).cast("int"))
    return ev.select("event_id", N.quality_label(mark).alias("quality"))


_SPECIAL = """CASE WHEN suffix = '#' THEN 'Checkmate' WHEN suffix = '+' THEN 'Check' WHEN contains(san, 'x') THEN 'Capture'
  WHEN contains(san, '=') THEN 'Promotion to ' || san[strpos(san, '=') + 1] WHEN starts_with(san, 'O-O-O') THEN 'Queenside Castling'
  WHEN starts_with(san, 'O-O') THEN 'Kingside Castling' ELSE event_type END"""


def _asked(name: str) -> str:
    return sql_fill(K.EVENT_QUESTIONS[name], s="san", e="lower(event)" if name == "Promotion" else "event")


@query(f"""
WITH {SQL_MOVES}, e AS (SELECT event_id, san, {_SPECIAL} AS event FROM moves)
SELECT event_id, CASE {' '.join(f"WHEN event = '{n}' THEN {_asked(n)}" for n in ('Check', 'Checkmate', 'Capture'))}
  {' '.join(f"WHEN contains(event, '{n}') THEN {_asked(n)}" for n in ('Promotion', 'Castling'))} ELSE {_asked('other')} END AS instruction FROM e
""")
def move_instructions(spark, sf_dir):
    """The question about what each move did, with the move in it."""
    moves = event_moves(spark, sf_dir)
    kind = N.classify_move(F.col("san"))
    event = F.coalesce(kind["outcome"], kind["special_move"], F.col("event_type"))
    return moves.select("event_id", P.event_instruction(event, F.col("san")).alias("instruction"))


@query(f"""
WITH {SQL_PAIRS}, w AS (SELECT conv_id, turn, {WORDS.format('pred')}[1] AS p, {WORDS.format('ref')}[1] AS r FROM pairs)
SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 OR conv_id % 2 = 0 THEN lower(p) ELSE p END = CASE WHEN conv_id % 2 = 0 THEN lower(p) ELSE r END, false) AS hit FROM w
""")
def resolved_matches(spark, sf_dir):
    """First words of replies against those of the turns before them, some through an alias."""
    pairs = turn_pairs(spark, sf_dir)
    p, r = F.get(words(F.col("pred")), F.lit(0)), F.get(words(F.col("ref")), F.lit(0))
    even = F.col("conv_id") % 2 == 0
    alias = F.when((F.col("turn") % 2 == 0) | even, F.lower(p))
    return pairs.select("conv_id", "turn", M.move_exact_match(p, F.when(even, F.lower(p)).otherwise(r), alias).alias("hit"))

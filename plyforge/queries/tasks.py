"""Task rows and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions import prompts as P
from plyforge.operators import games as G
from plyforge.plans import tasks as T
from plyforge.queries.registry import query, table
from plyforge.queries.sampling import sql_hash01
from plyforge.queries.standins import SQL_MOVES, event_moves

QUALITY_CASE = "CASE nag WHEN '!' THEN 'Good' WHEN '??' THEN 'Blunder' WHEN '!?' THEN 'Interesting' WHEN '?!' THEN 'Dubious' END"
BOARDS = ["rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR", "8/8/8/3k4/8/3K4/8/8", "4k3/P7/8/8/8/8/7p/4K3"]
SQL_BOARDS = "['" + "','".join(BOARDS) + "']"

# Events as plies with everything the rules read: notes, position, history and supplied facts.
SQL_PLIES = f"""
{SQL_MOVES},
p0 AS (SELECT game_id, ply, CASE WHEN ply % 2 = 0 THEN 'w' ELSE 'b' END AS side, san, 'm' || event_id AS uci, k,
  CASE WHEN suffix = '#' THEN 'Checkmate' WHEN suffix = '+' THEN 'Check' WHEN contains(san, 'x') THEN 'Capture' END AS outcome,
  CASE WHEN contains(san, '=Q') THEN 'Promotion to Q' WHEN contains(san, '=N') THEN 'Promotion to N'
       WHEN starts_with(san, 'O-O-O') THEN 'Queenside Castling' WHEN starts_with(san, 'O-O') THEN 'Kingside Castling' END AS special_move,
  {QUALITY_CASE} AS quality,
  CASE WHEN k % 4 = 0 THEN 'Checkmate is now unavoidable. Nf3 was best.' WHEN k % 4 = 1 THEN 'by ' || user_id WHEN k % 4 = 2 THEN 'a longer comment by ' || user_id END AS comment,
  ({SQL_BOARDS})[1 + k % 3] || ' w - - 0 1' AS fen_before,
  CASE WHEN ply % 2 = 0 THEN (ply // 2 + 1) || '. ' || san ELSE san END AS token, event_id FROM moves),
plies AS (SELECT *, coalesce(string_agg(token, ' ') OVER (PARTITION BY game_id ORDER BY ply ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS history,
  game_id || '|' || ply AS hkey, game_id || '_' || ply || '_' || side AS base FROM p0)"""


def event_plies(spark, sf_dir):
    moves = event_moves(spark, sf_dir).withColumn("user", F.col("user_id").cast("string"))
    k = F.col("k")
    kind = G.N.classify_move(F.col("san"))
    comment = (
        F.when(k % 4 == 0, "Checkmate is now unavoidable. Nf3 was best.")
        .when(k % 4 == 1, F.concat(F.lit("by "), "user")).when(k % 4 == 2, F.concat(F.lit("a longer comment by "), "user"))
    )
    board = F.element_at(F.array(*[F.lit(b) for b in BOARDS]), (k % 3 + 1).cast("int"))
    plies = G.half_move_index(moves, "game_id", "event_id", "san", "ply").select(
        "game_id", "ply", "k", "san", F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("uci"),
        F.when(F.col("ply") % 2 == 0, "w").otherwise("b").alias("side"),
        kind["outcome"].alias("outcome"), kind["special_move"].alias("special_move"),
        G.N.quality_label(F.regexp_extract("san", r"([?!]{1,2})", 1)).alias("quality"),
        comment.alias("comment"), F.concat(board, F.lit(" w - - 0 1")).alias("fen_before"),
        G.history_token(F.floor(F.col("ply") / 2) + 1, F.col("ply") % 2 == 0, F.col("san")).alias("token"),
    )
    return G.recent_history(plies, "game_id", "ply", "token")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template: str, **values: str) -> str:
    """A template as SQL: its literal parts and SQL expressions in the place of its gaps, joined."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(_lit(text))
        if name:
            parts.append(values[name])
    return "(" + " || ".join(parts) + ")"


def _ask(task: str, **values: str) -> str:
    return sql_fill(K.P1_QUESTIONS[task], **values)


def _choice(rule: str, task: str) -> str:
    return f"CASE WHEN {sql_hash01('42', 'hide_' + task, 'hkey')} >= 0.2 THEN '{K.CHOICES[task]}' ELSE '' END"


def _p1(task: str, instruction: str, output: str, when: str, source: str = "plies") -> str:
    return f"""SELECT base || '_{task}' AS task_id, '{task}' AS task,
      {sql_fill(K.P1_PROMPT, i=instruction, f='fen_before', h='history')} AS input, {output} AS output FROM {source} WHERE {when}"""


_NOTES = [
    _p1("predict_move", _ask("predict_move"), "uci", f"{sql_hash01('42', 'predict_move', 'hkey')} < 0.25"),
    _p1("identify_outcome", f"{_ask('identify_outcome', s='san')} || {_choice('', 'identify_outcome')}", "outcome", "outcome IS NOT NULL"),
    _p1("identify_special_move", f"{_ask('identify_special_move', s='san')} || {_choice('', 'identify_special_move')}",
        "CASE WHEN starts_with(special_move, 'Promotion') THEN 'Promotion' ELSE special_move END", "special_move IS NOT NULL"),
    _p1("identify_quality", f"{_ask('identify_quality', s='san')} || {_choice('', 'identify_quality')}", "quality", "quality IS NOT NULL"),
    _p1("parse_comment_best_move", _ask("parse_comment_best_move", s="san"), "'Nf3'", "k % 4 = 0"),
    _p1("parse_comment_mate_unavoidable", _ask("parse_comment_mate_unavoidable", s="san"), "'Yes'", "k % 4 = 0"),
]


@query(f"WITH {SQL_PLIES} {' UNION ALL '.join(_NOTES)}")
def note_tasks(spark, sf_dir):
    """Phase 1 rows of the rules that read a move's notes, all rules in one pass."""
    return T.p1_tasks(event_plies(spark, sf_dir), ["game_id", "ply"])


def _pick(arr: str, rule: str) -> str:
    return f"{arr}[1 + CAST(floor({sql_hash01('42', rule, 'hkey')} * len({arr})) AS BIGINT)]"


# Facts: pawn-like moves m from each occupied square, and attacked squares by file letter.
SQL_FACTS = f"""
{SQL_PLIES},
b1 AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(string_split(fen_before, ' ')[1], '/', ''), '8', '........'), '7', '.......'), '5', '.....'), '4', '....'), '3', '...'), '1', '.') AS board FROM plies),
b2 AS (SELECT *, list_filter(list_transform(range(1, 65), lambda i: {{'sq': substr('abcdefgh', (i - 1) % 8 + 1, 1) || (8 - (i - 1) // 8), 'p': board[i]}}), lambda s: s.p <> '.') AS occ,
  list_transform(range(0, 64), lambda i: substr('abcdefgh', i % 8 + 1, 1) || (i // 8 + 1)) AS squares FROM b1),
b3 AS (SELECT *, list_transform(occ, lambda s: s.sq || CASE WHEN k % 2 = 0 THEN 'a1' ELSE 'h8' END) AS legal FROM b2 WHERE {sql_hash01('42', 'basic', 'hkey')} < 0.05),
facts AS (SELECT *, {_pick('occ', 'occupied')} AS seen, {_pick('occ', 'mover')} AS mover, {_pick('squares', 'target')} AS target, {_pick('squares', 'goal')} AS goal,
  ({_pick("['White','Black']", 'attacker')}) AS attacker FROM b3)"""


def _color(x: str) -> str:
    return f"CASE WHEN upper({x}.p) = {x}.p THEN 'White' ELSE 'Black' END"


_BOARD = [
    _p1("list_legal_moves", _ask("list_legal_moves"), "array_to_string(list_sort(legal), ' ')", "true", "facts"),
    _p1("identify_piece", f"{_ask('identify_piece', q='seen.sq')} || {_choice('', 'identify_piece')}", "upper(seen.p)", "true", "facts"),
    _p1("identify_color", f"{_ask('identify_color', q='seen.sq')} || {_choice('', 'identify_color')}", _color("seen"), "true", "facts"),
    _p1("is_square_attacked", _ask("is_square_attacked", q="target", a="attacker"),
        "CASE WHEN (attacker = 'White') = (target[1] < 'e') THEN 'Yes' ELSE 'No' END", "true", "facts"),
    _p1("can_piece_move", _ask("can_piece_move", p="mover.p", f="mover.sq", t="goal"),
        "CASE WHEN list_contains(legal, mover.sq || goal || CASE WHEN upper(mover.p) = 'P' AND goal[2] IN ('1', '8') THEN 'q' ELSE '' END) THEN 'Yes' ELSE 'No' END", "true", "facts"),
]


@query(f"WITH {SQL_FACTS} {' UNION ALL '.join(_BOARD)}")
def board_tasks(spark, sf_dir):
    """Phase 1 rows of the board rules, with labels from supplied facts."""
    plies = event_plies(spark, sf_dir)
    occupied = F.filter(G.N.board_squares(F.col("fen_before")), lambda s: s["piece"].isNotNull())
    end = F.when(F.col("k") % 2 == 0, "a1").otherwise("h8")
    squares = [f"{f}{r}" for r in range(1, 9) for f in "abcdefgh"]
    facts = plies.select(
        "game_id", "ply",
        F.transform(occupied, lambda s: F.concat(s["square"], end)).alias("legal_moves"),
        F.struct(
            F.array(*[F.lit(s) for s in squares if s[0] < "e"]).alias("white"),
            F.array(*[F.lit(s) for s in squares if s[0] >= "e"]).alias("black"),
        ).alias("attacked"),
    )
    rows = T.p1_tasks(G.attach_positions(plies, facts, ["game_id", "ply"]), ["game_id", "ply"], facts=True)
    board = ["list_legal_moves", "identify_piece", "identify_color", "is_square_attacked", "can_piece_move"]
    return rows.where(F.col("task").isin(board))


def _p2(task: str, student: str, teacher: str, when: str, best: str = "NULL") -> str:
    return f"""SELECT base || '_' || {task} AS task_id, {task} AS task, {student} AS student, {teacher} AS teacher, {best} AS best,
      fen_before, history, uci, san, quality, comment, coalesce(outcome, special_move) AS event FROM plies WHERE {when}"""


_EVENT = "coalesce(outcome, special_move)"
_VALUES = {"s": "san", "q": "quality", "b": "'Nf3'", "c": "comment", "e": _EVENT}


def _both(name: str) -> tuple[str, str]:
    return sql_fill(K.P2_STUDENT[name], **_VALUES), sql_fill(K.P2_TEACHER[name], **_VALUES)


def _event_question() -> str:
    asked = {n: sql_fill(t, s="san", e=f"lower({_EVENT})" if n == "Promotion" else _EVENT) for n, t in K.EVENT_QUESTIONS.items()}
    plain = " ".join(f"WHEN {_EVENT} = '{n}' THEN {asked[n]}" for n in ("Check", "Checkmate", "Capture"))
    parts = " ".join(f"WHEN contains({_EVENT}, '{n}') THEN {asked[n]}" for n in ("Promotion", "Castling"))
    return f"CASE {plain} {parts} ELSE {asked['other']} END"


_P2 = [
    _p2("'P2.1_General'", *_both("P2.1_General"), f"{sql_hash01('42', 'P2.1_General', 'hkey')} < 0.05"),
    _p2("'P2.2a_Quality'", *_both("P2.2a_Quality"), "quality IS NOT NULL"),
    _p2("'P2.2b_BestMoveComment'", *_both("P2.2b_BestMoveComment"), "k % 4 = 0", "'Nf3'"),
    _p2("'P2.2c_GeneralComment'", *_both("P2.2c_GeneralComment"), "k % 4 IN (1, 2) AND length(comment) > 10"),
    _p2(f"'P2.3_Event_' || replace({_EVENT}, ' ', '')", _event_question(), sql_fill(K.P2_TEACHER["P2.3_Event_"], **_VALUES),
        f"{_EVENT} IS NOT NULL AND {sql_hash01('42', 'P2.3_Event_', 'hkey')} < 0.25"),
]

_LINE = K.TEACHER_CONTEXT
_SQL_CONTEXT = " || ".join([
    f"{_lit(_LINE['fen'])} || fen_before || chr(10) || {_lit(_LINE['history'])} || history || chr(10) || {sql_fill(_LINE['move'], u='uci', s='san')}",
    *[f"coalesce(chr(10) || {_lit(_LINE[n])} || {n}, '')" for n in ("quality", "comment", "event", "best")],
])


@query(f"""
WITH {SQL_PLIES}, rows AS ({' UNION ALL '.join(_P2)})
SELECT task_id, task, {sql_fill(K.STUDENT_PROMPT, i='student', f='fen_before', h='history', m='uci')} AS student_prompt_input,
  {sql_fill(K.TEACHER_PROMPT, sys=_lit(K.TEACHER_SYSTEM + K.TEACHER_EXAMPLES), ctx=_SQL_CONTEXT, task='teacher')} AS teacher_prompt_full,
  event AS event_from_pgn, best AS best_move
FROM rows
""")
def explanation_prompts(spark, sf_dir):
    """Phase 2 student and teacher prompts with their context."""
    rows = T.p2_prompts(event_plies(spark, sf_dir), ["game_id", "ply"])
    return rows.select("task_id", "task", "student_prompt_input", "teacher_prompt_full",
                       F.col("metadata_for_teacher_context.event_from_pgn").alias("event_from_pgn"),
                       F.col("metadata_for_teacher_context.best_move_from_comment").alias("best_move"))


_KINDS = list(K.ENGINE_PROMPTS)


def _sql_prompt(kind: str) -> str:
    filled = sql_fill(K.ENGINE_PROMPTS[kind], fen="role", move="'e2e4'", explanation="text")
    return f"SELECT conv_id, turn, '{kind}' AS kind, {filled} AS prompt FROM conversations"


@query(" UNION ALL ".join(_sql_prompt(k) for k in _KINDS))
def engine_prompts(spark, sf_dir):
    """Every fixed question text, filled in for every turn."""
    conv = table(spark, sf_dir, "conversations")
    values = {"fen": F.col("role"), "move": F.lit("e2e4"), "explanation": F.col("text")}
    made = F.array(*[F.struct(F.lit(k).alias("kind"), P.engine_prompt(k, **values).alias("prompt")) for k in _KINDS])
    return conv.select("conv_id", "turn", F.inline(made))

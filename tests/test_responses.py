import pytest
from pyspark.sql import functions as F

from plyforge.functions import prompts as P
from plyforge.functions import responses as R


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ('{"move": " E2E4 "}', "e2e4"), ('{"move": "a1a1"} ', None), ('{"move": "a1a1", "x": "d2d4"}', "d2d4"), ('{"move": "e2e4"} tail', None),
    ("{broken e2e4", None), ("I like A7A8, then D2D4 or e2e4", "d2d4"), ("xe2e4", None), ("", None), ('{"x": 1}', None)])
def test_moves(spark, text, want):
    allowed = F.array(F.lit("e2e4"), F.lit("d2d4"))
    assert one(spark, R.parse_move_response(F.lit(text), allowed)) == want


@pytest.mark.parametrize("text, want", [
    ('{"explanation": "x y"}', "x y"), ('{"move": 1}', None), ("{bad explanation: x", None), ("a\nMy EXPLANATION: b: c \nexplanation: d", "b: c"),
    ("Note: explanation: z", "explanation: z"), ("explanation:", ""), ("none", None)])
def test_explanations(spark, text, want):
    assert one(spark, R.parse_explanation_response(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [
    ('{"verdict": "GOOD"}', "good"), ('{"a": "good"}', "unknown"), ('{"verdict": "x"} blunder', "blunder"), ("dubious, not excellent", "excellent"),
    ("[1]", "parse_error"), ("12", "parse_error"), ("", "parse_error"), ('{"a": 1}, {"b": "good"}', "good")])
def test_verdicts(spark, text, want):
    assert one(spark, R.parse_verdict(F.lit(text))) == want


def test_labelled_lines(spark):
    r = one(spark, R.parse_labelled_lines(F.lit("\nmove: x move: e2e4\nexplanation: good \nmore")))
    assert (r["move"], r["explanation"]) == ("e2e4", "good")
    r = one(spark, R.parse_labelled_lines(F.lit("move: e2e4")))
    assert (r["move"], r["explanation"]) == (None, None)


def test_reasoning(spark):
    r = one(spark, R.parse_reasoning(F.lit("Reasoning: it is Reasoning: so Move: e2e4 now Move: x")))
    assert (r["explanation"], r["move"]) == ("it is  so", "e2e4")
    for text in ("no move here", "Reasoning: a Move:  "):
        r = one(spark, R.parse_reasoning(F.lit(text)))
        assert (r["explanation"], r["move"]) == (text, "0000")


@pytest.mark.parametrize("raw, instruction, want", [
    (" Explanation: [ASSISTANT] One.  Two!\nThree? Four. Five.", None, "One. Two! Three? Four."),
    ("Explanation: Explanation: x", None, "Explanation: x."),
    ("Explain THIS. because", "Explain this.\nmore", "because."),
    ("opening ideas). Yes", "Other.", "Yes."),
    ("opening ideas). Yes", None, "opening ideas). Yes."),
    ("   ", "a", ""),
    ("explanation:", None, "explanation:."),
    ("A  b\nc", None, "A b c."),
])
def test_cleaning(spark, raw, instruction, want):
    i = None if instruction is None else F.lit(instruction)
    assert one(spark, R.clean_explanation(F.lit(raw), i)) == want


@pytest.mark.parametrize("task, raw, want", [
    ("predict_move", "explanation: I think best move is Nf3.", "Nf3"), ("predict_move", "Nf3 or e7e8q", "e7e8q"), ("predict_move", "Hello world", "Hello"),
    ("predict_move", "incredible thing", ""), ("predict_move", "", ""), ("Predict_Move", "O-O", "O-O"),
    ("identify_piece", "the Q", "Q"), ("identify_piece", "queen", "q"), ("identify_piece", "zzz yyy", "zzz"), ("identify_piece", "", ""),
    ("identify_color", "not black but WHITE", "White"), ("identify_color", "grey one", "grey"), ("identify_color", "", "Unknown"),
    ("can_piece_move", "Nope. no", "No"), ("parse_comment_mate_unavoidable", "no, yes", "Yes"), ("is_square_attacked", "", "Unknown"),
    ("list_legal_moves", "e2e4 d2d4,e2e4 e7e8q", "d2d4 e2e4 e7e8q"), ("list_legal_moves", "none", ""),
    ("extract_comment_best_move", "Nf3 was", "Nf3"), ("parse_comment_best_move", "well Nf3", "well"),
    ("identify_outcome", "a  b\nc", "a b c"),
    ("identify_outcome", "(e.g., central control, x opening ideas). [assistant] Check", "Check"),
    ("identify_outcome", "3 resulted in 'Check'. Explain concisely what, position. rest", "rest"),
])
def test_normalising(spark, task, raw, want):
    assert one(spark, R.normalize_answer(F.lit(task), F.lit(raw))) == want


def test_normalising_explanations_and_simple_moves(spark):
    assert one(spark, R.normalize_answer(F.lit("x"), F.lit("Okay, here's an explanation: A. B. C. D. E."), True)) == "A. B. C. D."
    assert one(spark, R.normalize_answer(F.lit("x"), F.lit(" "), True)) == ""
    assert one(spark, R.normalize_answer(F.lit("predict_move"), F.lit("play e2e4"), simple_moves=True)) == "play"
    assert one(spark, R.normalize_answer(F.lit("predict_move"), F.lit("e2e4 wins"), simple_moves=True)) == "e2e4"


@pytest.mark.parametrize("task_id, want", [("game1_0_w_P2.1_General", "P2.1_General"), ("game1_3_b_P2.3_Event_Capture", "P2.3_Event_Capture"),
                                           ("a_b_c_d_e", "d"), ("a_b", "unknown_subtype"), ("", "unknown_subtype")])
def test_task_subtypes(spark, task_id, want):
    assert one(spark, P.task_subtype(F.lit(task_id))) == want


def test_prompt_texts(spark):
    t = one(spark, P.teacher_prompt(*[F.lit(x) for x in ("task", "fen", "hist", "e2e4", "e4")], F.lit(""), F.lit(None).cast("string"), F.lit("Check")))
    assert t.endswith("Move Played: e2e4 (e4)\nMove Event: Check\n\nTask: task\n\nExplanation:\n[ASSISTANT]")
    assert one(spark, P.engine_prompt("move_plus_explanation", fen=F.lit("F"))).count('{"move": "e2e4"') == 1
    assert one(spark, P.extract_tag(F.lit("[INST] a [SEP] [FEN]  8/8 w  [SEP] [PGN] x [/INST]"))) == "8/8 w"
    assert one(spark, P.extract_tag(F.lit("nothing"))) is None
    e = one(spark, P.parse_experiment_name(F.lit("combine_v3_0.5_1")))
    assert (e["version"], e["alpha"], e["beta"]) == ("v3", 0.5, 1.0)
    assert one(spark, P.parse_experiment_name(F.lit("combine_v3_x_1"))) is None and one(spark, P.parse_experiment_name(F.lit("combine"))) is None

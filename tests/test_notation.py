import pytest
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions import core as C
from plyforge.functions import notation as N
from plyforge.operators import games as G

MOVETEXT = """1. e4! {[%eval 0.17] [%clk 0:01:02] (a note) Nf3 was best.} e5 (1... c5 2. Nf3 (2. c3 {x)}) d6)
2. Qh7+! $3 Kd8 {[%eval #-3]
two lines} 3. O-O-O a1=N?? 4. e8=Q# 1-0"""


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("0.17", 17.0), (" +1.5 ", 150.0), ("#3", 9997.0), ("#-3", -9997.0), ("#+2", 9998.0), ("#0", 10000.0), ("#-0", -10000.0),
    ("-.5", -50.0), ("5.", 500.0), ("++2", 200.0), ("0.5/20", None), ("-+2", None), ("x", None), ("", None), ("#", None), ("1d", None),
])
def test_parse_eval(spark, text, want):
    got = one(spark, N.parse_eval(F.lit(text)))
    assert got == pytest.approx(want) if want is not None else got is None


def test_headers_last_value_wins(spark):
    text = '[Event "a"]\n[White "x "q" y"]\nnot a tag\n[Event "b"]\n[ Elo  "12" ]\n  [Late "no"]'
    assert one(spark, N.parse_headers(F.lit(text))) == {"Event": "b", "White": 'x "q" y', "Elo": "12"}
    assert one(spark, N.parse_headers(F.lit("none"))) == {}


def test_movetext(spark):
    df = spark.createDataFrame([(1, MOVETEXT)], ["id", "text"])
    rows = G.with_move_facts(G.tokenize_movetext(df, "id", "text")).orderBy("ply").collect()
    assert [(r["move_number"], r["side"], r["san"]) for r in rows] == [
        (1, "w", "e4!"), (1, "b", "e5"), (2, "w", "Qh7+!"), (2, "b", "Kd8"), (3, "w", "O-O-O"), (3, "b", "a1=N??"), (4, "w", "e8=Q#")]
    assert rows[0]["comment"] == "(a note) Nf3 was best." and rows[0]["eval_cp"] == pytest.approx(17) and rows[0]["clock"] == "0:01:02"
    assert rows[3]["comment"] == "two lines" and rows[3]["eval_cp"] == -9997
    assert [r["quality"] for r in rows] == ["Good", None, "Good", None, None, "Blunder", None]
    assert [r["outcome"] for r in rows] == [None, None, "Check", None, None, None, "Checkmate"]
    assert [r["special_move"] for r in rows] == [None, None, None, None, "Queenside Castling", "Promotion to N", "Promotion to Q"]


def test_black_first_game(spark):
    df = spark.createDataFrame([(1, "12... Nf6 13. e4 d5", "8/8/8/8/8/8/8/8 b - - 0 12")], ["id", "text", "fen"])
    rows = G.tokenize_movetext(df, "id", "text", fen="fen").orderBy("ply").collect()
    assert [(r["move_number"], r["side"]) for r in rows] == [(12, "b"), (13, "w"), (13, "b")]


def test_unreadable_game_is_dropped_or_skipped(spark):
    df = spark.createDataFrame([(1, "1. e4 e5 1-0"), (2, "1. e4 ??? zz9 e5")], ["id", "text"])
    assert {r["id"] for r in G.tokenize_movetext(df, "id", "text").collect()} == {1}
    assert G.tokenize_movetext(df, "id", "text", on_bad="skip_move").where("id = 2").count() == 2


def test_annotations_without_content(spark):
    a = one(spark, N.parse_annotations(F.lit("{ [%clk 0:00] } {  }")))
    assert a["eval_cp"] is None and a["clock"] == "0:00" and a["comment"] is None


def test_comments(spark):
    text = "a {x} {[%eval 1] dropped} { } {two\nlines} {open"
    assert one(spark, N.comments_in(F.lit(text))) == ["x", "two\nlines"]


def test_best_move_and_phrases(spark):
    assert one(spark, N.best_move_from_comment(F.lit("Inaccuracy. NXF3 WAS best. e4 was best."))) == "NXF3"
    assert one(spark, N.best_move_from_comment(F.lit("nothing"))) is None
    assert one(spark, N.mentions(F.lit(None).cast("string"))) is False


def test_board(spark):
    rows = spark.range(1).select(F.inline(N.board_squares(F.lit(K.START_FEN)))).collect()
    by = {r["square"]: (r["piece"], r["color"]) for r in rows}
    assert len(by) == 64
    assert by["e1"] == ("K", "White") and by["d8"] == ("Q", "Black") and by["a1"] == ("R", "White") and by["e4"] == (None, None)


@pytest.mark.parametrize("a, b, want", [(None, 1.0, True), (9500.0, 9500.0, True), (9500.0, 9600.0, False), (-9500.0, 9500.0, False),
                                        (10.0, 60.0, True), (10.0, 60.5, False), (9500.0, 9000.0, False)])
def test_scores_agree(spark, a, b, want):
    assert one(spark, N.scores_agree(F.lit(a).cast("double"), F.lit(b).cast("double"))) is want


def test_clock_seconds(spark):
    assert one(spark, N.clock_seconds(F.lit("1:02:03"))) == 3723 and one(spark, N.clock_seconds(F.lit("02:03"))) == 123


def test_variations_of_any_depth(spark):
    deep = "1. e4 (1. d4 (1. c4 (1. b4 (1. a4 (1. f4 {in (} f5))))) e5 {a (b)} 2. Nf3"
    texts = [deep, "1. e4 (1. d4 e5", "1. e4 e5) 2. d4", "1. e4 e5"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", N.strip_movetext(F.col("text")).alias("t")).collect()}
    assert got == {0: "1. e4 e5 {a (b)} 2. Nf3", 1: texts[1], 2: texts[2], 3: texts[3]}
    left = {r["id"] for r in df.where(N.unread_movetext(F.col("text")).isNotNull()).collect()}
    assert left == {1, 2}


def test_words_are_split_at_any_white_space(spark):
    text = "un\xa0mot :\u202fdeux\u3000trois\x1cquatre\tcinq "
    row = spark.createDataFrame([(text,)], "t string").select(C.words(F.col("t")).alias("w"), C.strip(F.lit("\xa0 x \u2003")).alias("s")).first()
    assert row["w"] == text.split() and row["s"] == "x"

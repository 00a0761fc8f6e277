import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.functions.core import is_close, ngrams, words
from plyforge.operators import games as G
from plyforge.operators import matching as J
from plyforge.operators import shaping as S
from plyforge.plans import report as R
from plyforge.plans import tasks as T


def test_encode_cuts_pads_and_masks(spark):
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id int")
    df = spark.createDataFrame([(1, "a b", "b"), (2, "a a a a", "b b"), (3, "", "zz"), (4, "a", "")], "id int, p string, o string")
    rows = {r["id"]: r for r in S.encode(df, "id", words(F.col("p")), words(F.col("o")), vocab, 5).collect()}
    assert rows[1]["input_ids"] == [3, 4, 4, 2, 0] and rows[1]["attention_mask"] == [1, 1, 1, 1, 0] and rows[1]["labels"] == [-100, -100, 4, 2, -100]
    assert rows[2]["input_ids"] == [3, 3, 3, 3, 4] and rows[2]["labels"] == [-100] * 4 + [4]
    assert rows[3]["input_ids"] == [1, 2, 0, 0, 0] and rows[4]["input_ids"] == [3, 2, 0, 0, 0]
    kept = {r["id"]: r for r in S.encode(df, "id", words(F.col("p")), words(F.col("o")), vocab, 5, mask_pads=False, reserve_eos=True).collect()}
    assert kept[2]["input_ids"] == [3, 3, 3, 3, 2] and kept[1]["labels"] == [-100, -100, 4, 2, 0]


def test_encode_keeps_rows_that_share_an_id(spark):
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id int")
    df = spark.createDataFrame([(1, "a", "b"), (1, "b b", "a"), (1, "a", "b"), (None, "", "")], "id int, p string, o string")
    got = sorted(r["input_ids"] for r in S.encode(df, "id", words(F.col("p")), words(F.col("o")), vocab, 4).collect())
    assert got == [[2, 0, 0, 0], [3, 4, 2, 0], [3, 4, 2, 0], [4, 4, 3, 2]]


def test_vocabulary_ties_go_by_name(spark):
    df = spark.createDataFrame([("b a b c",), ("a d",)], ["t"])
    rows = S.build_vocab(df, words(F.col("t")), 3).collect()
    assert {(r["token"], r["n"], r["id"]) for r in rows} == {("a", 2, 3), ("b", 2, 4), ("c", 1, 5)}


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(ngrams(F.col("t"), 2)).collect()] == [["a b", "b c"], [], []]
    assert [r[0] for r in df.select(ngrams(F.col("t"), 3)).collect()] == [["a b c"], [], []]


def test_conform_schema(spark):
    df = spark.createDataFrame([("1", "in", "out", "x"), ("2", "in", None, "y")], "task_id string, input string, output string, extra string")
    rows = S.conform_schema(df, ["task_id", "input", "teacher_raw_output", "output"], {"teacher_raw_output": "output"}).orderBy("task_id").collect()
    assert rows[0]["teacher_raw_output"] == "out" and rows[0]["corrected"] and rows[0]["extra"] == "x"
    assert rows[1]["teacher_raw_output"] is None and not rows[1]["corrected"]


def test_criteria_match(spark):
    exps = spark.createDataFrame([("e2", "v1", 0.3, 1.0), ("e1", "v1", 0.1 + 0.2, 1.0), ("e0", "v2", 0.3, 1.0), ("e9", "v1", 0.30001, 1.0), ("n", None, 0.0, 0.0)],
                                 "folder string, version string, alpha double, beta double")
    crit = spark.createDataFrame([("a", "v1", 0.3, 1.0), ("b", "v2", 0.3, 2.0), ("c", "v1", 0.30001, 1.0000001), ("d", None, 0.0, 0.0), ("e", "v1", -0.3, 1.0)],
                                 "id string, version string, alpha double, beta double")
    rows = J.match_criteria(crit, exps, "id", ["alpha", "beta"], ["version"]).collect()
    assert {r["id"]: r["folder"] for r in rows} == {"a": "e1", "b": None, "c": "e9", "d": "n", "e": None}


@pytest.mark.parametrize("a, b", [(1.0, 1.00001), (1e6, 1e6 + 9), (0.0, 1e-9), (1e6, 1e6 + 11), (0.0, 1e-7)])
def test_criteria_cells_lose_nothing(spark, a, b):
    """The cell join finds what a plain comparison finds."""
    want = spark.range(1).select(is_close(F.lit(a), F.lit(b))).first()[0]
    exps = spark.createDataFrame([("f", a)], "folder string, x double")
    crit = spark.createDataFrame([("c", b)], "id string, x double")
    assert (J.match_criteria(crit, exps, "id", ["x"], []).first()["folder"] == "f") is want


@pytest.mark.parametrize("rtol, atol", [(1e-5, 1e-8), (0.01, 0.5), (0.0, 0.25), (0.1, 0.0)])
def test_criteria_of_all_sizes(spark, rtol, atol):
    values = [s * v for s in (1, -1) for v in (0.0, 1e-9, 1e-3, 0.4, 1.0, 1.2, 7.0, 1e6, 1e6 + 5, 1e12)]
    exps = spark.createDataFrame([(f"f{i:02}", v) for i, v in enumerate(values)], "folder string, x double")
    crit = spark.createDataFrame([(i, v * 1.000004) for i, v in enumerate(values)], "id int, x double")
    got = {r["id"]: r["folder"] for r in J.match_criteria(crit, exps, "id", ["x"], [], rtol=rtol, atol=atol).collect()}
    for i, v in enumerate(values):
        c = v * 1.000004
        want = [f"f{j:02}" for j, w in enumerate(values) if abs(w - c) <= atol + rtol * abs(c)]
        assert got[i] == (want[0] if want else None) or (not want and got[i] is None) or got[i] in want[:1] or v == 0, (c, want)


def test_engine_lines(spark):
    eng = spark.createDataFrame([("p", 2, "b", 10), ("p", 1, "a", 30), ("p", 3, "c", None), ("q", 1, "z", 5)], "pos_id string, rank int, move string, score long")
    got = {(r["pos_id"], r["k"]): (r["baseline"], r["fallback"]) for r in J.baseline_at_k(eng, [1, 3, 5]).collect()}
    assert got == {("p", 1): (30, False), ("p", 3): (None, False), ("p", 5): (30, True), ("q", 1): (5, False), ("q", 3): (5, True), ("q", 5): (5, True)}
    preds = spark.createDataFrame([("p", "b"), ("x", "b")], "pos_id string, move string")
    rows = {r["pos_id"]: r["top"] for r in J.attach_engine(preds, eng, [1, 2]).collect()}
    assert rows == {"p": ["a", "b"], "x": None}


def test_caches(spark):
    prompts = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], ["input"])
    cache = spark.createDataFrame([("a",)], ["input"]).select(F.sha2("input", 256).alias("prompt_hash"), F.lit("A").alias("response"))
    hits, misses = J.probe_cache(prompts, cache)
    assert [r["response"] for r in hits.collect()] == ["A"] and sorted(r["input"] for r in misses.collect()) == ["b", "c"]
    new = misses.select("prompt_hash", F.upper("input").alias("response"))
    assert J.extend_cache(cache, new.union(cache.withColumn("response", F.lit("other")))).count() == 3
    scores = spark.createDataFrame([("k1", 1.0)], "key string, value double")
    computed = spark.createDataFrame([("k1", 9.0), ("k2", 2.0), ("k2", 2.0), ("k3", None)], "key string, value double")
    assert [tuple(r) for r in G.new_scores(scores, computed, "key").collect()] == [("k2", 2.0)]


def test_fill_scores(spark):
    plies = spark.createDataFrame([("a", None), ("b", 10.0), ("c", 10.0), ("d", 10.0), ("e", None)], "key string, eval_cp double")
    scores = spark.createDataFrame([("a", 5.0), ("b", 20.0), ("c", 90.0)], "key string, value double")
    want = {"a": (5.0, "filled"), "b": (10.0, "validated"), "c": (10.0, "mismatch"), "d": (10.0, "kept"), "e": (None, "missing")}
    got = {r["key"]: (r["eval_cp"], r["score_status"]) for r in G.fill_scores(plies, scores, "key").collect()}
    assert got == want
    over = {r["key"]: r["eval_cp"] for r in G.fill_scores(plies, scores, "key", overwrite=True).collect()}
    assert over == {"a": 5.0, "b": 20.0, "c": 90.0, "d": 10.0, "e": None}


def test_attached_positions(spark):
    plies = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "g int, p int")
    facts = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "g int, p int, fen_before string")
    sizes = {m: G.attach_positions(plies, facts, ["g", "p"], m).count() for m in ("keep", "skip_move", "drop_game")}
    assert sizes == {"keep": 3, "skip_move": 2, "drop_game": 1}


def plies_fixture(spark):
    rows = [("g", i, "w" if i % 2 == 0 else "b", f"s{i}", f"u{i}", "Capture" if i % 3 == 0 else None, "Kingside Castling" if i % 5 == 0 else None,
             "Good" if i % 4 == 0 else None, ["Nf3 was best.", "short", "a long enough comment", None][i % 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "game string, ply int, side string, san string, uci string, outcome string, special_move string, quality string, comment string")
    facts = F.struct(F.array(F.lit("a1")).alias("white"), F.array().cast("array<string>").alias("black"))
    return df.withColumns({"fen_before": F.lit(K.START_FEN), "history": F.lit("1. e4"), "legal_moves": F.array(F.lit("b1c3"), F.lit("a2a3")), "attacked": facts})


def test_p1_tasks(spark):
    rows = T.p1_tasks(plies_fixture(spark), ["game", "ply"], facts=True).collect()
    count = {}
    for r in rows:
        count[r["task"]] = count.get(r["task"], 0) + 1
        assert r["input"].startswith("[INST] ") and " [SEP] [FEN] " + K.START_FEN + " [SEP] [PGN] 1. e4 [/INST]" in r["input"]
        assert r["task_id"].endswith(f"_{r['task']}")
    assert count["identify_outcome"] == 67 and count["identify_special_move"] == 40 and count["identify_quality"] == 50 and count["parse_comment_best_move"] == 50
    assert 30 <= count["predict_move"] <= 70
    board = ["list_legal_moves", "identify_piece", "identify_color", "is_square_attacked", "can_piece_move"]
    assert len({count[t] for t in board}) == 1 and 2 <= count["identify_piece"] <= 25
    assert {r["output"] for r in rows if r["task"] == "list_legal_moves"} == {"a2a3 b1c3"}
    assert {r["output"] for r in rows if r["task"] == "identify_piece"} <= set("KQRBNP")
    for r in rows:
        if r["task"] == "identify_color":
            square = r["input"].split("on square ")[1][:2]
            assert r["output"] == ("White" if square[1] in "12" else "Black")
    shown = [r for r in rows if r["task"] == "identify_outcome" and "Choose:" in r["input"]]
    assert 40 <= len(shown) <= 64
    hidden = T.p1_tasks(plies_fixture(spark).repartition(7), ["game", "ply"], facts=True)
    assert sorted(map(tuple, hidden.collect())) == sorted(map(tuple, rows))


def test_p2_prompts_and_training_rows(spark):
    prompts = T.p2_prompts(plies_fixture(spark), ["game", "ply"])
    rows = prompts.collect()
    tasks = {r["task"] for r in rows}
    assert {"P2.2a_Quality", "P2.2b_BestMoveComment", "P2.2c_GeneralComment", "P2.3_Event_Capture", "P2.3_Event_KingsideCastling"} <= tasks
    assert sum(r["task"] == "P2.2b_BestMoveComment" for r in rows) == 50 and sum(r["task"] == "P2.2c_GeneralComment" for r in rows) == 50
    best = next(r for r in rows if r["task"] == "P2.2b_BestMoveComment")
    assert "Alternative Best Move suggested in comment: Nf3" in best["teacher_prompt_full"] and best["metadata_for_teacher_context"]["best_move_from_comment"] == "Nf3"
    assert best["student_prompt_input"].endswith(f"[MOVE] {best['metadata_for_teacher_context']['uci_move_played']} [/INST]")
    answers = prompts.select("task_id", F.when(F.col("task").startswith("P2.3"), "GENERATION_ERROR").when(F.col("task") == "P2.2a_Quality", " ")
                             .otherwise(F.concat("teacher_task_instruction", F.lit(" Because"))).alias("raw"))
    trained = T.training_rows(prompts, answers).collect()
    assert {r["output"] for r in trained} == {"Because."}
    assert len(trained) == sum(not r["task"].startswith(("P2.3", "P2.2a")) for r in rows)


def test_report_table(spark):
    metrics = spark.createDataFrame([("m1", "a", 0.5), ("m2", "a", 0.5000001), ("m1", "b", 3.0), ("m2", "b", None), ("m3", "b", 2.0)], "model string, metric string, value double")
    config = S.metric_config(spark, [("G", "a", "A", True, "%.3f"), ("G", "b", "B", False, "%.1f")])
    rows = {r["model"]: (r["A"], r["B"]) for r in R.report_table(metrics, config, ["m1", "m2", "m3"], ["%.3f", "%.1f"]).collect()}
    assert rows == {"m1": ("0.500*", "3.0"), "m2": ("0.500*", "N/A"), "m3": ("N/A", "2.0*")}
    flipped = {r["title"]: (r["m1"], r["m2"], r["m3"]) for r in R.report_table(metrics, config, ["m1", "m2", "m3"], ["%.3f", "%.1f"], transpose=True).collect()}
    assert flipped == {"A": ("0.500*", "0.500*", "N/A"), "B": ("3.0", "N/A", "2.0*")}
    assert S.metric_config(spark, K.REPORT_COLUMNS).count() == 10


def test_unions_and_models(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(2, 5.0)], "id int, v double")
    assert {tuple(r) for r in S.union_tagged({"P1": a, "P2": b}).select("id", "t", "v", "data_source").collect()} == {(1, "x", None, "P1"), (2, None, 5.0, "P2")}
    assert J.cross_inputs(a, ["m", "n"]).count() == 2
    many = J.cross_inputs(a, spark.range(1001).select(F.col("id").cast("string").alias("name")))
    assert many.count() == 1001 == many.select("model").distinct().count()
    assert S.difference(a.union(a), b, "id").collect()[0][0] == 1


def test_criteria_as_by_plain_comparison(spark):
    """Random values close together, in one column and in two, with copies, NULLs and numbers that are none."""
    rng, odd = random.Random(5), [None, float("nan"), float("inf"), -float("inf"), -0.0]
    value = lambda i: odd[i] if i < len(odd) else round(rng.gauss(0, 4), 1)
    exps = spark.createDataFrame([(f"f{rng.randrange(10**6):06}" if i else None, rng.choice([None, 1, 2]), value(i), value(i // 2 + 3)) for i in range(150)],
                                 "folder string, v int, x double, y double")
    crit = spark.createDataFrame([(i // 2 if i > 7 else None, rng.choice([None, 1, 2]), value(i), value(i // 2 + 3)) for i in range(120)], "id int, v int, x double, y double")
    for close, exact, rtol, atol in ((["x"], ["v"], 0.01, 0.5), (["x", "y"], [], 0.3, 0.0), (["x", "y"], ["v"], 0.0, 0.25)):
        test = F.expr("c.v <=> e.v") if exact else F.lit(True)
        for k in close:
            test = test & is_close(F.col(f"e.{k}"), F.col(f"c.{k}"), rtol, atol)
        want = crit.alias("c").join(exps.alias("e"), test).groupBy("c.id").agg(F.min("folder").alias("folder"))
        want = crit.join(want, "id", "left").collect()
        got = J.match_criteria(crit, exps, "id", close, exact, rtol=rtol, atol=atol).collect()
        assert Counter(map(str, got)) == Counter(map(str, want))


def test_criteria_meet_few_rows(spark, tmp_path):
    """All experiments are near all criteria; no step makes rows for the pairs."""
    n = 4000
    exps = spark.range(n).select(F.format_string("e%04d", F.lit(n) - F.col("id")).alias("folder"), (1 + F.col("id") / 1e9).alias("x"))
    crit = spark.range(n).select("id", (1 + F.col("id") / 1e9).alias("x"))
    found = J.match_criteria(crit, exps, "id", ["x"], [], rtol=0.01, atol=0.5)
    assert found.groupBy("folder").count().collect() == [("e0001", n)]
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    stack, most = [plan], 0
    while stack:
        p = stack.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            p = p.plan()
        if p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        stack += [p.children().apply(i) for i in range(p.children().length())]
    assert n <= most <= 30 * n

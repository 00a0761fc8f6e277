import json

import pytest
from pyspark.sql import functions as F

from plyforge import constants as K
from plyforge.__main__ import main
from plyforge.operators import games as G
from plyforge.operators import metrics as A
from plyforge.plans.archive import archive_counters, flat_plies, position_requests
from plyforge.plans.evaluate import evaluate
from plyforge.sources import tables

PROMPT = "[INST] q [SEP] [FEN] {} [SEP] [PGN]  [/INST]"
W, B = "8/8 w - - 0 1", "8/8 b - - 0 1"
SAMPLES = [
    (1, "P1", "predict_move", "x", PROMPT.format(W), "e2e4", "e2e4"),
    (2, "P1", "predict_move", "x", PROMPT.format(B), "Nf6", "g8f6"),
    (3, "P1", "predict_move", "x", PROMPT.format(B), "a7a5", "g8f6"),
    (4, "P1", "identify_piece", "x", PROMPT.format(W), "K", "k"),
    (5, "P1", "list_legal_moves", "x", PROMPT.format(W), "e2e4 d2d4", "e2e4"),
    (6, "P2", None, "g_0_w_P2.1_General", "i", "A b c.", "A b c."),
    (7, "P2", None, "g_1_w_P2.2a_Quality", "i", "A b.", "x y."),
]
ENGINE = [(W, 1, "d2d4", 50), (W, 2, "e2e4", 40), (B, 1, "g8f6", -30), (B, 2, "e7e5", -20)]
AFTER = [(W, "e2e4", 40), (B, "g8f6", -30), (B, "a7a5", 10)]
ALIASES = [(B, "Nf6", "g8f6")]
NAMES = ["sample_id", "data_source", "task", "task_id", "input", "raw", "reference"]


def test_evaluation(spark):
    samples = spark.createDataFrame(SAMPLES, "sample_id long, data_source string, task string, task_id string, input string, raw string, reference string")
    engine = spark.createDataFrame(ENGINE, "pos_id string, rank int, move string, score long")
    after = spark.createDataFrame(AFTER, "pos_id string, move string, score long")
    aliases = spark.createDataFrame(ALIASES, "pos_id string, answer string, uci string")
    metrics, counts, scored = evaluate(samples, engine, after, aliases, (1, 2), (1, 2))
    got = {r["metric"]: r["value"] for r in metrics.collect()}
    want = {
        # Given away: 10 by white, 0 and 40 by black; at K = 2: 0, -10 and 30.
        "average_ssd_cp_vs_sf_top1": 16.67, "average_ssd_cp_vs_sf_top2": 6.67,
        "avg_delta_llm_vs_sf_wpov_vs_top1": 10.0, "median_delta_llm_vs_sf_wpov_vs_top1": 0.0,
        "avg_delta_sf_vs_gt_wpov_vs_top2": 6.67, "llm_better_than_gt_rate": 0.0, "avg_delta_llm_vs_gt_cp": 13.33,
        "max_delta_llm_vs_gt_cp": 40.0, "predict_move_em_accuracy": 0.6667, "predict_move_sf_in_top1_accuracy": 0.3333,
        "top_2_agreement_rate": 0.6667, "identify_piece_accuracy": 1.0, "list_legal_moves_f1_avg": 0.6667,
        "rouge_1_f1_overall": 0.5, "rouge_l_f1_avg_P2.1_General": 1.0, "avg_norm_edit_distance_overall": 0.25,
        "bleu_4_overall": 0.3162, "distinct_1_overall": 0.8, "distinct_2_overall": 1.0,
    }
    assert {k: got[k] for k in want} == want
    assert {(r["task"], r["correct"], r["total"]) for r in counts.collect()} == {("predict_move_em", 2, 3), ("identify_piece", 1, 1), ("list_legal_moves", 0, 1)}
    assert scored.count() == 7
    only_moves, _, _ = evaluate(samples.where("sample_id < 4"))
    assert {r["metric"] for r in only_moves.collect()} == {"predict_move_em_accuracy"}


def test_archive_counters(spark, tmp_path):
    (tmp_path / "a.pgn").write_text('[Event "1"]\n[Result "1-0"]\n\n1. e4 {[%eval 0.1]} e5 1-0\n\n[Event "2"]\n[Result "*"]\n\n1. d4 *\n\n[Event "3"]\n\n1. e4 ?zz\n')
    (tmp_path / "b.pgn").write_text('[Event "4"]\n\n1. c4 c5 2. c3\n')
    rows = {r["file"] and r["file"][-5:]: r for r in archive_counters(spark, str(tmp_path), skip_unfinished=True).collect()}
    a, total = rows["a.pgn"], rows[None]
    assert [a[c] for c in ("games_found", "games_filtered_out", "games_skipped_parsing_error", "games_processed", "moves_total", "moves_with_pgn_eval")] == [3, 1, 1, 1, 2, 1]
    assert (total["games_found"], total["games_processed"], total["moves_total"]) == (4, 2, 5)


def test_score_counters(spark):
    plies = spark.createDataFrame([("a", None), ("b", 10.0), ("c", 10.0), ("d", None)], "key string, old double").withColumn("eval_cp", F.col("old"))
    scores = spark.createDataFrame([("a", 5.0), ("b", 20.0), ("c", 90.0)], "key string, value double")
    filled = G.fill_scores(plies, scores, "key").withColumn("file", F.lit("f"))
    row = G.score_counters(filled, "file", F.col("old").isNotNull()).where("file IS NOT NULL").first()
    assert tuple(row)[1:] == (0, 4, 2, 2, 1, 0, 1)


def nested(n):
    def move(i):
        return {"san": f"s{i}", "uci": f"u{i}", "outcome": "Check" if i == 1 else None, "special_move": None, "quality": "Good" if i == 0 else None,
                "eval_cp": None, "clock": None, "comment": None}
    return {"game_metadata": {"fen": K.START_FEN, "result": "1-0", "variant": "Standard", "pgn": [
        {"move_number": 1, "white_move": move(0), "black_move": move(1)}, {"move_number": 2, "white_move": move(10 + n), "black_move": None}]},
        "synthetic_data": [], "distilled_data": []}


def test_indented_json_arrays_are_read_in_pieces(spark, tmp_path):
    games = [nested(i) for i in range(40)]
    path = tmp_path / "g.json"
    path.write_text(json.dumps(games, indent=2))
    (tmp_path / "flat.json").write_text(json.dumps(games))
    rows, plain = (sorted(str(r) for r in tables.read_json_auto(spark, str(p), tables.GAME_SCHEMA).collect()) for p in (path, tmp_path / "flat.json"))
    (tmp_path / "crlf.json").write_bytes(json.dumps(games, indent=2).replace("\n", "\r\n").encode())
    assert tables.read_json_auto(spark, str(tmp_path / "crlf.json"), tables.GAME_SCHEMA).count() == 40


def test_flat_plies_and_requests(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(g) for g in (nested(1), nested(1), nested(2))))
    games = tables.read_json_auto(spark, str(tmp_path / "g.jsonl"), tables.GAME_SCHEMA)
    rows = flat_plies(games).orderBy("half_move").collect()
    assert len(rows) == 9 and [r["history"] for r in rows[::3]] == ["", "1. s0", "1. s0 s1"]
    assert position_requests(games).count() == 2


def test_jobs_end_to_end(spark, tmp_path):
    (tmp_path / "games.json").write_text(json.dumps([nested(i) for i in range(20)], indent=2))
    run = lambda *a: main([str(x) for x in a], spark)
    run("requests", "-i", tmp_path / "games.json", "-o", tmp_path / "req")
    assert spark.read.json(str(tmp_path / "req")).first()["moves"][:2] == ["s0", "s1"]
    facts = spark.read.json(str(tmp_path / "req")).select("game_id", F.posexplode("moves").alias("half_move", "m")).drop("m").withColumns({
        "fen_before": F.lit(K.START_FEN), "legal_moves": F.array(F.lit("e2e4")),
        "attacked": F.struct(F.array(F.lit("e4")).alias("white"), F.array(F.lit("e5")).alias("black"))})
    facts.write.json(str(tmp_path / "facts"))
    run("p1-tasks", "-i", tmp_path / "games.json", "--positions", tmp_path / "facts", "-o", tmp_path / "p1")
    tasks = spark.read.json(str(tmp_path / "p1"))
    counts = {r["task"]: r["n"] for r in A.task_counts(tasks).collect()}
    assert counts["identify_outcome"] == 20 and counts["identify_quality"] == 20
    run("p2-prompts", "-i", tmp_path / "games.json", "--positions", tmp_path / "facts", "-o", tmp_path / "p2")
    prompts = spark.read.json(str(tmp_path / "p2"))
    prompts.select("task_id", F.col("student_prompt_input").alias("input"), F.lit("Explanation: fine").alias("teacher_raw_output"),
                   "teacher_task_instruction").write.json(str(tmp_path / "answers"))
    run("merge-answers", "-i", tmp_path / "answers", "-o", tmp_path / "merged", "--state", tmp_path / "state")
    merged = spark.read.parquet(str(tmp_path / "merged"))
    assert merged.count() == prompts.count() and {r[0] for r in merged.select("output").distinct().collect()} == {"fine."}
    merged.write.json(str(tmp_path / "rows"))
    run("conform", "-i", tmp_path / "rows", "-o", tmp_path / "conformed")
    run("encode", "-i", tmp_path / "conformed", "-o", tmp_path / "store", "--max-len", 16, "--vocab-size", 50)
    encoded = spark.read.parquet(str(tmp_path / "store" / "plain_seq16_train"))
    assert encoded.count() == merged.count() and encoded.where("size(input_ids) <> 16").count() == 0
    run("split", "-i", tmp_path / "games.json", "-o", tmp_path / "splits")
    assert {r["split"]: r["count"] for r in spark.read.json(str(tmp_path / "splits")).groupBy("split").count().collect()} == {"train": 16, "val": 2, "test": 2}
    (tmp_path / "samples.jsonl").write_text("\n".join(json.dumps(dict(zip(NAMES, s))) for s in SAMPLES))
    for name, names, rows in (("engine", ["pos_id", "rank", "move", "score"], ENGINE), ("after", ["pos_id", "move", "score"], AFTER)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
    for exp in ("combine_v3_0_0", "combine_v3_1_1"):
        run("score", "-i", tmp_path / "samples.jsonl", "--engine", tmp_path / "engine.jsonl", "--move-scores", tmp_path / "after.jsonl", "-o", tmp_path / "exps" / exp)
    run("report", "-i", tmp_path / "exps", "-o", tmp_path / "table")
    table = spark.read.option("header", True).csv(str(tmp_path / "table")).collect()
    assert len(table) == 2 and table[0]["SF T1 Acc."].endswith("*") and table[0]["BERT-F1"] == "N/A"


def test_archive_jobs(spark, tmp_path):
    (tmp_path / "a.pgn").write_text('[Event "1"]\n[Result "1-0"]\n\n1. e4 {fine} e5 1-0\n\n[Event "2"]\n[Result "*"]\n\n1. d4 {open} *\n')
    main(["parse-archive", "-i", str(tmp_path / "a.pgn"), "-o", str(tmp_path / "games"), "--only-complete"], spark)
    assert spark.read.json(str(tmp_path / "games")).count() == 1
    main(["extract-comments", "-i", str(tmp_path / "a.pgn"), "-o", str(tmp_path / "notes")], spark)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "notes")).collect()) == ["fine", "open"]
    with pytest.raises(SystemExit):
        main(["unknown"], spark)


def test_an_archive_feeds_the_task_jobs(spark, tmp_path):
    """Games as parsed hold no coordinate moves; supplied facts add them."""
    games = "\n".join(f'[Event "{i}"]\n[Result "1-0"]\n\n1. e4! {{a fine move for number {i}}} e5 2. Qh5 {{[%eval 0.5]}} Nc6?? 3. Bc4 Nf6 4. Qxf7# 1-0\n' for i in range(50))
    (tmp_path / "a.pgn").write_text(games)
    run = lambda *a: main([str(x) for x in a], spark)
    run("parse-archive", "-i", tmp_path / "a.pgn", "-o", tmp_path / "games")
    counters = [r for r in spark.read.json(str(tmp_path / "games-counters")).collect() if r["level"]]
    assert [(r["games_processed"], r["moves_total"], r["moves_with_pgn_eval"]) for r in counters] == [(50, 350, 50)]
    run("requests", "-i", tmp_path / "games", "-o", tmp_path / "req")
    asked = spark.read.json(str(tmp_path / "req"))
    assert asked.count() == 50 and asked.first()["moves"] == ["e4!", "e5", "Qh5", "Nc6??", "Bc4", "Nf6", "Qxf7#"]
    facts = asked.select("game_id", F.posexplode("moves").alias("half_move", "m"))
    facts = facts.select("game_id", "half_move", F.concat(F.lit("u"), F.col("half_move")).alias("uci"), F.lit(K.START_FEN).alias("fen_before"))
    facts.where("half_move <> 5").write.json(str(tmp_path / "facts"))
    run("p1-tasks", "-i", tmp_path / "games", "--positions", tmp_path / "facts", "-o", tmp_path / "p1")
    counts = {r["task"]: r["n"] for r in A.task_counts(spark.read.json(str(tmp_path / "p1"))).collect()}
    assert counts["identify_quality"] == 100 and counts["identify_outcome"] == 50 and counts["predict_move"] > 50
    run("p2-prompts", "-i", tmp_path / "games", "--positions", tmp_path / "facts", "-o", tmp_path / "p2")
    prompts = spark.read.json(str(tmp_path / "p2"))
    by_task = {r["task"]: r["n"] for r in A.task_counts(prompts).collect()}
    assert by_task["P2.2a_Quality"] == 100 and by_task["P2.2c_GeneralComment"] == 50
    assert prompts.where("student_prompt_input is null").count() == 0
    # Scores by position, number and side: one is held, one newly computed.
    plies = tables.read_jsonl(spark, str(tmp_path / "facts"), "game_id STRING, half_move INT, uci STRING, fen_before STRING")
    key = F.md5(F.concat_ws("|", "fen_before", (F.floor(F.col("half_move") / 2) + 1).cast("string"), F.when(F.col("half_move") % 2 == 0, "w").otherwise("b")))
    keys = plies.select("half_move", key.alias("key")).distinct()
    keys.where("half_move = 0").select("key", F.lit(30.0).alias("value")).write.json(str(tmp_path / "scores"))
    keys.where("half_move in (0, 1)").select("key", F.lit(40.0).alias("value")).write.json(str(tmp_path / "computed"))
    run("fill-scores", "-i", tmp_path / "games", "--positions", tmp_path / "facts", "--scores", tmp_path / "scores",
        "--computed", tmp_path / "computed", "-o", tmp_path / "filled")
    row = next(r for r in spark.read.json(str(tmp_path / "filled-counters")).collect() if not r["level"])
    assert (row["moves_total"], row["moves_with_pgn_eval"], row["moves_recomputed"], row["moves_missing_eval"]) == (350, 50, 50, 100)
    assert spark.read.json(str(tmp_path / "filled-new")).count() == 1


def test_counters_agree_with_what_is_kept(spark, tmp_path):
    for i in range(25):
        bad = " x9x" if i % 2 else ""
        (tmp_path / f"{i}.pgn").write_text(f'[Event "{i}"]\n[Result "1-0"]\n\n1. e4{bad} e5 1-0\n')
    for on_bad, kept in (("drop_game", 13), ("skip_move", 25)):
        out = tmp_path / on_bad
        main(["parse-archive", "-i", str(tmp_path / "*.pgn"), "-o", str(out), "--on-bad", on_bad], spark)
        rows = spark.read.json(f"{out}-counters").collect()
        total = next(r for r in rows if r["level"])
        assert len(rows) == 26 and total["games_processed"] == kept == spark.read.json(str(out)).count()


def test_report_by_criteria(spark, tmp_path):
    for folder, value in (("combine_v3_0_0", 0.5), ("combine_v3_1_0.5", 0.7), ("other", 0.9)):
        path = tmp_path / "exps" / folder
        path.mkdir(parents=True)
        (path / "result.json").write_text(json.dumps({"args": {}, "aggregated_metrics": {"rouge_l_f1_overall": value}, "accuracy_counts_per_task": {}}))
        (path / "summary.txt").write_text("Model: m\nBeta: 1\n\nrest: no")
    (tmp_path / "criteria.jsonl").write_text("\n".join(json.dumps(dict(zip(("title", "version", "alpha", "beta"), c))) for c in (
        ("Base", "v3", 0.0, 0.0), ("Half", "v3", 1.0, 0.500001), ("None", "v9", 0.0, 0.0))))
    main(["report", "-i", str(tmp_path / "exps"), "-o", str(tmp_path / "table"), "--criteria", str(tmp_path / "criteria.jsonl")], spark)
    rows = {r["model"]: r["ROUGE-L"] for r in spark.read.option("header", True).csv(str(tmp_path / "table")).collect()}
    assert rows == {"Base": "0.500", "Half": "0.700*", "None": "N/A"}
    assert spark.read.json(str(tmp_path / "table-headers")).where("name = 'Beta'").count() == 3


def test_jobs_of_answers(spark, tmp_path):
    """Samples with limits and a cache, a range that is started twice, verdicts, moves and puzzles."""
    import json

    def lines(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)

    def run(*args):
        main(list(map(str, args)), spark)

    def back(path):
        return spark.read.json(f"{tmp_path}/{path}").collect()

    p1 = lines("p1.jsonl", [{"task": "t", "input": f"a{i}"} for i in range(9)] + [{"task": "no input"}])
    (tmp_path / "p2").mkdir()
    for k in "ba":
        lines(f"p2/{k}.jsonl", [{"task_id": f"{k}{i}", "input": f"{k}{i}"} for i in range(4)])
    run("extend-cache", "-i", lines("answers.jsonl", [{"input": "a1", "response": "r1"}, {"input": "x"}]), "-o", tmp_path / "cache", "--batch", "1")
    run("samples", "-i", p1, "--p2", tmp_path / "p2", "--max-p1", 3, "--max-p2", 5, "--cache", tmp_path / "cache", "-o", tmp_path / "s")
    assert sorted((r["data_source"], r["input"]) for r in back("s/samples")) == [("P1", f"a{i}") for i in range(3)] + [("P2", x) for x in ("a0", "a1", "a2", "a3", "b0")]
    assert sorted((r["data_source"], r["response"]) for r in back("s/hits")) == [("P1", "r1"), ("P2", "r1")]
    assert sorted(r["input"] for r in back("s/misses")) == ["a0", "a2", "a3", "b0"]

    prompts = lines("prompts.jsonl", [{"task_id": f"t{i}", "teacher_prompt_full": "p"} for i in range(8)])
    spark.createDataFrame([("t1",), ("t2",)], "task_id string").write.parquet(f"{tmp_path}/done")
    for start, num in ((0, 4), (0, 4), (4, 9)):
        run("prompt-range", "-i", prompts, "-o", tmp_path / "parts", "--done", tmp_path / "done", "--start", start, "--num", num)
    from plyforge.sources import parts
    assert sorted(r["task_id"] for r in parts.read_batches(spark, f"{tmp_path}/parts", "task_id STRING").collect()) == ["t0", "t3", "t4", "t5", "t6", "t7"]

    told = [("random", '{"verdict": "Good"}', 5, None), ("random", "", None, "illegal"), ("topk", "an excellent move", 7, None), ("topk", "?", 1, None)]
    run("verdicts", "-i", lines("v.jsonl", [{"kind": k, "llm_output": o, "stockfish_score": s, "score_status": x} for k, o, s, x in told]), "-o", tmp_path / "v")
    assert sorted((r["kind"], r["verdict"], r["n"], r["total"], r["illegal"], r["empty"], r["score_sum"]) for r in back("v")) == [
        ("random", "good", 1, 2, 1, 1, 5), ("random", "parse_error", 1, 2, 1, 1, 5), ("topk", "excellent", 1, 2, 0, 0, 8), ("topk", "parse_error", 1, 2, 0, 0, 8)]

    asked = [("move_only", "f1", '{"move": "e2e4"}'), ("move_only", "f1", "I play a2a3 here"), ("move_only", "f2", "nothing"), ("plus", "f1", "d2d4\nExplanation: centre")]
    run("generation-stats", "-i", lines("m.jsonl", [{"kind": k, "fen": f, "response": r} for k, f, r in asked]),
        "--legal", lines("l.jsonl", [{"fen": "f1", "moves": ["e2e4", "d2d4", "a2a3"]}, {"fen": "f2", "moves": ["e7e5"]}]),
        "--scores", lines("sc.jsonl", [{"fen": "f1", "move": m, "score": s} for m, s in (("e2e4", 30), ("d2d4", 20), ("a2a3", -5))]), "--k", 2, "-o", tmp_path / "g")
    stats = {r["kind"]: r for r in back("g")}
    one = stats["move_only"]
    assert (one["total_examples"], one["parsed_moves"], one["valid_moves"], one["in_top_k"], one["score_min"], one["score_max"]) == (3, 2, 2, 1, -5, 30)
    assert (stats["plus"]["in_top_k_rate"], stats["plus"]["average_score"]) == (1.0, 20.0)
    assert {r["explanation_parsed"] for r in back("g-moves") if r["kind"] == "plus"} == {"centre"}

    (tmp_path / "p.csv").write_text("FEN,Moves,Themes,Rating\nf1,e2e4 e7e5,x,1\nf2,a2a3,y,2\nf3,b2b3,z,3\n")
    run("puzzles", "-i", tmp_path / "p.csv", "--positions", lines("pos.jsonl", [{"FEN": "f1", "Moves": "e2e4 e7e5", "fen_before": "g1"}]),
        "--best", lines("best.jsonl", [{"fen": "g1", "move": "e7e5"}, {"fen": "f2", "move": "h2h3"}, {"fen": "f3", "move": "b2b3"}]), "-o", tmp_path / "pz")
    got = spark.read.option("header", True).csv(f"{tmp_path}/pz").collect()
    assert sorted((r["prompt"].split(": ")[1], r["completion"].strip()) for r in got) == [("f3", "b2b3"), ("g1", "e7e5")]

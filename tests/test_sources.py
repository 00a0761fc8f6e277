import json
import os

import pytest
from pyspark.sql import functions as F

from plyforge.plans.archive import archive_games, flat_plies, nested_games
from plyforge.sources import archive as A
from plyforge.sources import sinks, tables

ARCHIVE = """[Event "One"]
[Site "s1"]
[Result "1-0"]
[WhiteElo "2100"]
[BlackElo "2000"]

1. e4 {a comment
[Event in a comment} e5 2. Qh5
Nc6 1-0


[Event "Two"]
[Result "*"]

1. d4 *
\t
[Event "Three"]
[Result "0-1"]
[WhiteElo "abc"]

[Event "Four"]
[Result "1/2-1/2"]
[Site "s4"]
[GameURL ""]
[Variant "Chess960"]

1. c4 c5 1/2-1/2
"""


@pytest.fixture
def archive_path(tmp_path):
    (tmp_path / "a.pgn").write_text(ARCHIVE)
    (tmp_path / "crlf.pgn").write_bytes(ARCHIVE.replace("\n", "\r\n").encode())
    return str(tmp_path)


@pytest.mark.parametrize("newline, name", [("\n", "a.pgn"), ("\r\n", "crlf.pgn"), ("\n", "crlf.pgn")])
def test_read_games(spark, archive_path, newline, name):
    rows = A.read_games(spark, f"{archive_path}/{name}", newline).collect()
    heads = [r["header_text"].split("\n")[0] for r in rows]
    assert sorted(heads) == ['[Event "Four"]', '[Event "One"]', '[Event "Three"]', '[Event "Two"]']
    assert len({r["game_id"] for r in rows}) == 4
    # The quick line count also sees the line inside the comment.
    assert A.count_event_lines(spark, f"{archive_path}/{name}").first()["games"] == 5
    one = next(r for r in rows if "One" in r["header_text"])
    assert "[Event in a comment} e5" in one["movetext"] and one["movetext"].endswith("1-0")
    three = next(r for r in rows if "Three" in r["header_text"])
    assert three["movetext"] == ""


def test_a_file_read_in_many_pieces_gives_the_same_games(spark, tmp_path):
    games = [f'[Event "G{i}"]\n[Site "x"]\n\n1. e4 e5 {{note {i}}} 1-0' for i in range(300)]
    (tmp_path / "big.pgn").write_text("\n\n".join(games))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = A.read_games(spark, str(tmp_path / "big.pgn"))
        assert df.rdd.getNumPartitions() > 3
        assert sorted(r["header_text"] for r in df.collect()) == sorted(g.split("\n\n")[0] for g in games)
        assert A.read_comments(spark, str(tmp_path / "big.pgn")).count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_archive_games(spark, archive_path):
    path = f"{archive_path}/a.pgn"
    games = {r["game_url"]: r for r in archive_games(spark, path, skip_unfinished=True).collect()}
    assert set(games) == {"s1", None, "s4"}
    assert games["s1"]["white_elo"] == 2100 and len(games["s1"]["plies"]) == 4
    assert games[None]["white_elo"] is None and games[None]["black_elo"] == 0 and games[None]["plies"] == []
    assert games["s4"]["variant"] == "Chess960"
    assert [r["game_url"] for r in archive_games(spark, path, only_standard=True, min_elo=2000, only_complete=True).collect()] == ["s1"]
    assert archive_games(spark, path, max_elo=2050).where("game_url = 's1'").count() == 0


def test_nested_games_and_back(spark, archive_path, tmp_path):
    docs = nested_games(archive_games(spark, f"{archive_path}/a.pgn"))
    sinks.write_json(docs, str(tmp_path / "out"))
    back = tables.read_json_auto(spark, str(tmp_path / "out"), tables.GAME_SCHEMA)
    one = next(r for r in back.collect() if r["game_metadata"]["game_url"] == "s1")["game_metadata"]
    assert [(p["move_number"], p["white_move"]["san"], p["black_move"]["san"]) for p in one["pgn"]] == [(1, "e4", "e5"), (2, "Qh5", "Nc6")]
    two = next(r for r in back.collect() if r["game_metadata"]["result"] == "*")["game_metadata"]["pgn"]
    assert two[0]["white_move"]["san"] == "d4" and two[0]["black_move"] is None
    # Without coordinates (they come from supplied facts) no ply is usable; with them all are.
    assert flat_plies(back).count() == 7
    fill = F.transform("game_metadata.pgn", lambda p: p.withField("white_move", F.when(p["white_move"].isNotNull(), p["white_move"].withField("uci", F.lit("x")))))
    usable = back.withColumn("game_metadata", F.col("game_metadata").withField("pgn", fill))
    assert [r["half_move"] for r in flat_plies(usable).where("side = 'w'").orderBy("game_id", "half_move").collect()].count(0) == 3


def test_json_array_or_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n\n  [{"task_id": "1", "input": "x"},\n {"task_id": "2"}]')
    (tmp_path / "b.jsonl").write_text('{"task_id": "1", "input": "x"}\n\n{"task_id": "2"}\nnot json\n{"task_id": ')
    schema = tables.TRAINING_ROW
    for name in ("a.json", "b.jsonl"):
        rows = tables.read_json_auto(spark, str(tmp_path / name), schema).collect()
        assert sorted(r["task_id"] for r in rows) == ["1", "2"]
    kept = tables.read_jsonl(spark, str(tmp_path / "*.jsonl"), schema, bad="keep")
    bad = kept.where("_corrupt_record IS NOT NULL").select("_corrupt_record").collect()
    assert sorted(r[0].strip() for r in bad) == sorted(["not json", '{"task_id":'])


def test_puzzles(spark, tmp_path):
    (tmp_path / "p.csv").write_text('FEN,Moves,Themes,Rating\nf1,e2e4 e7e5 g1f3,"a, b",1500\nf2,,x,1\nf3,a2a3,y,2\n')
    df = tables.read_puzzles(spark, str(tmp_path / "p.csv"))
    rows = tables.puzzle_rows(df.withColumn("before", F.lit("pos")), "before").orderBy("rating").collect()
    assert [(r["prompt"][-4:].strip(), r["completion"], r["theme"], r["rating"]) for r in rows] == [(": f3", " a2a3", "y", 2), ("pos", " g1f3", "a, b", 1500)]
    assert tables.puzzle_rows(df).count() == 1


def test_experiments(spark, tmp_path):
    for name, data in {"combine_v3_0.5_1": {"args": {"a": "b"}, "aggregated_metrics": {"m": 0.5}, "accuracy_counts_per_task": {"t": {"correct": 1, "total": 2}}},
                       "odd": {"aggregated_metrics": {"m": 1.0}}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(json.dumps(data, indent=1))
        (tmp_path / name / "summary.txt").write_text("Model: x\nKs: [1, 3]\nN: 12\nP1: n/a\n\n--- Aggregated Metrics ---\nm: 1\n")
    folders = spark.createDataFrame([("combine_v3_0.5_1",), ("odd",), ("empty",)], ["folder"])
    rows = {r["folder"]: r for r in tables.read_experiments(spark, str(tmp_path), folders).collect()}
    assert rows["combine_v3_0.5_1"]["aggregated_metrics"] == {"m": 0.5} and rows["combine_v3_0.5_1"]["accuracy_counts_per_task"]["t"]["total"] == 2
    assert rows["empty"]["aggregated_metrics"] is None and len(rows) == 3
    heads = tables.read_summary_headers(spark, str(tmp_path)).where("folder = 'odd'").collect()
    assert {r["name"]: (r["value"], r["number"]) for r in heads} == {"Model": ("x", None), "Ks": ("[1, 3]", None), "N": ("12", 12.0), "P1": (None, None)}
    assert next(r for r in heads if r["name"] == "Ks")["numbers"] == [1.0, 3.0]


def test_sinks(spark, tmp_path):
    df = spark.range(25).select(F.col("id").cast("string").alias("task_id"))
    sinks.write_parts(df.coalesce(1), str(tmp_path / "parts"), 10)
    parts = [f for f in os.listdir(tmp_path / "parts") if f.startswith("part-")]
    assert len(parts) == 3
    sinks.write_parts(df.coalesce(1), str(tmp_path / "parts"), 100)
    assert tables.read_jsonl(spark, str(tmp_path / "parts"), "task_id STRING").count() == 50
    sinks.write_text(df, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 25
    sinks.write_splits(df.withColumn("split", F.lit("val")), str(tmp_path / "splits"))
    assert os.path.isdir(tmp_path / "splits" / "split=val")


def test_materialize_computes_once(spark, tmp_path):
    calls = []
    path = sinks.dataset_path(str(tmp_path), "org/model", 16, "train", 5)
    assert path.endswith("org_model_seq16_train_top5")

    def compute():
        calls.append(1)
        return spark.range(3)

    for overwrite in (False, False, True):
        assert sinks.materialize(spark, compute, path, overwrite).count() == 3
    assert len(calls) == 2


def test_results_can_be_read_as_an_experiment(spark, tmp_path):
    metrics = spark.createDataFrame([("b_metric", 0.25), ("a_metric", None)], "metric string, value double")
    samples = spark.createDataFrame([("1", "x")], ["task_id", "answer"])
    counts = spark.createDataFrame([("t", 1, 2), ("u", 0, 0)], ["task", "correct", "total"])
    sinks.write_results(spark, metrics, samples, {"Model": "m"}, str(tmp_path / "combine_v1_0_1"), counts)
    row = tables.read_experiments(spark, str(tmp_path)).first()
    assert row["folder"] == "combine_v1_0_1" and row["aggregated_metrics"] == {"a_metric": None, "b_metric": 0.25} and row["args"] == {"Model": "m"}
    lines = [r[0] for r in spark.read.text(str(tmp_path / "combine_v1_0_1" / "summary.txt")).collect()]
    assert lines == ["Model: m", "", "--- Aggregated Metrics ---", "a_metric: N/A", "b_metric: 0.25", "",
                     "--- Rule-Based Task Counts (Correct/Total) ---", "t_counts: 1/2"]
    assert [r["name"] for r in tables.read_summary_headers(spark, str(tmp_path)).collect()] == ["Model"]


def test_layouts_are_told_for_each_file(spark, tmp_path):
    schema = "a int, b string"
    (tmp_path / "x.json").write_text("\n".join(json.dumps({"a": i, "b": "l"}) for i in range(3)))
    (tmp_path / "y.json").write_text(json.dumps([{"a": i, "b": "p"} for i in range(3, 6)], indent=2))
    (tmp_path / "z.json").write_text("\ufeff\n\n [\n" + json.dumps({"a": 6, "b": "q"}) + "]")
    (tmp_path / "bad.json").write_text('{"a": 7, "b": "r"}\n{"a": oops\n\n')
    (tmp_path / "broken.json").write_text('[{"a": 8, "b": ')
    (tmp_path / "empty.json").write_text("\n  \n")
    tmp_path = tmp_path.rename(tmp_path.with_name("a folder+%41"))
    rows = tables.read_json_auto(spark, str(tmp_path), schema).collect()
    assert sorted(r["a"] for r in rows if r["a"] is not None) == [0, 1, 2, 3, 4, 5, 6, 7] and len(rows) == 8
    kept = tables.read_json_auto(spark, str(tmp_path), schema, bad="keep").collect()
    assert len(kept) == 10 and sorted(r["_corrupt_record"] for r in kept if r["_corrupt_record"]) == ['[{"a": 8, "b": ', '{"a": oops']


def test_line_ends_are_told_for_each_file(spark, tmp_path):
    """A large file is cut whichever line end it has."""
    games = "\n".join(f'[Event "{i}"]\n[Site "s"]\n\n1. e4 e5 1-0\n' for i in range(400))
    (tmp_path / "lf.pgn").write_bytes(games.encode())
    (tmp_path / "crlf.pgn").write_bytes(games.replace("\n", "\r\n").encode())
    pieces = A._pieces(spark, str(tmp_path), None).groupBy("file").count().collect()
    assert [r["count"] for r in pieces] == [400, 400]
    rows = A.read_games(spark, str(tmp_path)).groupBy("header_text", "movetext").count().collect()
    assert len(rows) == 400 and {r["count"] for r in rows} == {2}

import json
import os
import time

from pyspark.sql import functions as F

from plyforge.streaming import merge as L


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def row(i, raw="Explanation: fine. ", **more):
    return {"task_id": f"g_{i}_w_P2.{i % 2}_T", "input": f"in{i}", "teacher_raw_output": raw, "teacher_task_instruction": "Explain.", **more}


def test_merge_writes_each_id_once_over_all_runs(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    write(src / "a.json", [row(1), row(2), row(2), row(3, "GENERATION_ERROR"), row(4, "  ")])

    def run(files_per_batch=None):
        L.merge_stream(spark, str(src), out, state, files_per_batch).awaitTermination()
        return sorted(r["task_id"] for r in spark.read.parquet(out).collect())

    assert run() == [row(1)["task_id"], row(2)["task_id"]]
    write(src / "b.json", [row(2, "again"), row(5)])
    write(src / "c.json", [row(5), row(3, "now fine"), {"input": "no id"}])
    want = sorted(row(i)["task_id"] for i in (1, 2, 3, 5))
    assert run(files_per_batch=1) == want
    assert run() == want
    # The merged rows are those of one batch run over the same files.
    batch = L.clean_answers(spark.read.schema(L.ANSWER_SCHEMA).json(str(src))).dropDuplicates(["task_id"])
    assert sorted(r["task_id"] for r in batch.collect()) == want
    assert spark.read.parquet(out).where("task_id like 'g_1_%'").first()["output"] == "fine."


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    write(src / "a.json", [row(i) for i in range(5)])
    # A lost checkpoint makes the whole input arrive again.
    for state in ("s1", "s2"):
        L.merge_stream(spark, str(src), out, str(tmp_path / state)).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_bounded_merge(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    write(src / "a.json", [row(1), row(1), row(2)])
    write(src / "b.json", [row(2), row(3)])
    L.merge_stream_bounded(spark, str(src), out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r["task_id"] for r in spark.read.parquet(out).collect()) == [row(i)["task_id"] for i in (1, 2, 3)]


def test_running_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "a.json", [row(1), row(2), row(4)])
    counts = L.stream_counts(L.read_answer_stream(spark, str(src)))
    q = counts.writeStream.outputMode("update").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["subtype"]: r["n"] for r in spark.table("counts").collect()} == {"P2.0_T": 2, "P2.1_T": 1}
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 3


def test_old_files_that_come_late_are_merged(spark, tmp_path):
    """Copies that keep their times arrive after the first run."""
    for merge in (L.merge_stream, L.merge_stream_bounded):
        base = tmp_path / merge.__name__
        src, out, state = base / "in", str(base / "out"), str(base / "state")
        src.mkdir(parents=True)
        write(src / "a.json", [row(1)])
        merge(spark, str(src), out, state).awaitTermination()
        for n, days in ((2, 2), (3, 10), (4, 400)):
            write(src / f"{n}.json", [row(n)])
            past = time.time() - days * 86_400
            os.utime(src / f"{n}.json", (past, past))
        merge(spark, str(src), out, state).awaitTermination()
        got = sorted(r["task_id"] for r in spark.read.parquet(out).collect())
        assert got == sorted(row(n)["task_id"] for n in (1, 2, 3, 4)), merge.__name__


def test_the_first_repeat_survives(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    write(src / "b.json", [row(1, "from b")])
    write(src / "a.json", [row(1, "second"), row(1, "first")])
    L.merge_stream(spark, str(src), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).first()["output"] == "first."


def test_a_new_checkpoint_in_an_old_place_loses_nothing(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    src.mkdir()
    write(src / "a.json", [row(1), row(2)])
    L.merge_stream(spark, str(src), out, str(state)).awaitTermination()
    state.rename(tmp_path / "lost")
    write(src / "b.json", [row(2, "late"), row(3)])
    L.merge_stream(spark, str(src), out, str(state)).awaitTermination()
    got = {r["task_id"]: r["output"] for r in spark.read.parquet(out).collect()}
    assert got == {row(1)["task_id"]: "fine.", row(2)["task_id"]: "fine.", row(3)["task_id"]: "fine."}
    assert spark.read.parquet(out).count() == 3


def test_a_batch_that_failed_is_written_once(spark, tmp_path, monkeypatch):
    """The write of the second batch breaks off after its files are there."""
    from pyspark.errors import StreamingQueryException
    from pyspark.sql.readwriter import DataFrameWriter

    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    for n in range(3):
        write(src / f"{n}.json", [row(10 * n + i) for i in range(4)] + [row(0, "again")])
    real, calls = DataFrameWriter.parquet, []

    def broken(self, path, *a, **k):
        real(self, path, *a, **k)
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    query = L.merge_stream(spark, str(src), out, state, files_per_batch=1)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        pass
    assert len(calls) == 2
    L.merge_stream(spark, str(src), out, state, files_per_batch=1).awaitTermination()
    got = sorted(r["task_id"] for r in spark.read.parquet(out).collect())
    assert got == sorted(row(10 * n + i)["task_id"] for n in range(3) for i in range(4))


def test_files_read_do_not_grow_with_the_sink(spark, tmp_path, monkeypatch):
    """Once the checkpoint is there, no run lists or reads the sink."""
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    write(src / "a.json", [row(1)])
    L.merge_stream(spark, str(src), out, state).awaitTermination()
    looked = []
    monkeypatch.setattr(L, "_exists", lambda s, path: looked.append(path) or path.startswith(state))
    write(src / "b.json", [row(1), row(2)])
    L.merge_stream(spark, str(src), out, state).awaitTermination()
    assert all(path.startswith(state) for path in looked) and spark.read.parquet(out).count() == 2

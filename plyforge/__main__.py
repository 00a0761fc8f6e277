"""Jobs from the command line: ``spark-submit -m`` or ``python -m plyforge <job> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.core import alnum_tokens, move_key
from plyforge.operators import games as G
from plyforge.operators import ordering as O
from plyforge.operators import shaping as S
from plyforge.operators.matching import pending, probe_cache
from plyforge.plans import answers, archive, evaluate, tasks
from plyforge.session import build_session
from plyforge.sources import archive as sources
from plyforge.sources import parts, sinks, tables
from plyforge.streaming.merge import merge_stream

POSITIONS = (
    "game_id STRING, half_move INT, uci STRING, fen_before STRING, legal_moves ARRAY<STRING>, "
    "attacked STRUCT<white ARRAY<STRING>, black ARRAY<STRING>>"
)
SAMPLES = (
    "sample_id BIGINT, data_source STRING, task STRING, task_id STRING, input STRING, raw STRING, reference STRING"
)


def _games(spark: SparkSession, path: str) -> DataFrame:
    return archive.with_game_key(tables.read_json_auto(spark, path, tables.GAME_SCHEMA))


def parse_archive(spark, a) -> None:
    """Games, and next to them (``<output>-counters``) how many were found, kept and dropped."""
    switches = {k: getattr(a, k) for k in ("on_bad", "skip_unfinished", "only_standard", "only_complete", "min_elo", "max_elo")}
    sinks.write_json(archive.nested_games(archive.archive_games(spark, a.inputs, **switches)), a.output)
    sinks.write_json(archive.archive_counters(spark, a.inputs, **switches), f"{a.output}-counters")


def extract_comments(spark, a) -> None:
    sinks.write_text(sources.read_comments(spark, a.inputs), a.output, "comment")


def split(spark, a) -> None:
    sinks.write_splits(O.split_exact(_games(spark, a.inputs), "game_id", seed=a.seed).drop("game_id"), a.output)


def requests(spark, a) -> None:
    sinks.write_json(archive.position_requests(_games(spark, a.inputs)), a.output)


def _plies(spark, a, style: str) -> DataFrame:
    """Plies with the supplied facts. One without facts stays; each rule looks at what it needs."""
    plies = archive.flat_plies(_games(spark, a.inputs), n=a.history_len, style=style)
    facts = tables.read_jsonl(spark, a.positions, POSITIONS)
    return G.attach_moves(plies, facts, ["game_id", "half_move"])


def fill_scores(spark, a) -> None:
    """Plies with scores filled in and checked, their counters (``<output>-counters``) and the scores to
    add to the score table (``<output>-new``). A score belongs to a position, move number and side."""
    plies = _plies(spark, a, "plain").withColumn("key", move_key(F.col("fen_before"), F.col("move_number"), F.col("side")))
    plies = plies.withColumn("old", F.col("eval_cp"))
    schema = "key STRING, value DOUBLE"
    scores = spark.read.schema(schema).json(a.scores)
    computed = spark.read.schema(schema).json(a.computed) if a.computed else None
    filled = G.fill_scores(plies, scores, "key", a.overwrite, a.threshold, computed)
    counters = G.score_counters(filled.withColumn("file", F.lit(a.inputs)), "file", F.col("old").isNotNull())
    sinks.write_json(filled.drop("old"), a.output)
    sinks.write_json(counters, f"{a.output}-counters")
    if computed is not None:
        sinks.write_json(G.new_scores(scores, computed, "key"), f"{a.output}-new")


def p1_tasks(spark, a) -> None:
    sinks.write_json(tasks.p1_tasks(_plies(spark, a, "plain"), ["game_id", "half_move"], a.seed, facts=True), a.output)


def p2_prompts(spark, a) -> None:
    sinks.write_json(tasks.p2_prompts(_plies(spark, a, "ellipsis"), ["game_id", "half_move"], a.seed), a.output)


def merge_answers(spark, a) -> None:
    merge_stream(spark, a.inputs, a.output, a.state).awaitTermination()


def conform(spark, a) -> None:
    rows = tables.read_jsonl(spark, a.inputs, tables.TRAINING_ROW)
    required = ["task_id", "input", "teacher_raw_output", "output"]
    sinks.write_json(S.conform_schema(rows, required, {"teacher_raw_output": "output"}).drop("corrected"), a.output)


def encode(spark, a) -> None:
    rows = tables.read_jsonl(spark, a.inputs, tables.TRAINING_ROW)
    keyed = rows.withColumn("id", F.coalesce("task_id", F.sha2(F.concat_ws("|", "input", "output"), 256)))

    def compute() -> DataFrame:
        text = F.concat_ws(" ", "input", "output")
        store = f"{a.output}/vocab_{a.vocab_size}"
        vocab = sinks.materialize(spark, lambda: S.build_vocab(rows, alnum_tokens(text), a.vocab_size), store, a.overwrite, [rows], size=a.vocab_size)
        prompt, answer = alnum_tokens(F.col("input")), alnum_tokens(F.coalesce("output", F.lit("")))
        return S.encode(keyed, "id", prompt, answer, vocab, a.max_len)

    path = sinks.dataset_path(a.output, a.model, a.max_len, a.split)
    sinks.materialize(spark, compute, path, a.overwrite, [rows], max_len=a.max_len, vocab_size=a.vocab_size)


def prompt_range(spark, a) -> None:
    """Rows ``start`` to ``start + num`` of the prompts that have no answer yet, as one committed batch of part
    files. Started again, a range that was committed is left alone."""
    schema = "task_id STRING, student_prompt_input STRING, teacher_prompt_full STRING, teacher_task_instruction STRING"
    rows = tables.read_jsonl(spark, a.inputs, schema)
    if a.done:
        rows = pending(rows, spark.read.schema("task_id STRING").parquet(a.done))
    parts.append_range(rows, "task_id", a.output, a.start, a.num, a.part_rows)


def samples(spark, a) -> None:
    """Samples to evaluate and, with a cache, those that are answered (``hits``) and the prompts to ask (``misses``)."""
    rows = answers.evaluation_samples(spark, SAMPLES, a.inputs, a.p2, a.max_p1, a.max_p2, a.seed)
    sinks.write_json(rows, f"{a.output}/samples")
    if a.cache:
        hits, misses = probe_cache(tables.read_jsonl(spark, f"{a.output}/samples", SAMPLES), parts.read_cache(spark, a.cache))
        sinks.write_json(hits, f"{a.output}/hits")
        sinks.write_json(misses, f"{a.output}/misses")


def extend_cache(spark, a) -> None:
    """Add the answers (input, response) of a run to a cache."""
    parts.extend_cache(tables.read_jsonl(spark, a.inputs, "input STRING, response STRING"), a.output, a.batch)


def verdicts(spark, a) -> None:
    sinks.write_json(answers.verdict_report(tables.read_jsonl(spark, a.inputs, answers.VERDICT_ROWS)), a.output)


def generation_stats(spark, a) -> None:
    """Answers with what was read from them (``<output>-moves``) and their statistics."""
    read = lambda path, schema: tables.read_jsonl(spark, path, schema)
    moves = answers.generated_moves(read(a.inputs, answers.MOVE_ROWS), read(a.legal, answers.LEGAL_ROWS), read(a.scores, answers.SCORED_ROWS), a.k)
    sinks.write_json(moves, f"{a.output}-moves")
    sinks.write_json(answers.generation_report(moves), a.output)


def puzzles(spark, a) -> None:
    supplied = lambda path, schema: tables.read_jsonl(spark, path, schema) if path else None
    positions = supplied(a.positions, "FEN STRING, Moves STRING, fen_before STRING")
    best = supplied(a.best, "fen STRING, move STRING")
    sinks.write_csv(answers.puzzle_samples(tables.read_puzzles(spark, a.inputs), a.num, a.seed, positions, best), a.output)


def score(spark, a) -> None:
    samples = tables.read_jsonl(spark, a.inputs, SAMPLES)
    engine = spark.read.schema("pos_id STRING, rank INT, move STRING, score BIGINT").json(a.engine) if a.engine else None
    after = spark.read.schema("pos_id STRING, move STRING, score BIGINT").json(a.move_scores) if a.move_scores else None
    names = spark.read.schema("pos_id STRING, answer STRING, uci STRING").json(a.aliases) if a.aliases else None
    metrics, counts, scored = evaluate.evaluate(samples, engine, after, names, a.ks, a.ks)
    args = {"Samples": a.inputs, "SF Reference Ks for SSD/Delta": a.ks}
    sinks.write_results(spark, metrics, scored, args, a.output, counts)


def report(spark, a) -> None:
    """Models by metrics. Without ``--criteria`` a row is a folder; with it (rows of title, version, alpha
    and beta as JSON lines) a row is the first experiment whose folder name fits, or none."""
    from plyforge.constants import REPORT_COLUMNS
    from plyforge.plans.report import experiments_by_criteria, report_table

    config = S.metric_config(spark, REPORT_COLUMNS)
    found = tables.read_experiments(spark, a.inputs).where("aggregated_metrics IS NOT NULL")
    if a.criteria:
        wanted = spark.read.schema("title STRING, version STRING, alpha DOUBLE, beta DOUBLE").json(a.criteria)
        found = experiments_by_criteria(found, wanted)
    else:
        found = found.withColumnRenamed("folder", "model")
    long = S.map_to_long(found, ["model"], "aggregated_metrics")
    # One column per model is only needed where the table is transposed.
    models = [r[0] for r in found.select("model").distinct().orderBy("model").collect()] if a.transpose else []
    table = report_table(long, config, models, sorted({c[4] for c in REPORT_COLUMNS}), a.transpose)
    if a.criteria and not a.transpose:
        titles = [c for c in table.columns if c != "model"]
        missing = found.select("model").join(table, "model", "left_anti")
        table = table.unionByName(missing.select("model", *[F.lit("N/A").alias(t) for t in titles]))
    sinks.write_csv(table, a.output)
    sinks.write_json(tables.read_summary_headers(spark, a.inputs), f"{a.output}-headers")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plyforge", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(fn, many: bool = False):
        p = jobs.add_parser(fn.__name__.replace("_", "-"))
        p.set_defaults(run=fn)
        p.add_argument("-i", "--inputs", required=True, nargs="+" if many else None)
        p.add_argument("-o", "--output", required=True)
        return p

    p = job(parse_archive, many=True)
    p.add_argument("--on-bad", choices=["drop_game", "skip_move"], default="drop_game")
    for flag in ("--skip-unfinished", "--only-standard", "--only-complete"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--min-elo", type=int)
    p.add_argument("--max-elo", type=int)
    job(extract_comments, many=True)
    job(split).add_argument("--seed", type=int, default=42)
    job(requests)
    for fn in (p1_tasks, p2_prompts):
        p = job(fn)
        p.add_argument("--positions", required=True)
        p.add_argument("--history-len", type=int, default=10)
        p.add_argument("--seed", type=int, default=42)
    p = job(fill_scores)
    p.add_argument("--positions", required=True)
    p.add_argument("--scores", required=True)
    p.add_argument("--computed")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--threshold", type=float, default=50.0)
    p.set_defaults(history_len=10)
    job(merge_answers).add_argument("--state", required=True)
    job(conform)
    p = job(encode)
    p.add_argument("--model", default="plain")
    p.add_argument("--split", default="train")
    p.add_argument("--max-len", type=int, default=1024)
    p.add_argument("--vocab-size", type=int, default=32_000)
    p.add_argument("--overwrite", action="store_true")
    p = job(prompt_range)
    p.add_argument("--done")
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--num", type=int)
    p.add_argument("--part-rows", type=int, default=1000)
    p = job(samples)
    for name in ("--p2", "--cache"):
        p.add_argument(name)
    for name in ("--max-p1", "--max-p2"):
        p.add_argument(name, type=int)
    p.add_argument("--seed", type=int, default=42)
    job(extend_cache).add_argument("--batch", required=True)
    job(verdicts)
    p = job(generation_stats)
    p.add_argument("--legal", required=True)
    p.add_argument("--scores", required=True)
    p.add_argument("--k", type=int, default=5)
    p = job(puzzles)
    for name in ("--positions", "--best"):
        p.add_argument(name)
    p.add_argument("--num", type=int, default=1000)
    p.add_argument("--seed", type=int, default=42)
    p = job(score)
    for name in ("--engine", "--move-scores", "--aliases"):
        p.add_argument(name)
    p.add_argument("--ks", type=int, nargs="+", default=[1, 3])
    p = job(report)
    p.add_argument("--transpose", action="store_true")
    p.add_argument("--criteria")
    args = parser.parse_args(argv)
    args.run(spark or build_session(), args)


if __name__ == "__main__":
    main()

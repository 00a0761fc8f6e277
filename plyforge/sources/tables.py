"""JSON, CSV and experiment-folder readers with explicit schemas."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.sources import ranges

MOVE = "STRUCT<san STRING, uci STRING, outcome STRING, special_move STRING, quality STRING, eval_cp DOUBLE, clock STRING, comment STRING>"
GAME_SCHEMA = (
    "game_metadata STRUCT<fen STRING, result STRING, white_elo INT, black_elo INT, eco STRING, variant STRING, "
    f"game_url STRING, pgn ARRAY<STRUCT<move_number INT, white_move {MOVE}, black_move {MOVE}>>>, "
    "synthetic_data ARRAY<STRING>, distilled_data ARRAY<STRING>"
)
PUZZLE_SCHEMA = "FEN STRING, Moves STRING, Themes STRING, Rating INT"
TRAINING_ROW = "task_id STRING, input STRING, teacher_raw_output STRING, output STRING"
RESULT_SCHEMA = (
    "args MAP<STRING, STRING>, aggregated_metrics MAP<STRING, DOUBLE>, "
    "accuracy_counts_per_task MAP<STRING, STRUCT<correct: BIGINT, total: BIGINT>>"
)
CORRUPT = "_corrupt_record"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def _with_corrupt(schema: str | T.StructType) -> T.StructType:
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])


def _parsed(lines: DataFrame, schema: str | T.StructType, bad: str) -> DataFrame:
    """Rows of JSON texts (value), one each. Malformed ones stay in ``_corrupt_record`` or are dropped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # from_json over text keeps the corrupt column usable on its own, unlike the JSON source.
    rows = lines.select(F.from_json("value", _with_corrupt(schema), options).alias("r")).select("r.*")
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if bad == "drop" else rows


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, bad: str = "drop") -> DataFrame:
    """JSON lines from one path, many paths or a glob. ``bad='keep'`` leaves malformed lines in
    ``_corrupt_record``; ``bad='drop'`` skips them."""
    return _parsed(spark.read.text(path).where(F.trim("value") != ""), schema, bad)


def read_jsonl_in_order(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines that can be read, with ``_at``, which rises from file to file by name and from line to line."""
    at = F.struct(file_path().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", at.alias("_at")).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = lines.select("_at", F.from_json("value", _with_corrupt(schema), options).alias("r")).select("_at", "r.*")
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_json_auto(spark: SparkSession, path: str | list[str], schema: str | T.StructType, bad: str = "drop") -> DataFrame:
    """JSON arrays and JSON lines, told apart for each file by its first character that is not blank, for
    which only the file's first bytes are read.

    One large file is read by many tasks in either layout (`ranges.array_elements`). ``bad`` is as in
    `read_jsonl`, for lines and for the elements of arrays: a malformed one costs no other.
    """
    signs = ranges.first_signs(spark, spark.read.text(path).inputFiles())
    arrays = sorted(unquote(file) for file, sign in signs.items() if sign == "[")
    lines = sorted(unquote(file) for file, sign in signs.items() if sign not in ("", "["))
    texts = []
    if lines or not arrays:
        texts.append(spark.read.text(lines or path).where(F.trim("value") != "").select("value"))
    if arrays:
        texts.append(ranges.array_elements(spark, arrays))
    return _parsed(texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1]), schema, bad)


def read_puzzles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(PUZZLE_SCHEMA).option("header", True).option("escape", '"').csv(path)


def puzzle_rows(df: DataFrame, fen_before_last: str | None = None) -> DataFrame:
    """DataFrame[prompt, completion, theme, rating] asking for a puzzle's last move.

    ``fen_before_last`` names a supplied column with the position before that move; without it only
    one-move puzzles, whose start position is that position, are kept. Empty move lists drop out.
    """
    from plyforge.functions.core import split_last, words
    from plyforge.functions.prompts import engine_prompt

    cut = df.withColumn("_cut", split_last(words(F.col("Moves")))).where("_cut IS NOT NULL")
    single = F.size("_cut.prefix") == 0
    fen = F.when(single, F.col("FEN"))
    if fen_before_last:
        fen = fen.otherwise(F.col(fen_before_last))
    return cut.withColumn("_fen", fen).where("_fen IS NOT NULL").select(
        engine_prompt("puzzle", fen=F.col("_fen")).alias("prompt"),
        F.concat(F.lit(" "), "_cut.last").alias("completion"),
        F.col("Themes").alias("theme"),
        F.col("Rating").alias("rating"),
    )


def file_path() -> Column:
    """The path of a row's file as it is written, not with its signs escaped."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _folder(name: str) -> Column:
    """The folder that holds ``name``, which may be a file or a folder of parts."""
    return F.regexp_extract(file_path(), rf"([^/]+)/{name}(?:/|$)", 1)


def read_experiments(spark: SparkSession, base: str, folders: DataFrame | None = None) -> DataFrame:
    """One row per ``base/<folder>/result.json``. A ``folders`` DataFrame keeps folders without one."""
    rows = (
        spark.read.schema(RESULT_SCHEMA)
        .option("multiLine", True)
        .json(f"{base}/*/result.json")
        .select(_folder("result.json").alias("folder"), "args", "aggregated_metrics", "accuracy_counts_per_task")
    )
    return rows if folders is None else folders.select("folder").join(rows, "folder", "left")


def summary_header_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """DataFrame[key, name, value, number] of the ``name: value`` lines that open a summary.

    The header ends at the first blank line, or at a line of dashes after the first.
    ``n/a`` is NULL; ``number`` holds values that read as numbers.
    """
    lines = F.transform(F.split(F.col(text), "\n"), lambda line: F.trim(line))
    stops = F.transform(
        lines,
        lambda line, i: (line == "")
        | line.startswith("--- Aggregated Metrics ---")
        | (line.startswith("---") & (i > 0)),
    )
    stop = F.array_position(stops, F.lit(True)).cast("int")
    head = F.when(stop > 0, F.slice(lines, 1, stop - 1)).otherwise(lines)
    entry = df.select(key, F.explode(head).alias("line")).where(F.contains("line", F.lit(":")))
    value = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    return entry.select(
        key,
        F.trim(F.regexp_extract("line", r"^([^:]*):", 1)).alias("name"),
        F.when(F.lower(value) != "n/a", value).alias("value"),
        F.when(value.rlike(NUMBER), value.try_cast("double")).alias("number"),
        F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<double>")).alias("numbers"),
    )


def read_summary_headers(spark: SparkSession, base: str) -> DataFrame:
    """Header entries of every ``base/<folder>/summary.txt``; one small file is one row."""
    files = spark.read.text(f"{base}/*/summary.txt", wholetext=True)
    return summary_header_entries(files.select(_folder("summary.txt").alias("folder"), "value"), "folder", "value")

"""Unions, schema conformance, task rows, pivots and encoding."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.functions.core import format_fixed, hash01, is_close

# --- unions and schemas ------------------------------------------------------------------------------


def union_tagged(sources: dict[str, DataFrame], tag: str = "data_source") -> DataFrame:
    """Rows of differently shaped sources with the name of their source; missing columns are NULL."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` does not have, each once."""
    return a.select(key).distinct().join(b, key, "left_anti")


def route(df: DataFrame, source: str, tasks: list[str] | None = None) -> DataFrame:
    kept = df.where(F.col("data_source") == source)
    return kept.where(F.lower("task").isin([t.lower() for t in tasks])) if tasks else kept


def conform_schema(df: DataFrame, required: list[str], fallback: dict[str, str]) -> DataFrame:
    """All required columns first, filled from their fallback column when missing or NULL; other
    columns are kept. ``corrected`` marks rows in which a fallback was used."""
    have = set(df.columns)
    filled, used = {}, F.lit(False)
    for name in required:
        value = F.col(name) if name in have else F.lit(None).cast("string")
        other = fallback.get(name)
        if other in have:
            used = used | (value.isNull() & F.col(other).isNotNull())
            value = F.coalesce(value, F.col(other))
        filled[name] = value
    extra = [c for c in df.columns if c not in filled]
    return df.select(*[v.alias(n) for n, v in filled.items()], *extra, used.alias("corrected"))


# --- task rows -------------------------------------------------------------------------------------


@dataclass
class Rule:
    """One task: when it fires, at which rate, what it asks and what the answer is.

    ``suffix`` is added to the task's name.
    """

    name: str
    when: Column
    instruction: Column
    label: Column
    rate: float = 1.0
    suffix: Column | None = None
    extra: dict[str, Column] = field(default_factory=dict)


def generate_tasks(
    plies: DataFrame, rules: list[Rule], seed: int, keys: list[str], task_id: Column, prompt, keep: list[str] = ()
) -> DataFrame:
    """One row per ply and rule that fires: task_id, task, input, output and any ``extra`` columns.

    All rules are tried in one pass over the plies. ``prompt(instruction)`` builds the input.
    """
    extras = list(dict.fromkeys(n for r in rules for n in r.extra))
    entries = []
    for r in rules:
        fires = F.coalesce(r.when, F.lit(False))
        if r.rate < 1.0:
            fires = fires & (hash01(seed, r.name, *[F.col(k) for k in keys]) < r.rate)
        name = F.lit(r.name) if r.suffix is None else F.concat(F.lit(r.name), r.suffix)
        fields = [
            F.concat_ws("_", task_id, name).alias("task_id"),
            name.alias("task"),
            r.instruction.alias("instruction"),
            F.coalesce(r.label, F.lit("")).alias("output"),
            *[r.extra.get(n, F.lit(None).cast("string")).alias(n) for n in extras],
        ]
        entries.append(F.when(fires, F.struct(*fields)))
    fired = plies.withColumn("_t", F.explode(F.array_compact(F.array(*entries))))
    rows = fired.withColumn("input", prompt(F.col("_t.instruction")))
    return rows.select(*keep, "_t.task_id", "_t.task", "input", "_t.output", *[f"_t.{n}" for n in extras])


# --- reports ---------------------------------------------------------------------------------------


def to_long(df: DataFrame, id_cols: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Metric columns as rows."""
    cols = [c for c in df.columns if c not in id_cols]
    return df.unpivot(id_cols, cols, name, value)


def map_to_long(df: DataFrame, id_cols: list[str], metrics: str) -> DataFrame:
    return df.select(*id_cols, F.explode(metrics).alias("metric", "value"))


def list_metrics(df: DataFrame) -> DataFrame:
    return df.orderBy("metric")


def metric_config(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Small table (group, metric, title, higher_is_better, spec, pos) describing report columns."""
    schema = "group string, metric string, title string, higher_is_better boolean, spec string, pos int"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def with_display(metrics: DataFrame, config: DataFrame, on: str = "metric") -> DataFrame:
    """Metrics with the group, title, direction, format and place that the settings give them; a metric
    without settings is left out."""
    return metrics.join(config, on)


def mark_best(df: DataFrame, metric: str, value: str, higher: Column) -> DataFrame:
    """Add ``is_best``: the value is nearly equal to its metric's best. Missing values never are."""
    v = F.col(value)
    known = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ends = known.groupBy(metric).agg(F.max(value).alias("_max"), F.min(value).alias("_min"))
    best = F.when(higher, F.col("_max")).otherwise(F.col("_min"))
    joined = df.join(ends, metric, "left")
    return joined.withColumn("is_best", F.coalesce(is_close(v, best), F.lit(False))).drop("_max", "_min")


def comparison_table(
    metrics: DataFrame, rows: str, columns: str, cell: str, values: list[str], missing: str = "N/A"
) -> DataFrame:
    """One row per ``rows`` value and one text column per listed ``columns`` value. Swapping the two
    names transposes the table."""
    table = metrics.groupBy(rows).pivot(columns, values).agg(F.max(cell))
    # Titles and folder names may hold dots, so they are quoted.
    return table.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(missing)).alias(v) for v in values])


def format_by_spec(value: Column, spec: Column, specs: list[str], default: str = "N/A") -> Column:
    """Format each value with the spec named in its row."""
    shown = F.lit(None).cast("string")
    for s in specs:
        shown = F.when((spec == s) & value.isNotNull(), format_fixed(value, s)).otherwise(shown)
    return F.coalesce(shown, F.lit(default))


# --- encoding --------------------------------------------------------------------------------------

SPECIAL = {"<pad>": 0, "<unk>": 1, "<eos>": 2}


def build_vocab(df: DataFrame, tokens: Column, size: int) -> DataFrame:
    """DataFrame[token, n, id]: the ``size`` most frequent tokens, ties by name, ids after the
    special ones. The limit comes first, so numbering touches at most ``size`` rows."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.withColumn("id", (rank - 1 + len(SPECIAL)).cast("int"))


def _ids(df: DataFrame, vocab: DataFrame, parts: list[str]) -> DataFrame:
    """Token lists of ``parts`` as lists of ids. Equal rows are looked up once: they are told apart by a
    hash of all their tokens, both parts are exploded together, joined with the vocabulary (sent to all
    tasks where Spark finds it small enough) and put together again."""
    key = F.sha2(F.to_json(F.struct(*parts)), 256)
    keyed = df.withColumn("_key", key)

    def marked(n: int, part: str) -> Column:
        return F.transform(part, lambda t, i: F.struct(F.lit(n).alias("part"), i.alias("pos"), t.alias("token")))

    every = F.concat(*[marked(n, p) for n, p in enumerate(parts)])
    once = keyed.dropDuplicates(["_key"]).select("_key", F.explode(every).alias("_e")).select("_key", "_e.*")
    found = once.join(vocab.select("token", F.col("id").alias("_tid")), "token", "left")
    entry = F.struct("part", "pos", F.coalesce(F.col("_tid"), F.lit(SPECIAL["<unk>"])).alias("t"))
    lists = found.groupBy("_key").agg(F.sort_array(F.collect_list(entry)).alias("_l"))
    none = F.array().cast("array<int>")

    def ids(n: int) -> Column:
        mine = F.filter("_l", lambda e: e["part"] == n)
        return F.coalesce(F.transform(mine, lambda e: e["t"].cast("int")), none)

    return keyed.join(lists, "_key", "left").withColumns({p: ids(n) for n, p in enumerate(parts)}).drop("_key", "_l")


def encode(
    df: DataFrame, id: str, prompt: Column, output: Column, vocab: DataFrame, max_len: int,
    mask_pads: bool = True, reserve_eos: bool = False,
) -> DataFrame:
    """DataFrame[id, input_ids, attention_mask, labels] of prompt + output + end mark.

    The end mark is added before the cut to ``max_len``, so a long row loses it unless
    ``reserve_eos`` is set. Labels ignore the prompt, and the padding when ``mask_pads``. The id need not
    be unique.
    """
    from plyforge.functions.metrics import mask_labels

    # Only the first max_len tokens of either part can reach the result.
    cut = df.select(id, F.slice(prompt, 1, max_len).alias("_p"), F.slice(output, 1, max_len).alias("_o"))
    ids = _ids(cut, vocab, ["_p", "_o"])
    eos = F.array(F.lit(SPECIAL["<eos>"]))
    body = F.concat("_p", "_o")
    full = F.concat(F.slice(body, 1, max_len - 1), eos) if reserve_eos else F.slice(F.concat(body, eos), 1, max_len)
    filled = ids.withColumn("_f", full)
    pad = F.lit(max_len) - F.size("_f")
    padded = filled.withColumns({
        "input_ids": F.concat("_f", F.array_repeat(F.lit(SPECIAL["<pad>"]), pad)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("_f")), F.array_repeat(F.lit(0), pad)),
    })
    attention = F.col("attention_mask") if mask_pads else None
    labels = mask_labels(F.col("input_ids"), F.least(F.size("_p"), F.lit(max_len)), attention)
    return padded.select(id, "input_ids", "attention_mask", labels.alias("labels"))


def explode_board(df: DataFrame, fen: str = "fen") -> DataFrame:
    """64 rows per position: square, piece and color, the last two NULL on an empty square."""
    from plyforge.functions.notation import board_squares

    return df.select("*", F.inline(board_squares(F.col(fen))))

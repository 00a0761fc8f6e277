"""Comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.operators import shaping as S
from plyforge.plans.report import report_table
from plyforge.queries.joins import EVENTS_K
from plyforge.queries.registry import query, table
from plyforge.queries.standins import k_of

_SPECS = ["%.3f", "%.1f"]
# (group, metric, title, higher is better, format) of the columns shown.
_COLUMNS = [
    ("Score", "avg_value", "Mean", True, "%.3f"),
    ("Score", "max_value", "Max", False, "%.1f"),
    ("Count", "mean_k", "K", True, "%.1f"),
]
_MODELS = ["click", "error", "purchase", "signup", "view"]

SQL_METRICS = f"""
m AS (SELECT event_type AS model, avg(value) AS avg_value, max(value) AS max_value, avg(k) AS mean_k FROM {EVENTS_K} GROUP BY event_type),
long AS (SELECT model, 'avg_value' AS metric, CASE WHEN model <> 'view' THEN avg_value END AS value, true AS up, '%.3f' AS spec, 'Mean' AS title FROM m
  UNION ALL SELECT model, 'max_value', max_value, false, '%.1f', 'Max' FROM m UNION ALL SELECT model, 'mean_k', CAST(mean_k AS DOUBLE), true, '%.1f', 'K' FROM m),
best AS (SELECT *, CASE WHEN up THEN max(value) OVER (PARTITION BY metric) ELSE min(value) OVER (PARTITION BY metric) END AS b FROM long),
cells AS (SELECT model, metric, title, coalesce(abs(value - b) <= 1e-8 + 1e-5 * abs(b), false) AS is_best,
  CASE WHEN value IS NULL THEN 'N/A' WHEN spec = '%.3f' THEN printf('%.3f', value) ELSE printf('%.1f', value) END
  || CASE WHEN coalesce(abs(value - b) <= 1e-8 + 1e-5 * abs(b), false) THEN '*' ELSE '' END AS cell FROM best)"""


def _metrics(spark, sf_dir):
    """Long (model, metric, value) with one value missing."""
    ev = table(spark, sf_dir, "events").withColumn("k", k_of())
    wide = ev.groupBy(F.col("event_type").alias("model")).agg(
        F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.avg("k").alias("mean_k"))
    missing = F.when(F.col("model") != "view", F.col("avg_value"))
    return S.to_long(wide.withColumn("avg_value", missing), ["model"])


@query(f"""WITH {SQL_METRICS} SELECT model, metric, is_best FROM cells ORDER BY metric""")
def best_marks(spark, sf_dir):
    rows = _metrics(spark, sf_dir)
    marked = S.mark_best(rows, "metric", "value", F.col("metric") != "max_value")
    return S.list_metrics(marked).select("model", "metric", "is_best")


@query(f"""
WITH {SQL_METRICS} SELECT model, max(cell) FILTER (title = 'Mean') AS "Mean", max(cell) FILTER (title = 'Max') AS "Max", max(cell) FILTER (title = 'K') AS "K" FROM cells GROUP BY model
""")
def comparison_table(spark, sf_dir):
    """One row per model, one formatted column per metric, the best marked."""
    return report_table(_metrics(spark, sf_dir), S.metric_config(spark, _COLUMNS), _MODELS, _SPECS)


@query(f"""
WITH {SQL_METRICS} SELECT title, {', '.join(f"max(cell) FILTER (model = '{m}') AS {m}" for m in _MODELS)} FROM cells GROUP BY title
""")
def transposed_table(spark, sf_dir):
    return report_table(_metrics(spark, sf_dir), S.metric_config(spark, _COLUMNS), _MODELS, _SPECS, transpose=True)


@query("""
SELECT p_brand AS "group", p_partkey AS pos, p_name AS title, p_type AS metric, p_size >= 25 AS higher_is_better, l_orderkey, l_linenumber
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'
""")
def display_config(spark, sf_dir):
    """Returned lines as metrics joined with the display settings of their part."""
    config = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("group"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"),
        F.col("p_type").alias("metric"), (F.col("p_size") >= 25).alias("higher_is_better"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("pos"), "l_orderkey", "l_linenumber")
    return S.with_display(lines, config, "pos")


@query("""
SELECT l_orderkey, l_linenumber, metric, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
UNPIVOT (value FOR metric IN (l_quantity, l_discount, l_tax))
""")
def long_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return S.to_long(lines, ["l_orderkey", "l_linenumber"])


@query("""
SELECT p_partkey, metric, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR metric IN (size, price))
""")
def map_metrics(spark, sf_dir):
    """A map of metrics as rows."""
    maps = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"))
    return S.map_to_long(table(spark, sf_dir, "part").select("p_partkey", maps.alias("m")), ["p_partkey"], "m")




@query("""
SELECT p_partkey, name, value, number, last FROM (
  SELECT p_partkey, 'Eval Summary - Model' AS name, p_name AS value, NULL AS number, NULL AS last FROM part
  UNION ALL SELECT p_partkey, 'Samples', CAST(p_size AS VARCHAR), CAST(p_size AS DOUBLE), NULL FROM part
  UNION ALL SELECT p_partkey, 'Adapter', NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 'Price', CAST(p_retailprice AS VARCHAR), p_retailprice, NULL FROM part
  UNION ALL SELECT p_partkey, 'SF Ks', '[1, ' || p_size || ']', NULL, CAST(p_size AS DOUBLE) FROM part)
""")
def summary_headers(spark, sf_dir):
    """Header entries of a summary text per part, up to the first line of dashes."""
    from plyforge.sources.tables import summary_header_entries

    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    text = F.concat(
        F.lit("Eval Summary - Model: "), "p_name", F.lit("\nSamples: "), size, F.lit("\nAdapter: n/a\nPrice: "), price,
        F.lit("\nSF Ks: [1, "), size, F.lit("]\n--- Aggregated Metrics ---\nacc: 1.0"))
    rows = summary_header_entries(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")
    return rows.select("p_partkey", "name", "value", "number", F.try_element_at("numbers", F.lit(-1)).alias("last"))

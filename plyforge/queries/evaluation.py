"""Scores of answers against references and engine facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.functions import metrics as M
from plyforge.functions.core import alnum_tokens, array_mean, format_metric, round_mean, round_ratio, words
from plyforge.operators import matching as J
from plyforge.operators import metrics as A
from plyforge.plans import report as R
from plyforge.queries.answers import sql_end_mark, sql_one_line, sql_sentences, sql_strip
from plyforge.queries.joins import EVENTS_K, WORDS
from plyforge.queries.registry import documents, events, query, table
from plyforge.queries.standins import SQL_PAIRS, k_of, turn_pairs

ALNUM = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


def sql_grams(tokens: str, n: int) -> str:
    if n == 1:
        return tokens
    return f"list_transform(range(1, greatest(len({tokens}) - {n} + 2, 1)), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


def sql_overlap(source: str, n: int) -> str:
    """CTEs that give (conv_id, turn, hits, np, nr) of n-grams of the token lists p and r."""
    return f"""
g{n} AS (SELECT conv_id, turn, {sql_grams('p', n)} AS p, {sql_grams('r', n)} AS r FROM {source}),
c{n} AS (SELECT conv_id, turn, gram, sum(a) AS a, sum(b) AS b FROM (
    SELECT conv_id, turn, unnest(p) AS gram, 1 AS a, 0 AS b FROM g{n} UNION ALL SELECT conv_id, turn, unnest(r), 0, 1 FROM g{n}) GROUP BY ALL),
o{n} AS (SELECT conv_id, turn, CAST(sum(least(a, b)) AS BIGINT) AS hits FROM c{n} GROUP BY ALL),
s{n} AS (SELECT conv_id, turn, len(p) AS np, len(r) AS nr, coalesce(hits, 0) AS hits FROM g{n} LEFT JOIN o{n} USING (conv_id, turn))"""


def _ascii(c):
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


# The assistant's turn is cleaned as an explanation; both sides are brought to ASCII, because the
# two engines measure edit distance in different units otherwise.
SQL_CLEAN_PAIRS = f"""
{SQL_PAIRS}, pa AS (SELECT conv_id, turn, {sql_strip('pred')} AS t, ref FROM pairs),
pb AS (SELECT conv_id, turn, ref, {sql_end_mark(sql_sentences('t'))} AS marked FROM pa),
clean AS (SELECT conv_id, turn, regexp_replace({sql_one_line('marked')}, '[^\\x00-\\x7F]', '?', 'g') AS pred,
                 regexp_replace(ref, '[^\\x00-\\x7F]', '?', 'g') AS ref FROM pb)"""


def _clean_pairs(spark, sf_dir):
    from plyforge.functions.responses import clean_explanation

    pairs = turn_pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("subtype"),
                        _ascii(clean_explanation(F.col("pred"))).alias("pred"), _ascii(F.col("ref")).alias("ref"))


@query(f"""
WITH {SQL_CLEAN_PAIRS}, tok AS (SELECT conv_id, turn, {ALNUM.format('pred')} AS p, {ALNUM.format('ref')} AS r FROM clean),
{sql_overlap('tok', 1)}, {sql_overlap('tok', 2)},
ws AS (SELECT conv_id, turn, list_distinct({WORDS.format('pred')}) AS p, list_distinct({WORDS.format('ref')}) AS r FROM clean),
f AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN len(list_intersect(p, r)) = 0 THEN 0.0
        ELSE 2.0 * len(list_intersect(p, r)) / (len(p) + len(r)) END AS set_f1 FROM ws),
x AS (SELECT 'turn ' || turn AS subtype, set_f1, CASE WHEN s1.hits > 0 THEN 2.0 * s1.hits / (s1.np + s1.nr) ELSE 0.0 END AS r1,
        CASE WHEN s2.hits > 0 THEN 2.0 * s2.hits / (s2.np + s2.nr) ELSE 0.0 END AS r2,
        CASE WHEN greatest(length(pred), length(ref)) > 0 THEN levenshtein(pred, ref) / greatest(length(pred), length(ref)) ELSE 0.0 END AS d
      FROM clean JOIN f USING (conv_id, turn) JOIN s1 USING (conv_id, turn) JOIN s2 USING (conv_id, turn))
SELECT subtype, count(*) AS n, round_even(avg(set_f1), 4) AS set_f1, round_even(avg(r1), 4) AS rouge_1, round_even(avg(r2), 4) AS rouge_2,
       round_even(avg(d), 4) AS edit_distance
FROM x GROUP BY ROLLUP (subtype)
""")
def explanation_report(spark, sf_dir):
    """Flagship: cleaned answers against references, per subtype and overall."""
    return R.text_report(_clean_pairs(spark, sf_dir), "subtype", "pred", "ref", lcs=False).withColumn("n", F.col("n").cast("long")).drop("overall")


# One row of the subsequence table per token of the reply. A cell is the largest of the cell above and,
# where the tokens are equal, one more than the cell above to the left, of all cells up to it.
SQL_LCS = f"""
WITH RECURSIVE {SQL_CLEAN_PAIRS}, tok AS (SELECT conv_id, turn, {ALNUM.format('pred')} AS p, {ALNUM.format('ref')} AS r FROM clean),
step AS (
  SELECT conv_id, turn, p, r, 0 AS i, list_transform(r, lambda x: 0) AS cells FROM tok
  UNION ALL
  SELECT conv_id, turn, p, r, i + 1,
    list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1),
      lambda k: greatest(cells[k], CASE WHEN r[k] = p[i + 1] THEN coalesce(cells[k - 1], 0) + 1 ELSE 0 END))))
  FROM step WHERE i < len(p) AND len(r) > 0),
x AS (SELECT 'turn ' || turn AS subtype, CASE WHEN len(r) > 0 AND coalesce(list_max(cells), 0) > 0
        THEN 2.0 * list_max(cells) / (len(p) + len(r)) ELSE 0.0 END AS l
      FROM step WHERE i = len(p) OR len(r) = 0)
SELECT subtype, count(*) AS n, round_even(avg(l), 4) AS rouge_l FROM x GROUP BY ROLLUP (subtype)"""


@query(SQL_LCS)
def rouge_l_report(spark, sf_dir):
    """The longest common subsequence of whole cleaned answers and references, per subtype and overall."""
    rows = R.text_report(_clean_pairs(spark, sf_dir), "subtype", "pred", "ref")
    return rows.select("subtype", F.col("n").cast("long").alias("n"), "rouge_l")


@query("""
WITH d AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
h AS (SELECT doc_id, lang, w[1:len(w) // 2] AS p, w[len(w) // 2 + 1:len(w)] AS r FROM d),
t AS (SELECT doc_id, unnest(p) AS g, 1 AS a, 0 AS b FROM h UNION ALL SELECT doc_id, unnest(r), 0, 1 FROM h),
c AS (SELECT doc_id, g, sum(a) AS a, sum(b) AS b FROM t GROUP BY ALL),
o AS (SELECT doc_id, sum(least(a, b)) AS m FROM c GROUP BY ALL)
SELECT doc_id, CAST(coalesce(m, 0) AS BIGINT) AS shared FROM h LEFT JOIN o USING (doc_id)
""")
def half_overlaps(spark, sf_dir):
    """Words that the first and the second half of each whole document share, repeats counted: texts of
    up to 20,000 words."""
    docs = documents(spark, sf_dir).select("doc_id", alnum_tokens(F.col("text")).alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    cut = docs.select("doc_id", F.slice("w", F.lit(1), half).alias("p"), F.slice("w", half + 1, F.size("w") - half).alias("r"))
    return cut.select("doc_id", M.overlap_counts("p", "r", (1,))["m1"].alias("shared"))


@query(f"""
WITH {SQL_PAIRS}, x AS (SELECT CASE WHEN turn % 4 = 0 THEN NULL ELSE 'turn ' || turn END AS subtype, length(pred) AS n FROM pairs)
SELECT subtype, grouping(subtype) = 1 AS overall, count(*) AS n, round_even(avg(n), 4) AS mean FROM x GROUP BY ROLLUP (subtype)
""")
def means_with_unnamed_group(spark, sf_dir):
    """A group without a name beside the overall row."""
    pairs = turn_pairs(spark, sf_dir).withColumn("subtype", F.when(F.col("turn") % 4 != 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))))
    sums = {"n": F.lit(1), "s": F.length("pred")}
    return A.with_overall(pairs, "subtype", sums, {"n": F.col("n").cast("long"), "mean": round_mean(F.col("s") / F.col("n"), 4)})


@query(f"""
WITH {SQL_PAIRS}, tok AS (SELECT conv_id, turn, {WORDS.format('pred')} AS p, {WORDS.format('ref')} AS r FROM pairs),
{', '.join(sql_overlap('tok', n) for n in (1, 2, 3, 4))},
rows AS (SELECT 'turn ' || turn AS subtype, len(p) AS pl, len(r) AS rl, {', '.join(f's{n}.hits AS m{n}, greatest(len(p) - {n - 1}, 1) AS t{n}' for n in (1, 2, 3, 4))}
  FROM tok {' '.join(f'JOIN s{n} USING (conv_id, turn)' for n in (1, 2, 3, 4))}),
agg AS (SELECT subtype, sum(pl) AS pl, sum(rl) AS rl, {', '.join(f'sum(m{n}) AS m{n}, sum(t{n}) AS t{n}' for n in (1, 2, 3, 4))} FROM rows GROUP BY ROLLUP (subtype))
SELECT subtype, CAST(m1 AS BIGINT) AS m1, CAST(m4 AS BIGINT) AS m4, CAST(t4 AS BIGINT) AS t4,
  CAST(printf('%.4f', CAST(CASE WHEN m1 = 0 OR pl = 0 THEN 0.0 ELSE (CASE WHEN pl > rl THEN 1.0 ELSE exp(1 - rl / pl) END) *
    exp(({' + '.join(f'ln(CASE WHEN m{n} > 0 THEN m{n} ELSE 0.1 END / t{n})' for n in (1, 2, 3, 4))}) / 4) END AS DOUBLE)) AS DOUBLE) AS bleu_4
FROM agg
""")
def corpus_bleu(spark, sf_dir):
    """Corpus BLEU-4 of replies against the turns before them, per subtype and overall."""
    pairs = turn_pairs(spark, sf_dir).withColumn("subtype", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    rows = A.corpus_bleu(pairs, "pred", "ref", "subtype")
    return rows.select("subtype", "m1", "m4", "t4", round_ratio(F.col("bleu_4"), 4).alias("bleu_4"))


@query(f"""
WITH {SQL_PAIRS}, w AS (SELECT conv_id, turn, list_distinct({WORDS.format('pred')}) AS p, list_distinct({WORDS.format('ref')}) AS r FROM pairs),
x AS (SELECT conv_id, turn, len(p) AS np, len(r) AS nr, len(list_intersect(p, r)) AS b FROM w)
SELECT conv_id, turn, round_even(CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN np > 0 THEN b / np ELSE 0.0 END, 6) AS p,
  round_even(CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN nr > 0 THEN b / nr ELSE 0.0 END, 6) AS r,
  round_even(CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN b > 0 THEN 2.0 * b / (np + nr) ELSE 0.0 END, 6) AS f1 FROM x
""")
def set_scores(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    prf = M.set_prf(words(F.col("pred")), words(F.col("ref")))
    return pairs.select("conv_id", "turn", prf.alias("s")).select(
        "conv_id", "turn", *[round_mean(F.col(f"s.{c}"), 6).alias(c) for c in ("p", "r", "f1")])


@query(f"""
WITH t AS (SELECT unnest({WORDS.format('text')}) AS tok FROM documents)
SELECT CAST(count(DISTINCT tok) AS BIGINT) AS distinct_n, count(*) AS total_n, CAST(printf('%.4f', CAST(count(DISTINCT tok) / count(*) AS DOUBLE)) AS DOUBLE) AS ratio FROM t
""")
def distinct_words(spark, sf_dir):
    rows = A.distinct_n(documents(spark, sf_dir), "text", 1)
    return rows.withColumn("ratio", round_ratio(F.col("ratio"), 4))


@query(f"""
WITH t AS (SELECT lang, {WORDS.format('text')} AS w FROM documents), g AS (SELECT lang, unnest({sql_grams('w', 2)}) AS gram FROM t)
SELECT lang, CAST(count(DISTINCT gram) AS BIGINT) AS distinct_n, count(*) AS total_n, CAST(printf('%.4f', CAST(count(DISTINCT gram) / count(*) AS DOUBLE)) AS DOUBLE) AS ratio FROM g GROUP BY lang
""")
def distinct_bigrams_by_language(spark, sf_dir):
    rows = A.distinct_n(documents(spark, sf_dir), "text", 2, by="lang")
    return rows.withColumn("ratio", round_ratio(F.col("ratio"), 4))


@query(f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM d),
b AS (SELECT tok || ' ' || lead(tok) OVER (ORDER BY doc_id, pos) AS gram FROM t)
SELECT CAST(count(DISTINCT gram) AS BIGINT) AS distinct_n, count(*) AS total_n, CAST(printf('%.4f', CAST(count(DISTINCT gram) / count(*) AS DOUBLE)) AS DOUBLE) AS ratio FROM b WHERE gram IS NOT NULL
""")
def distinct_bigrams_across(spark, sf_dir):
    """Distinct bigrams of the whole stream, pairs across neighbouring documents included."""
    rows = A.distinct_n(documents(spark, sf_dir), "text", 2, id="doc_id", cross=True)
    return rows.withColumn("ratio", round_ratio(F.col("ratio"), 4))


@query("""
WITH t AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS a FROM benchmark),
x AS (SELECT p.item_id, p.a, n.a AS b FROM t p JOIN t n ON n.item_id = p.item_id + 1)
SELECT item_id, round_even(CASE WHEN greatest(length(a), length(b)) > 0 THEN levenshtein(a, b) / greatest(length(a), length(b)) ELSE 0.0 END, 6) AS distance FROM x
""")
def edit_distances(spark, sf_dir):
    """Edit distance of each benchmark text to the next one."""
    t = table(spark, sf_dir, "benchmark").select("item_id", _ascii(F.col("text")).alias("a"))
    following = t.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    pairs = t.join(following, "item_id")
    return pairs.select("item_id", round_mean(M.norm_edit_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS t FROM documents)
SELECT doc_id, CASE WHEN len(t) = 0 THEN 'inf' ELSE printf('%.6e', exp(len(t) / len(list_distinct(t)))) END AS perplexity FROM w
""")
def pseudo_perplexities(spark, sf_dir):
    score = M.pseudo_perplexity(F.col("text"))
    shown = F.when(score == float("inf"), "inf").otherwise(F.format_string("%.6e", score))
    return documents(spark, sf_dir).select("doc_id", shown.alias("perplexity"))


@query("""
SELECT quality AS task, CAST(count(*) FILTER (toxic = 0) AS BIGINT) AS correct, count(*) AS total,
       CAST(printf('%.4f', CAST(count(*) FILTER (toxic = 0) / count(*) AS DOUBLE)) AS DOUBLE) AS accuracy FROM labels GROUP BY quality
""")
def label_accuracy(spark, sf_dir):
    return A.accuracy(table(spark, sf_dir, "labels").withColumnRenamed("quality", "task"), F.col("toxic") == 0, "task")


@query("""
SELECT role, CAST(count(*) FILTER (hit) AS BIGINT) AS correct, count(*) AS total, CAST(printf('%.4f', CAST(count(*) FILTER (hit) / count(*) AS DOUBLE)) AS DOUBLE) AS accuracy
FROM (SELECT role, CASE WHEN turn = 0 THEN 'ZERO' = upper('zero') ELSE length(text) % 2 = turn % 2 END AS hit FROM conversations) GROUP BY role
""")
def move_matches(spark, sf_dir):
    """Exact match of an answer with its reference, directly or through a supplied alias."""
    conv = table(spark, sf_dir, "conversations")
    answer = F.when(F.col("turn") == 0, "Zero").otherwise((F.length("text") % 2).cast("string"))
    reference = F.when(F.col("turn") == 0, "zero").otherwise((F.col("turn") % 2).cast("string"))
    alias = F.when(F.col("turn") == 0, "zero")
    return A.accuracy(conv, M.move_exact_match(answer, reference, alias), "role")


@query("""
SELECT event_type AS task_type, CAST(count(*) FILTER (hit) AS BIGINT) AS correct, count(*) AS total,
       CAST(printf('%.4f', CAST(count(*) FILTER (hit) / count(*) AS DOUBLE)) AS DOUBLE) AS accuracy
FROM (SELECT event_type, CASE event_type WHEN 'signup' THEN k % 2 = 0 WHEN 'error' THEN k % 3 = 0 WHEN 'click' THEN true
        WHEN 'view' THEN k % 4 = 0 ELSE false END AS hit FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
GROUP BY event_type
""")
def rule_task_report(spark, sf_dir):
    """Raw answers normalised by task and scored, move lists as sets."""
    ev = events(spark, sf_dir).withColumn("k", k_of())
    k, kind = F.col("k"), F.col("event_type")
    task = (F.when(kind == "signup", "is_square_attacked").when(kind == "error", "list_legal_moves")
            .when(kind == "click", "identify_color").when(kind == "view", "identify_piece").otherwise("identify_outcome"))
    raw = (
        F.when(kind == "signup", F.when(k % 2 == 0, "Well, yes.").otherwise("no idea"))
        .when(kind == "error", F.when(k % 3 == 0, "e2e4 a2a3, e2e4").otherwise("e2e4"))
        .when(kind == "click", "it is WHITE")
        .when(kind == "view", F.when(k % 4 == 0, "the N").otherwise("the R")).otherwise("Check")
    )
    reference = (F.when(kind == "signup", "Yes").when(kind == "error", "a2a3 e2e4").when(kind == "click", "white")
                 .when(kind == "view", "n").otherwise("Capture"))
    samples = ev.select(task.alias("task"), raw.alias("raw"), reference.alias("reference"), F.lit("P1").alias("data_source"),
                        F.lit(None).cast("string").alias("task_id"), "event_type")
    rows = R.rule_report(R.scored_answers(samples))
    names = {"is_square_attacked": "signup", "list_legal_moves": "error", "identify_color": "click",
             "identify_piece": "view", "identify_outcome": "purchase"}
    back = F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), "task_type")
    return rows.withColumn("task_type", back)


# Engine lines of a position (user): event types by their best score in centipawns.
SQL_LINES = f"""
cp AS (SELECT event_id, user_id, event_type, k, CAST(round(value * 100) AS BIGINT) AS cp FROM {EVENTS_K}),
lines AS (SELECT user_id, event_type AS move, max(cp) AS score, row_number() OVER (PARTITION BY user_id ORDER BY max(cp) DESC, event_type) AS rank
          FROM cp GROUP BY user_id, event_type),
n AS (SELECT user_id, max(rank) AS n, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 3 THEN score END) AS s3,
             string_agg(CASE WHEN rank <= 3 THEN move END, ',' ORDER BY rank) AS top FROM lines GROUP BY user_id)"""


def _engine_lines(ev):
    """Event types of each user as engine moves, ranked by their best score."""
    from pyspark.sql import Window

    cp = F.round(F.col("value") * 100).cast("long")
    best = ev.groupBy(F.col("user_id").alias("pos_id"), F.col("event_type").alias("move")).agg(F.max(cp).alias("score"))
    # At most one row per event type and user is left to rank.
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("pos_id").orderBy(F.desc("score"), "move")))


def _predictions(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    preds = ev.select(
        "event_id", F.col("user_id").alias("pos_id"), F.col("event_type").alias("move"), k_of().alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cp"))
    return J.attach_engine(preds, _engine_lines(ev), [1, 3])


@query(f"""
WITH {SQL_LINES}, b AS (SELECT e.event_id, e.cp AS cand, e.k * 100 AS gt, CASE WHEN e.event_id % 2 = 0 THEN 'w' ELSE 'b' END AS side, v.k,
    CASE WHEN n.n >= v.k THEN CASE WHEN v.k = 1 THEN s1 ELSE s3 END ELSE s1 END AS base
  FROM cp e JOIN n USING (user_id), (VALUES (1), (3)) v(k)),
m AS (SELECT k, 'ssd' AS measure, CASE WHEN side = 'w' THEN base - cand ELSE cand - base END AS v FROM b
      UNION ALL SELECT k, 'pred_vs_engine', cand - base FROM b UNION ALL SELECT k, 'engine_vs_ref', base - gt FROM b)
SELECT CAST(k AS BIGINT) AS k, measure, count(*) AS n, round_even(avg(v), 2) AS avg, round_even(stddev_pop(v), 2) AS stddev,
       CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max, CAST(median(v) AS DOUBLE) AS median FROM m GROUP BY k, measure
""")
def score_deltas_by_k(spark, sf_dir):
    """Score given away and the two deltas at K = 1 and 3: mean, median, deviation and range."""
    rows = _predictions(spark, sf_dir)
    side = F.when(F.col("event_id") % 2 == 0, "w").otherwise("b")
    stats = A.delta_stats(rows, side, F.col("cp"), F.col("k") * 100)
    doubles = [F.col(c).cast("double").alias(c) for c in ("avg", "stddev", "min", "max", "median")]
    return stats.select(F.col("k").cast("long").alias("k"), "measure", "n", *doubles)


@query(f"""
WITH {SQL_LINES}, t AS (SELECT e.event_id, e.event_type AS move, string_split(top, ',') AS top FROM cp e JOIN n USING (user_id)),
f AS (SELECT v.k, list_contains(top[1:v.k], move) AS hit FROM t, (VALUES (1), (2), (3)) v(k))
SELECT CAST(k AS BIGINT) AS k, CAST(count(*) FILTER (hit) AS BIGINT) AS hits, count(*) AS attempts, count(*) AS scored,
       CAST(printf('%.4f', CAST(count(*) FILTER (hit) / count(*) AS DOUBLE)) AS DOUBLE) AS agreement_rate, CAST(printf('%.4f', CAST(count(*) FILTER (hit) / count(*) AS DOUBLE)) AS DOUBLE) AS accuracy FROM f GROUP BY k
""")
def top_k_agreement(spark, sf_dir):
    rows = A.agreement_stats(_predictions(spark, sf_dir), [1, 2, 3])
    return rows.withColumn("k", F.col("k").cast("long"))


@query(f"""
WITH {SQL_LINES}, t AS (SELECT e.event_id, e.event_type AS move, string_split(top, ',') AS top FROM cp e JOIN n USING (user_id))
SELECT event_id, list_contains(top[1:1], move) AS in_top_1, list_contains(top[1:3], move) AS in_top_3 FROM t
""")
def top_k_membership(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    return rows.select("event_id", *[M.in_top_k(F.col("move"), F.col("top"), k).alias(f"in_top_{k}") for k in (1, 3)])


@query(f"""
SELECT event_type, count(*) AS total_examples, CAST(count(*) FILTER (k % 4 <> 0) AS BIGINT) AS parsed_moves,
  CAST(count(*) FILTER (k % 4 > 1) AS BIGINT) AS valid_moves, CAST(count(*) FILTER (k % 4 = 3) AS BIGINT) AS in_top_k,
  round_even(count(*) FILTER (k % 4 <> 0) / count(*), 4) AS parse_rate, round_even(count(*) FILTER (k % 4 > 1) / count(*), 4) AS valid_rate,
  round_even(count(*) FILTER (k % 4 = 3) / count(*), 4) AS in_top_k_rate, round_even(avg(CASE WHEN k % 4 > 1 THEN value END), 4) AS average_score,
  min(CASE WHEN k % 4 > 1 THEN value END) AS score_min, max(CASE WHEN k % 4 > 1 THEN value END) AS score_max
FROM {EVENTS_K} GROUP BY event_type
""")
def generation_statistics(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("k", k_of())
    state = F.col("k") % 4
    rows = A.generation_stats(ev, "event_type", state != 0, state > 1, state == 3, F.col("value"))
    rounded = ["parse_rate", "valid_rate", "in_top_k_rate", "average_score"]
    return rows.withColumns({c: round_mean(F.col(c), 4) for c in rounded})


@query(f"""
WITH v AS (SELECT event_type, CASE WHEN k < 30 THEN 'good' WHEN k < 60 THEN 'blunder' ELSE 'unknown' END AS verdict, k, CAST(round(value * 100) AS BIGINT) AS cp FROM {EVENTS_K}),
t AS (SELECT event_type, count(*) AS total, CAST(count(*) FILTER (k % 10 = 0) AS BIGINT) AS illegal, CAST(count(*) FILTER (k % 7 = 0) AS BIGINT) AS empty,
        CAST(sum(CASE WHEN k % 10 <> 0 THEN cp END) AS BIGINT) AS score_sum FROM v GROUP BY event_type)
SELECT event_type, verdict, count(*) AS n, any_value(total) AS total, any_value(illegal) AS illegal, any_value(empty) AS empty, any_value(score_sum) AS score_sum
FROM v JOIN t USING (event_type) GROUP BY event_type, verdict
""")
def verdict_counts(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("k", k_of())
    verdict = F.when(F.col("k") < 30, "good").when(F.col("k") < 60, "blunder").otherwise("unknown")
    status = F.when(F.col("k") % 10 == 0, "illegal").otherwise("ok")
    score = F.when(status == "ok", F.round(F.col("value") * 100).cast("long"))
    output = F.when(F.col("k") % 7 == 0, "").otherwise("text")
    return A.verdict_histogram(ev.withColumn("verdict", verdict), "event_type", "verdict", score, status, output)


@query(f"""SELECT event_type, round_even(avg(value), 4) AS value, round_even(avg(k), 4) AS k FROM {EVENTS_K} GROUP BY event_type""")
def method_averages(spark, sf_dir):
    rows = A.method_means(table(spark, sf_dir, "events").withColumn("k", k_of()), "event_type", ["value", "k"])
    return rows.select("event_type", round_mean(F.col("value"), 4).alias("value"), round_mean(F.col("k"), 4).alias("k"))


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
x AS (SELECT c.label, c.vec_id AS c, r.vec_id AS r, list_cosine_similarity(c.e, r.e) AS s FROM v c JOIN v r ON c.label = r.label AND c.vec_id % 2 = 0 AND r.vec_id % 2 = 1),
p AS (SELECT label, avg(b) AS p FROM (SELECT label, c, max(s) AS b FROM x GROUP BY label, c) GROUP BY label),
q AS (SELECT label, avg(b) AS r FROM (SELECT label, r, max(s) AS b FROM x GROUP BY label, r) GROUP BY label)
SELECT label, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(2 * p * r / (p + r), 4) AS f1 FROM p JOIN q USING (label)
""")
def greedy_vector_match(spark, sf_dir):
    """Even vectors of a label as the candidate, odd ones as the reference."""
    v = table(spark, sf_dir, "embeddings")
    even = F.col("vec_id") % 2 == 0
    rows = A.greedy_match_prf(v.where(even), v.where(~even), "label", "vec_id", "embedding", block=32)
    return rows.select("label", *[round_mean(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")])


@query("""
WITH t AS (SELECT label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 20) AS INTEGER))[5:] AS made FROM embeddings),
c AS (SELECT label, coalesce(list_min(list_transform(list_filter(list_zip(made, range(1, len(made) + 1)), lambda z: z[1] IN (4, 5)), lambda z: z[2])) - 1, len(made)) AS n FROM t)
SELECT label, count(*) AS prompts, CAST(sum(n) AS BIGINT) AS tokens, CAST(count(*) * 0.5 AS DOUBLE) AS seconds, round_even(sum(n) / (count(*) * 0.5), 4) AS tokens_per_sec,
       round_even((count(*) * 0.5) / sum(n), 6) AS sec_per_token, CAST(0.5 AS DOUBLE) AS sec_per_prompt FROM c GROUP BY label
""")
def generation_throughput(spark, sf_dir):
    """Vectors read as generated ids: ids after a prompt of four and before the first stop id."""
    v = table(spark, sf_dir, "embeddings")
    ids = F.transform("embedding", lambda x: F.floor(x.cast("double") * 20).cast("int"))
    rows = A.throughput(v, M.tokens_until_stop(ids, F.lit(4), [4, 5]), F.lit(0.5), "label")
    return rows.withColumns({"tokens_per_sec": round_mean(F.col("tokens_per_sec"), 4), "sec_per_token": round_mean(F.col("sec_per_token"), 6)})


@query("""
SELECT event_type, arg_max(value, event_id) FILTER (event_type <> 'view') AS value FROM events WHERE event_type <> 'view' GROUP BY event_type
UNION ALL SELECT 'view', max(value) FROM events
""")
def latest_metrics(spark, sf_dir):
    """Last logged value per metric; the metric whose log is empty takes its fallback."""
    ev = table(spark, sf_dir, "events")
    log = ev.withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    fallback = ev.agg(F.max("value").alias("value")).withColumn("event_type", F.lit("view"))
    return A.latest_metric(log, "event_type", "event_id", "value", fallback)


@query("""SELECT source AS data_source, count(*) AS n FROM documents GROUP BY source""")
def source_counts(spark, sf_dir):
    return A.source_counts(table(spark, sf_dir, "documents").withColumnRenamed("source", "data_source"))


@query("""SELECT event_type AS task, count(*) AS n FROM events GROUP BY event_type ORDER BY event_type""")
def task_counts(spark, sf_dir):
    return A.task_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "task"))


@query("""
SELECT vec_id, round_even(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 8) AS mean FROM embeddings
""")
def vector_means(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", round_mean(array_mean(F.col("embedding")), 8).alias("mean"))


@query(f"""
SELECT event_type, count(*) AS n, round_even(median(k), 4) AS median, round_even(avg(value), 4) AS mean,
       CASE WHEN event_type = 'view' THEN 'N/A' ELSE printf('%.1f', CAST(median(k) AS DOUBLE)) END AS shown
FROM {EVENTS_K} GROUP BY ROLLUP (event_type)
""")
def grouped_medians(spark, sf_dir):
    """Exact medians per type and over all, next to means from partial sums."""
    ev = table(spark, sf_dir, "events").withColumn("k", k_of())
    sums = {"n": F.lit(1), "s": F.col("value")}
    means = A.with_overall(ev, "event_type", sums, {"n": F.col("n"), "mean": round_mean(F.col("s") / F.col("n"), 4)})
    each = A.grouped_median(ev, ["event_type"], "k")
    overall = A.grouped_median(ev.withColumn("event_type", F.lit(None).cast("string")), ["event_type"], "k")
    # An overall group has a NULL key, which no equality join meets.
    both = means.join(each.unionByName(overall).withColumnRenamed("event_type", "t"), F.col("event_type").eqNullSafe(F.col("t")), "left")
    shown = format_metric(F.when(F.coalesce(F.col("event_type") != "view", F.lit(True)), F.col("median").cast("double")), "%.1f")
    return both.select("event_type", F.col("n").cast("long").alias("n"), F.col("median").cast("double").alias("median"), "mean", shown.alias("shown"))


def _sql_stats(tail: str, value: str, source: str, stats=("avg", "median", "stddev")) -> list[str]:
    calc = {"avg": "round_even(avg({v}), 2)", "median": "round_even(median({v}), 2)", "stddev": "round_even(stddev_pop({v}), 2)",
            "min": "min({v})", "max": "max({v})"}
    return [f"SELECT '{s}_{tail}' AS metric, CAST({calc[s].format(v=value)} AS DOUBLE) AS value FROM {source}" for s in stats]


_METRIC_ROWS = [
    "SELECT 'predict_move_em_accuracy' AS metric, CAST(printf('%.4f', CAST(count(*) FILTER (move = reference) / count(*) AS DOUBLE)) AS DOUBLE) AS value FROM b",
    *[f"SELECT '{name}' AS metric, CAST(printf('%.4f', CAST(count(*) FILTER (list_contains(top[1:{k}], move)) / count(*) AS DOUBLE)) AS DOUBLE) AS value FROM b"
      for k in (1, 3) for name in (f"top_{k}_agreement_rate", f"predict_move_sf_in_top{k}_accuracy")],
    *[f"SELECT 'average_ssd_cp_vs_sf_top{k}' AS metric, CAST(printf('%.2f', CAST(avg(CASE WHEN side = 'w' THEN base{k} - pred ELSE pred - base{k} END) AS DOUBLE)) AS DOUBLE) AS value FROM b" for k in (1, 3)],
    *[row for k in (1, 3) for row in _sql_stats(f"delta_llm_vs_sf_wpov_vs_top{k}", f"pred - base{k}", "b")],
    *[row for k in (1, 3) for row in _sql_stats(f"delta_sf_vs_gt_wpov_vs_top{k}", f"base{k} - ref", "b")],
    """SELECT 'llm_better_than_gt_rate' AS metric, CAST(printf('%.4f', CAST(count(*) FILTER (CASE WHEN side = 'w' THEN pred > ref ELSE pred < ref END) / count(*) AS DOUBLE)) AS DOUBLE) AS value
       FROM b WHERE pred IS NOT NULL AND ref IS NOT NULL""",
    *_sql_stats("delta_llm_vs_gt_cp", "pred - ref", "b", ("avg", "median", "stddev", "min", "max")),
]


@query(f"""
WITH {SQL_LINES}, e AS (SELECT event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'w' ELSE 'b' END AS side,
    CASE WHEN event_type = 'purchase' THEN '' ELSE event_type END AS move, CASE WHEN k % 2 = 0 THEN event_type ELSE 'click' END AS reference FROM cp),
b AS (SELECT e.*, string_split(n.top, ',') AS top, n.s1 AS base1, CASE WHEN n.n >= 3 THEN n.s3 ELSE n.s1 END AS base3, p.score AS pred, r.score AS ref
  FROM e JOIN n USING (user_id) LEFT JOIN lines p ON p.user_id = e.user_id AND p.move = e.move LEFT JOIN lines r ON r.user_id = e.user_id AND r.move = e.reference)
{' UNION ALL '.join(_METRIC_ROWS)}
""")
def evaluation_metrics(spark, sf_dir):
    """The whole evaluation of move answers: raw text to named metrics. A word that is too long to be
    a move is read as no answer."""
    from plyforge.functions.prompts import p1_prompt
    from plyforge.plans.evaluate import evaluate

    ev = events(spark, sf_dir).withColumn("k", k_of())
    side = F.when(F.col("user_id") % 2 == 0, "w").otherwise("b")
    pos = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(" "), side)
    lines = _engine_lines(ev).withColumn("side", F.when(F.col("pos_id") % 2 == 0, "w").otherwise("b"))
    engine = lines.withColumn("pos_id", F.concat(F.lit("u"), F.col("pos_id").cast("string"), F.lit(" "), "side"))
    samples = ev.select(
        F.col("event_id").alias("sample_id"), F.lit("P1").alias("data_source"), F.lit("predict_move").alias("task"),
        F.lit(None).cast("string").alias("task_id"), p1_prompt(F.lit("Predict the next move."), pos, F.lit("")).alias("input"),
        F.concat(F.lit("Explanation: [ASSISTANT] "), "event_type").alias("raw"),
        F.when(F.col("k") % 2 == 0, F.col("event_type")).otherwise("click").alias("reference"),
    )
    metrics, _, _ = evaluate(samples, engine, engine.select("pos_id", "move", "score"), ks_ref=(1, 3), ks_agree=(1, 3))
    return metrics

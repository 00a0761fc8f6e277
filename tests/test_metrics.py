import collections
import math
import random
import statistics
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plyforge.functions import core as C
from plyforge.functions import metrics as M
from plyforge.functions.stem import porter
from plyforge.operators import metrics as A
from plyforge.plans import report as R

WORDS = ["a", "b", "c", "The", "the", "d."]
TEXTS = st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join)
PAIRS = st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=8)


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def grams(tokens, n):
    return [tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)]


def bleu(pairs):
    matches, totals, pl, rl = [0] * 4, [0] * 4, 0, 0
    for p, r in pairs:
        p, r = p.split(), r.split()
        pl, rl = pl + len(p), rl + len(r)
        for n in range(1, 5):
            matches[n - 1] += sum((collections.Counter(grams(p, n)) & collections.Counter(grams(r, n))).values())
            totals[n - 1] += max(1, len(p) - n + 1)
    if matches[0] == 0 or pl == 0:
        return 0.0
    bp = 1.0 if pl > rl else math.exp(1 - rl / pl)
    return bp * math.exp(sum(0.25 * math.log((m or 0.1) / t) for m, t in zip(matches, totals)))


@settings(max_examples=15, deadline=None)
@given(pairs=PAIRS)
def test_overlap_scores(spark, pairs):
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "id int, pred string, ref string")
    rows = A.rouge_l(A.rouge_n(A.rouge_n(df, "pred", "ref", 1), "pred", "ref", 2), "pred", "ref").collect()
    for row in rows:
        p, r = ([w.strip(".").lower() for w in x.split()] for x in (row["pred"], row["ref"]))
        for n in (1, 2):
            gp, gr = grams(p, n), grams(r, n)
            hits = sum((collections.Counter(gp) & collections.Counter(gr)).values())
            assert row[f"rouge_{n}"] == pytest.approx(2 * hits / (len(gp) + len(gr)) if hits else 0.0)
        best = lcs(p, r)
        assert row["rouge_l"] == pytest.approx(2 * best / (len(p) + len(r)) if best else 0.0)
    assert A.corpus_bleu(df, "pred", "ref").first()["bleu_4"] == pytest.approx(bleu(pairs))


def test_lcs_of_long_lists(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcde") for _ in range(n)], [rng.choice("abcde") for _ in range(m)]) for n, m in [(0, 5), (5, 0), (150, 90), (64, 64), (200, 130)]]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r[0] for r in df.select(M.lcs_length("a", "b")).collect()]
    assert got == [lcs(a, b) for a, b in rows]


@settings(max_examples=10, deadline=None)
@given(pairs=PAIRS)
def test_bounds(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, r string")
    s = M.set_prf(C.words(F.col("p")), C.words(F.col("r")))
    for row in df.select(s.alias("s"), M.norm_edit_distance(F.col("p"), F.col("r")).alias("d"), "p", "r").collect():
        p, r = set(row["p"].split()), set(row["r"].split())
        both = len(p & r)
        want = (1.0, 1.0) if not p and not r else (both / len(p) if p else 0.0, both / len(r) if r else 0.0)
        assert (row["s"]["p"], row["s"]["r"]) == pytest.approx(want) and 0 <= row["s"]["f1"] <= 1 and 0 <= row["d"] <= 1


def test_bleu_per_group_and_overall(spark):
    rows = [("x", "a b c d e", "a b c d e"), ("x", "a b", "a c"), ("y", "q", "z"), ("y", "", "z")]
    got = {r["g"]: r["bleu_4"] for r in A.corpus_bleu(spark.createDataFrame(rows, "g string, p string, r string"), "p", "r", "g").collect()}
    for g in ("x", "y", None):
        assert got[g] == pytest.approx(bleu([(p, r) for k, p, r in rows if g in (None, k)]))


def test_distinct_across_samples(spark):
    texts = ["a b", "", "b a b", "a", " ", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    flat = " ".join(texts).split()
    row = A.distinct_n(df, "text", 2, id="id", cross=True).first()
    assert (row["distinct_n"], row["total_n"]) == (len(set(grams(flat, 2))), len(flat) - 1)
    inside = [g for t in texts for g in grams(t.split(), 2)]
    row = A.distinct_n(df, "text", 2).first()
    assert (row["distinct_n"], row["total_n"]) == (len(set(inside)), len(inside))
    empty = A.distinct_n(df.where("text = ''"), "text", 1).first()
    assert (empty["distinct_n"], empty["total_n"], empty["ratio"]) == (0, 0, 0.0)


@pytest.mark.parametrize("rows", [1, 7, 1_000_000])
def test_median(spark, monkeypatch, rows):
    """Also where the sketch is so coarse that most values lie between its bounds."""
    monkeypatch.setattr(A, "ACCURACY", max(5, rows))
    rng = random.Random(rows)
    values = [(g, rng.choice([None, rng.randint(-3000, 3000), 10**12, 5])) for g in ("g", "g", "g", "h", None) for _ in range(41)] + [("one", 3)]
    df = spark.createDataFrame(values, "g string, v long")
    got = {r["g"]: r["median"] for r in A.grouped_median(df, ["g"], "v").collect()}
    groups = collections.defaultdict(list)
    for g, v in values:
        if v is not None:
            groups[g].append(v)
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}


def test_spread_stats(spark):
    rows = [("a", v) for v in (1, 2, 2, 7)] + [("b", 5)]
    got = {r["g"]: r for r in A.spread_stats(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()}
    assert (got["a"]["avg"], got["a"]["median"], got["a"]["stddev"], got["a"]["min"], got["a"]["max"]) == (3.0, 2.0, 2.35, 1, 7)
    assert got["b"]["stddev"] == 0.0 and got["b"]["n"] == 1


@pytest.mark.parametrize("block", [3, 1000])
def test_greedy_match(spark, block):
    rng = np.random.default_rng(0)
    rows = [(s, role, i * 10 + s, rng.normal(size=4).astype(float).tolist()) for s, n in ((0, 40), (1, 3)) for i in range(n) for role in ("c", "r")]
    df = spark.createDataFrame(rows, "s int, role string, id int, v array<double>")
    got = {r["s"]: r for r in A.greedy_match_prf(df.where("role = 'c'"), df.where("role = 'r'"), "s", "id", "v", block).collect()}
    for s in (0, 1):
        a, b = (np.array([v for x, role, _, v in rows if x == s and role == k]) for k in "cr")
        cos = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        p, r = cos.max(axis=1).mean(), cos.max(axis=0).mean()
        assert (got[s]["precision"], got[s]["recall"], got[s]["f1"]) == pytest.approx((p, r, 2 * p * r / (p + r)))


def test_greedy_match_hands_few_blocks_at_a_time(spark):
    """A batch of block pairs holds hundreds of vectors in every row."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    df = spark.createDataFrame([(0, i, [float(i), 1.0]) for i in range(1200)], "s int, id int, v array<double>")
    pairs = A.greedy_match_prf(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "s", "id", "v", 1)
    assert int(spark.conf.get(name)) <= 256
    assert pairs.first()["precision"] > 0.9


def test_tokens_until_stop(spark):
    df = spark.createDataFrame([([9, 9, 1, 2, 0, 3], 2), ([9, 1], 2), ([9, 1, 1], 1), ([0, 0, 5], 2)], "ids array<int>, n int")
    assert [r[0] for r in df.select(M.tokens_until_stop(F.col("ids"), F.col("n"), [0])).collect()] == [2, 0, 2, 1]


def test_perplexity_of_an_empty_text(spark):
    df = spark.createDataFrame([("",), ("a a b",)], ["t"])
    assert [r[0] for r in df.select(M.pseudo_perplexity(F.col("t"))).collect()] == [math.inf, pytest.approx(math.exp(1.5))]


def test_rule_correct(spark):
    df = spark.createDataFrame([("identify_color", "white", "White"), ("identify_outcome", "Check", "Check"), ("identify_color", "x", None)], "t string, a string, r string")
    for strict, want in ((False, [True, True, False]), (True, [True, False, False])):
        assert [r[0] for r in df.select(A.rule_correct(F.col("t"), F.col("a"), F.col("r"), strict)).collect()] == want


def test_scored_answers(spark):
    rows = [("P1", "predict_move", None, "I play e2e4", "predict_move", "e2e4"), ("P2", None, "g_0_w_P2.1_General", "A. B. C. D. E", "P2.1_General", "A. B. C. D."),
            ("P2", None, None, "x", "explanation_generic", "x."), ("P1", None, "g_0_w_P2.1_General", "x", "unknown", "x")]
    df = spark.createDataFrame([r[:4] for r in rows], "data_source string, task string, task_id string, raw string")
    got = [(r["task_type"], r["answer"]) for r in R.scored_answers(df).collect()]
    assert got == [r[4:] for r in rows]


def test_text_report_adds_up(spark):
    rows = [("x", "a b", "a b"), ("x", "a", "b"), ("y", "", "")]
    got = {r["g"]: r for r in R.text_report(spark.createDataFrame(rows, "g string, p string, r string"), "g", "p", "r").collect()}
    assert got[None]["n"] == 3 and got["x"]["rouge_l"] == 0.5 and got[None]["rouge_1"] == pytest.approx(0.3333)
    assert got["y"]["set_f1"] == 1.0 and got["y"]["edit_distance"] == 0.0


def test_latest_and_throughput(spark):
    log = spark.createDataFrame([("loss", 1, 0.5), ("loss", 3, 0.2), ("lr", 2, None)], "key string, step int, value double")
    fallback = spark.createDataFrame([("lr", 0.1), ("loss", 9.0)], "key string, value double")
    assert {r["key"]: r["value"] for r in A.latest_metric(log, "key", "step", "value", fallback).collect()} == {"loss": 0.2, "lr": 0.1}
    assert {r["key"]: r["value"] for r in A.latest_metric(log, "key", "step", "value").collect()} == {"loss": 0.2}


def test_rounding_follows_the_held_value(spark):
    rng = random.Random(3)
    values = [1 / 160, 0.12345, 2.675, 1.005, 0.5, 5e-05, -5e-05, 4.9e-05, 5.1e-05, 3 / 32, 1 / 32, 1234567.00625, 1e-9, 0.0, 0.0005, 419.45]
    values += [rng.randint(0, 200_000) / rng.choice([160, 320, 2000, 20_000, 32, 64]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (1, 2, 3, 4):
        rows = df.select("v", C.round_ratio(F.col("v"), n).alias("r"), C.round_mean(F.col("v"), n).alias("m"), C.format_fixed(F.col("v"), f"%.{n}f").alias("t")).collect()
        for r in rows:
            assert r["r"] == round(r["v"], n) and r["m"] == float(np.round(r["v"], n))
            assert r["t"] == f"{abs(r['v']) if round(r['v'], n) == 0 else r['v']:.{n}f}" or (r["v"] < 0 and float(r["t"]) == round(r["v"], n))
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    assert [str(r[0]) for r in odd.select(C.round_ratio(F.col("v"), 2)).collect()] == ["nan", "inf", "None"]
    assert spark.range(1).select(C.format_metric(F.lit(None).cast("double"))).first()[0] == "N/A"


def test_porter_stems():
    """Examples given with the published algorithm."""
    pairs = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled " \
        "motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss " \
        "fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc " \
        "digitizer digit radicalli radic vileli vile analogousli analog vietnamization vietnam predication predic operator oper " \
        "feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit " \
        "sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope " \
        "goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust " \
        "defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun " \
        "activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate " \
        "cease ceas controll control roll roll".split()
    assert {w: porter(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))


def test_rouge_with_stems(spark):
    df = spark.createDataFrame([("The cats were running", "a cat runs"), (None, "x")], "p string, r string")
    rows = A.rouge(df, "p", "r", (1, 2), stem=True).collect()
    assert rows[0]["rouge_1"] == pytest.approx(4 / 7) and rows[0]["rouge_l"] == pytest.approx(4 / 7)
    assert A.rouge(df, "p", "r").first()["rouge_1"] == 0.0


def test_overlap_of_long_texts_is_linear():
    rng = random.Random(3)
    took = {}
    for n in (2_000, 20_000):
        x, y = ([f"w{rng.randrange(n)}" for _ in range(n)] for _ in range(2))
        start = time.perf_counter()
        for _ in range(3):
            assert M._shared(x, y, 2) == sum((collections.Counter(grams(x, 2)) & collections.Counter(grams(y, 2))).values())
        took[n] = (time.perf_counter() - start) / n
    assert took[20_000] < 5 * took[2_000]


def test_a_group_without_a_name_is_not_the_overall_row(spark):
    rows = [(None, "a b", "a b"), (None, "a", "b"), ("x", "c d", "c")]
    df = spark.createDataFrame(rows, "g string, p string, r string")
    got = {(r["g"], r["overall"]): r["n"] for r in R.text_report(df, "g", "p", "r").collect()}
    assert got == {(None, False): 2, ("x", False): 1, (None, True): 3}
    assert sorted((str(r["g"]), r["overall"]) for r in A.corpus_bleu(df, "p", "r", "g").collect()) == [("None", False), ("None", True), ("x", False)]


def test_a_vector_of_length_zero(spark):
    rows = [(0, "c", 1, [0.0, 0.0]), (0, "c", 2, [1.0, 0.0]), (0, "r", 3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "s int, role string, id int, v array<double>")
    got = A.greedy_match_prf(df.where("role = 'c'"), df.where("role = 'r'"), "s", "id", "v").first()
    assert (got["precision"], got["recall"], got["f1"]) == pytest.approx((0.5, 1.0, 2 / 3))


def test_edit_distance_in_bits(spark):
    """Against the built-in function, on texts of all lengths and alphabets."""
    import random

    rng = random.Random(3)
    texts = ["", "a", "kitten", "sitting", "日本語", "日本", "😀a", "é", "e\u0301"] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for letters in ("ab", "abcdefgh ", "aé日😀") for _ in range(40)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(500)]
    pairs += [(t, t[:len(t) // 2] + "x" + t[len(t) // 2 + 1:]) for t in texts] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(~M.edit_distance("a", "b").eqNullSafe(F.levenshtein("a", "b"))).count() == 0


def test_edit_distance_of_long_texts():
    import random
    import time

    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    one = " ".join(rng.choice(words) for _ in range(20_000))
    other = " ".join(rng.choice(words) for _ in range(20_000))
    begun = time.process_time()
    assert 0 < M._edits(one, other) < max(len(one), len(other))
    assert time.process_time() - begun < 60
    assert M._edits(one, one[:50_000] + "!" + one[50_000:70_000] + one[70_001:]) == 2


def test_edit_distances_of_the_benchmark(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("text is not null").select("item_id", "text")
    pairs = items.join(items.toDF("other_id", "other"), F.col("item_id") < F.col("other_id"))
    assert pairs.where(~M.edit_distance("text", "other").eqNullSafe(F.levenshtein("text", "other"))).count() == 0

"""Importance resampling against counting with plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plyforge.llm import ngram_table, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", " \n", "É" * 40 + " x " + "y" * 100 + " " + "z" * 31 + " q" * 33, "ÀB-c\x00d", "one two, ONE two one_two 12", "a" * 64 + " " + "a" * 64, "日本語 日本語 kana"]


def features(text, longest):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def simple_resample(docs, target, percent, least_words, buckets, longest, seed):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(bucket(f, buckets) for f in features(text, longest)[1])
    for text in target:
        t.update(bucket(f, buckets) for f in features(text, longest)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, grams = features(text, longest)
        weight = sum(gain[bucket(f, buckets)] for f in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    enough = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(enough[:percent * len(enough) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("window", [3, 1 << 18])
def test_table_counts_all_grams(longest, window, monkeypatch):
    monkeypatch.setattr(ngram_table, "WINDOW_WORDS", window)
    want = Counter(bucket(f, 97) for t in TEXTS for f in features(t, longest)[1])
    assert ngram_table.bucket_counts(TEXTS, longest, 97).tolist() == [want[b] for b in range(97)]
    gain = np.arange(97) * 7 - 300
    words, grams, total = ngram_table.gain_sums(TEXTS, longest, gain)
    for i, t in enumerate(TEXTS):
        w, f = features(t, longest)
        assert (words[i], grams[i], total[i]) == (len(w), len(f), sum(int(gain[bucket(x, 97)]) for x in f))


def test_keys_are_xxh64_and_equal_keys_are_told_apart(monkeypatch):
    words = ngram_table.Words(TEXTS)
    for start, length, _ in words.windows(2):
        spans = [words.bytes_at(s, n) for s, n in zip(start, length)]
        assert [int(h) for h in words.hashes(start, length)] == [xxhash.xxh64_intdigest(s) for s in spans]
        assert [int(c) for c in words.checksums(start, length)] == [zlib.crc32(s) for s in spans]
    # All keys the same: every n-gram must still get a slot of its own.
    monkeypatch.setattr(ngram_table.Words, "hashes", lambda self, start, length: np.full(len(start), 12345, np.uint64))
    want = Counter(bucket(f, 97) for t in TEXTS for f in features(t, 2)[1])
    assert ngram_table.bucket_counts(TEXTS, 2, 97).tolist() == [want[b] for b in range(97)]
    assert ngram_table.bucket_counts([], 2, 5).tolist() == [0] * 5


def test_resampled_table(spark, table):
    docs, target = table("documents"), table("benchmark")
    got = [tuple(r) for r in resampling.resample(docs, target).collect()]
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = simple_resample(plain, [r["text"] for r in target.collect()], 25, 20, 10_000, 2, 7)
    assert order(got) == order(want) and any(r[4] for r in got)
    drawn = resampling.resampled_documents(docs, target)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in want if r[4]}


def test_awkward_documents(spark, docs, rows, none):
    clash = docs.withColumn("weight", F.lit("own")).withColumn("Rank", F.lit(1)).withColumn("n_words", F.lit(0))
    target = spark.createDataFrame([("alpha0 alpha1",), (None,)], "text string")
    options = dict(percent=60, least_words=2, buckets=50, longest=2, seed=3)
    got = [tuple(r) for r in resampling.resample(clash, target, **options).collect()]
    # Rows alike in score and doc_id stand side by side in any order, so ranks are compared as a set.
    want = simple_resample([(r[1], r[2]) for r in rows], ["alpha0 alpha1", None], **options)
    assert order(got) == order(want)
    assert resampling.resample(none, target).count() == 0
    without = resampling.resample(docs, target.limit(0), **options)
    assert order([tuple(r) for r in without.collect()]) == order(simple_resample([(r[1], r[2]) for r in rows], [], **options))

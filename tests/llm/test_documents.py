"""The operators on documents against brute force, on awkward rows, and on the smallest tables."""

import hashlib
import math
import re
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plyforge.llm import langid, mixing, packing, secret_scan, simhash, sketches, substring_dedup, suffix_dedup
from plyforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def result(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- SimHash -----------------------------------------------------------------------------------


def simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def simple_components(prints):
    ids, root = list(prints), {}
    for a in ids:
        todo, seen = [a], {a}
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in seen and (prints[x] ^ prints[y]).bit_count() <= 3:
                    seen.add(y)
                    todo.append(y)
        root[a] = min(seen)
    return root


def test_fingerprints_and_components(spark):
    got = result(QUERIES["op1_simhash_near_dedup"](spark, SF))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: simple_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in want.items()}
    assert {i: r["component_id"] for i, r in got.items()} == simple_components(want)


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_links_at_the_limit(spark, hot):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    prints = set(base)
    for b in base:
        for bits in (1, 2, 3, 3, 4, 5):
            f = b
            for k in rng.choice(64, bits, replace=False):
                f ^= 1 << int(k)
            prints.add(f)
    signed = {f - 2**64 if f >= 2**63 else f: f for f in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = [(signed[r["a"]], signed[r["b"]]) for r in simhash.links(df, hot).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    want = {}
    for f, r in simple_components({f: f for f in prints}).items():
        want.setdefault(r, set()).add(f)
    group = {f: f for f in prints}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a, b in edges:
        group[max(root(a), root(b))] = min(root(a), root(b))
    got = {}
    for f in prints:
        got.setdefault(root(f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_near_duplicates_of_awkward_rows(docs, none):
    got = [(r["doc_id"], r["component_id"], r["fp"] == 0) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == 12
    assert {(1, 1, False), (2, 1, False), (3, 3, True), (4, 3, True), (5, 3, True)} <= set(got)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 6, 7, 8, 9, 10, None])
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# --- Repeated passages -------------------------------------------------------------------------


def simple_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    starts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_repeats_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = result(QUERIES["op2_substring_dedup"](spark, SF))
    for r, (n, gone, kept) in zip(rows, simple_repeats([r["text"] for r in rows], 35)):
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_removed"], g["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_of_few_words(spark, seed):
    """Few different words: periods, copies within a document, passages that end and begin anywhere."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(list("abc"), int(rng.integers(0, 60)))) for _ in range(25)]
    texts += ["a " * 50, "a b " * 30, "a b c " * 25, texts[3] + " c " + texts[4], texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = result(substring_dedup.remove_repeats(df, 7, 3))
    for i, want in enumerate(simple_repeats(texts, 7)):
        assert tuple(got[i])[1:] == want, texts[i]


def test_repeats_of_awkward_rows(docs, rows, none):
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
    want = simple_repeats([r[2] for r in rows], 35)
    assert got == sorted(((r[1], *w) for r, w in zip(rows, want)), key=str)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_paths_are_compacted(spark):
    """Two copies of one passage are one path; a branch ends it."""
    places = [(d, 0, at, 2, node) for d in (1, 2) for at, node in ((0, 10), (2, 11), (4, 12))] + [(3, 0, 5, 2, 11)]
    df = spark.createDataFrame(places, "did long, rid long, at int, n int, node long")
    got = {r["node"]: (r["path"], r["off"]) for r in substring_dedup.compacted(df).collect()}
    assert got == {10: (10, 0), 11: (11, 0), 12: (12, 0)}
    df = spark.createDataFrame([p for p in places if p[0] < 3], df.schema)
    got = {r["node"]: (r["path"], r["off"]) for r in substring_dedup.compacted(df).collect()}
    assert got == {10: (10, 0), 11: (10, 2), 12: (10, 4)}


def simple_earlier(rows, length):
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        before = {d[i:i + length] for other, t in rows if other is not None and (doc is None or other < doc)
                  for d in [(t or "").encode()] for i in range(len(d) - length + 1)}
        gone = set()
        for i in range(len(data) - length + 1):
            if data[i:i + length] in before:
                gone.update(range(i, i + length))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc, len(data), len(gone), spans, bytes(b for i, b in enumerate(data) if i not in gone)))
    return out


@pytest.mark.parametrize("seed,batch,crowd", [(1, 1 << 20, 20_000), (2, 200, 0), (3, 60, 3), (4, 60, 20_000)])
def test_earlier_bytes(spark, monkeypatch, seed, batch, crowd):
    """Few letters; batches of any size, keys that count as crowded or not."""
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("abé"), int(rng.integers(0, 90)))) for _ in range(25)]
    texts += ["a" * 70, "ab" * 40, texts[2] + "b" + texts[5], texts[2], texts[2][10:] + texts[2], ""]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)] + [(None, texts[2]), (5, texts[6]), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r)[:4] + (bytes(r[4]),) for r in suffix_dedup.remove_earlier(df, 12, 5).collect()), key=str)
    assert got == sorted(simple_earlier(rows, 12), key=str)


def test_levels_merge_geometrically():
    rng = np.random.default_rng(7)
    family, every = suffix_dedup.Family(), {}
    for _ in range(100):
        n = int(rng.integers(0, 30))
        key, rest = rng.integers(0, 5, n).astype(np.uint32), rng.integers(0, 9, n).astype(np.uint64)
        doc = rng.integers(0, 1000, n)
        family.add(suffix_dedup.merged([suffix_dedup.Level(key, rest, doc)]))
        for k, r, d in zip(key.tolist(), rest.tolist(), doc.tolist()):
            every[k, r] = min(d, every.get((k, r), 1000))
    assert all(len(size) < suffix_dedup.FANOUT for size in family.sizes) and len(family.sizes) == 3
    asked = suffix_dedup.Level(*(np.array(x) for x in zip(*[(np.uint32(k), np.uint64(r), 0) for k, r in every])))
    asked = asked._replace(key=asked.key.astype(np.uint32), rest=asked.rest.astype(np.uint64))
    assert family.scan(asked)[0].tolist() == list(every.values())
    family.settle()
    least, other = family.scan(asked)
    assert least.tolist() == list(every.values())
    assert other.tolist() == [sum(x == k for x, _ in every) - 1 for k, _ in every]


def test_earlier_bytes_of_awkward_rows(docs, rows, none):
    got = sorted((tuple(r)[:4] + (bytes(r[4]),) for r in suffix_dedup.remove_earlier(docs).collect()), key=str)
    assert got == sorted(simple_earlier([(r[1], r[2]) for r in rows], 50), key=str)
    assert suffix_dedup.remove_earlier(none).count() == 0


def test_earlier_bytes_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    seen, got = set(), result(QUERIES["op7_suffix_array_dedup"](spark, SF))
    for doc, text in rows:
        data = text.encode()
        starts = [data[i:i + 50] for i in range(len(data) - 49)]
        drop = np.zeros(len(data), bool)
        for i, s in enumerate(starts):
            if s in seen:
                drop[i:i + 50] = True
        seen.update(starts)
        kept = np.frombuffer(data, np.uint8)[~drop].tobytes()
        assert (got[doc]["n_removed"], got[doc]["kept_sha256"]) == (drop.sum(), hashlib.sha256(kept).hexdigest())


# --- Languages ---------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    found = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(docs, none):
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs).collect()]
    assert len(got) == 12
    assert {i for i, lang in got if lang == "und"} == {3, 4, 5, 8}
    assert sorted((r["doc_id"] or 0 for r in langid.keep_identified(docs).collect())) == [0, 1, 2, 2, 6, 7, 9, 10]
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0


def test_no_language_is_known(docs):
    """Texts with a letter stay where lang is NULL throughout, or in all rows that are learned from."""
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    held = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.col("lang")))
    for rows in (unlabelled, held):
        assert sorted(r["doc_id"] or 0 for r in langid.keep_identified(rows).collect()) == [0, 1, 2, 2, 6, 7, 9, 10]


def test_vectors_are_bound_and_bundled():
    grams, counts = langid.gram_counts("Ab, ab")
    assert dict(zip(grams.tolist(), counts.tolist())) == {1 * 64 + 2: 2, 1 * 4096 + 2 * 64: 2, 2 * 4096 + 1: 1}
    a, b, c = langid.LETTERS[0].astype(int), langid.LETTERS[1].astype(int), langid.LETTERS[2].astype(int)
    assert (langid.gram_vectors(np.array([66]))[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()
    text = "abc déf " * 400
    whole, block = langid.gram_counts(text), langid.BLOCK
    try:
        langid.BLOCK = 100
        assert [x.tolist() for x in langid.gram_counts(text)] == [x.tolist() for x in whole]
    finally:
        langid.BLOCK = block


# --- Mixing ------------------------------------------------------------------------------------


def simple_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, rest = {}, 1.5 * sum(sizes.values()), set(names)
    while rest:
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        rest -= over
    return target


def test_mix_of_awkward_rows(docs, rows, none):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[4]] += len((r[2] or "").split())
    taken, source = Counter(), {r[1]: r[4] for r in rows}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
        assert math.isclose(r["target"], simple_targets(sizes)[source[r["doc_id"]]], abs_tol=1e-6)
    for s, t in simple_targets(sizes).items():
        assert abs(taken[s] - t) <= 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mix_follows_its_schedules(spark):
    """Early positions hold more of the fading sources than late ones."""
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}", 20) for i in range(3000)],
                                 "doc_id long, text string, source string, n_chars long")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").where("position is not null").collect()
    for source, early in (("s0", True), ("s2", False)):
        at = [r["position"] for r in got if r["source"] == source]
        assert (np.mean(at) < np.mean([r["position"] for r in got if r["source"] == "s1"])) == early or source == "s0"
    assert 0 <= min(r["position"] for r in got) and max(r["position"] for r in got) <= 1


def test_mix_is_sorted_by_its_positions(spark):
    """Rows come in training order, and each second visit has its own place: behind the first, and where the source's
    schedule gets to its words once more."""
    docs = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 3}", 20) for i in range(900)], "doc_id long, text string, source string, n_chars long")
    got = mixing.mix(docs).collect()
    order = [(r["position"] is None, r["position"] or 0.0, r["doc_id"]) for r in got]
    assert len(got) == 900 and order == sorted(order)
    again = [r for r in got if r["second_position"] is not None]
    assert again and all(r["position"] < r["second_position"] <= 1 for r in again)
    tilt = {i: mixing.TILTS[i % 3] for i in range(3)}
    for i in range(3):
        mine = [r for r in got if r["doc_id"] % 3 == i and r["position"] is not None]
        words = lambda t: ((1 - tilt[i]) * t + tilt[i] * t * t) * mine[0]["target"]
        assert all(r["second_position"] is not None for r in mine if r["taken"] > r["size"])
        for r in mine:
            if r["second_position"] is not None:
                assert math.isclose(words(r["second_position"]) - words(r["position"]), r["source_size"], rel_tol=1e-6)


# --- Packing -----------------------------------------------------------------------------------


def check_pieces(rows, pieces):
    enc = packing.encoder(None)
    plain = enc.tokenizer
    want = Counter()
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        want[(doc_id, len(ids), np.array(ids, "<u4").tobytes())] += 1
    ids_of = {}
    for (doc_id, n, data), _ in want.items():
        ids_of.setdefault(doc_id, []).append((n, data))
    sequences, total = {}, Counter()
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        a, b = 4 * p["start"], 4 * (p["start"] + p["length"])
        assert any(n == p["doc_tokens"] and zlib.crc32(d[a:b]) == p["ids_crc32"] for n, d in ids_of[p["doc_id"]])
        total[p["doc_id"]] += p["length"]
    want_total = Counter()
    for (doc_id, n, _), k in want.items():
        want_total[doc_id] += n * k
    assert total == want_total
    lengths = []
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        lengths.append(sum(n for _, n in parts))
    assert max(lengths) <= 2048
    return sum(2048 - n for n in lengths if n & (n - 1)) / max(1, sum(lengths))


def test_packing_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check_pieces(rows, QUERIES["op6_packing"](spark, SF).collect()) < 0.03


def test_packing_of_awkward_rows(docs, rows, none):
    check_pieces([(r[1], r[2]) for r in rows], packing.pack(docs.coalesce(1)).collect())
    assert packing.pack(none).count() == 0


def test_ids_are_the_tokenizers():
    enc = packing.encoder(None)
    odd = ["", "  ", "don't, can't!! 'tis", "İstanbul ΣΑΣ, ΟΔΟΣ.", "é É, x́.", "tab\tsep\x1cfoo\xa0bar　baz",
           "<|endoftext|> hi", "½ ² Ⅷ 3.14,", "á,b.", "x\n\ny", "K K,", "!!..a..b,,", "ß, straße.", "a|b| |c||"]
    for text in odd * 2:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids + [1], text


@pytest.mark.parametrize("seed", range(4))
def test_ids_of_random_texts_are_the_tokenizers(seed):
    """Combining marks, letters that grow when lower-cased, special strings in any case, all kinds of white space."""
    rng = random.Random(seed)
    enc = packing.encoder(None)
    spaces = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    letters = list("abcXYZıİIiſKÅµßẞſǅΣςσÀàА́Ўйжあ漢ﷺאب१٣½²Ⅷªº")
    marks = list(".,!?;:|$%*#&'\"-_()[]<>/@~^`+=") + ["\u0301", "\u0307", "\u0308", "\u0327", "\u200d", "\ufe0f", "😀", "…", "·"]
    words = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|endoftext", "BELGESİ,", "YÖNETMELİĞİ.", "İ.", "don't", "WE'LL", "i\u0307.", "1a2."]
    kinds = [spaces, letters, letters, marks, marks, words, ["."], [" "], [" "], list(map(chr, range(0x80, 0x600, 3)))]
    for _ in range(2500):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 24)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids + [1], ascii(text)


def test_other_tokenizers_encode_texts_whole():
    import public_tokenizers

    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not enc.chunked
    for text in ("A bc, def!  ghi", "x\n\ny İ."):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_cuts_are_the_best():
    """Against all ways to cut a short run."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        places = np.unique(np.concatenate(([0], rng.integers(1, 60, 12), [60])))
        costs = rng.integers(0, 5, len(places))
        if max(np.diff(places)) > 16:
            continue
        cuts = packing.best_cuts(places, costs, 16, True)
        cost = dict(zip(places.tolist(), costs.tolist()))

        def total(cs, cost=cost):
            return sum(16 - (b - a) + cost[b] for a, b in zip([0, *cs], cs))

        best = {0: 0}
        for j in places[1:].tolist():
            best[j] = min(best[i] + 16 - (j - i) + cost[j] for i in best if j - 16 <= i < j)
        assert total(cuts) == best[60]


# --- Secrets -----------------------------------------------------------------------------------


def simple_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", *m.span())] * (len(m[2]) >= 6)
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_secrets(spark):
    got = result(QUERIES["op8_secret_scan"](spark, SF))
    for doc, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        want = simple_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[doc]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[doc][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) <= set(got[doc]["spans"].split(","))


def test_secrets_of_awkward_rows(docs, rows, none):
    got = secret_scan.find(docs, secret_scan.train(docs))
    assert got.count() == 12 and result(got)[10]["spans"] == "assign:0:17,access:22:42,hex:46:78"
    clean = secret_scan.redact(docs, None)
    row = result(clean)[10]
    assert clean.columns == docs.columns and row["text"] == "[SECRET] and [SECRET] or [SECRET]" and row["n_chars"] == 33
    assert row["clean"] == "c" and result(clean)[3]["text"] is None and result(clean)[9]["n_chars"] == 0
    assert secret_scan.find(none, secret_scan.train(none)).count() == 0


def test_network_tells_keys_from_numbers():
    rng = np.random.default_rng(3)
    keys = ["".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), 32)) for _ in range(500)]
    plain = ["".join(rng.choice(list("0123456789"), 16)) for _ in range(250)] + [
        f"section{i}.paragraph{i + 7}.overview" for i in range(250)]
    texts = [f"see {k} there" for k in keys + plain]
    x = np.array([secret_scan.windows(t, 4, len(t) - 6)[0] for t in texts])
    y = np.array([1] * 500 + [0] * 500)
    net = secret_scan.fit(x[::2], y[::2])
    found = secret_scan.scores(net, x[1::2]) >= net.threshold
    assert found[:250].mean() > 0.95 and found[250:].mean() < 0.03
    base, spans = secret_scan.all_spans(f"the key is {keys[1]} ok, account 4041894974608795", net)
    assert base == [] and spans == [(11, 43, "model")]
    assert len(secret_scan.windows("x" + "a1" * 200, 1, 401)) > 10


def test_network_learns_from_all_findings(spark, monkeypatch):
    """Every finding that is not held back is learned from, in parts; the threshold keeps 98 % of all that are held
    back, counted as often as they occur."""
    rng = np.random.default_rng(5)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [f"a token={draw('abcdefghijklmnopqrstuvwxyz0123456789', 30)}7 b" for _ in range(700)] + [f"n {draw('0123456789', 18)} m" for _ in range(700)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, *rows[:40] * 5])], "doc_id long, text string")
    seen, learned = [], secret_scan._learned
    monkeypatch.setattr(secret_scan, "PART", 400)
    monkeypatch.setattr(secret_scan, "EPOCHS", 6)
    monkeypatch.setattr(secret_scan, "_learned", lambda rows: seen.extend(rows.collect()) or learned(rows))
    net = secret_scan.train(docs)
    found = secret_scan.labelled_findings(docs).groupBy("label", "codes").agg(F.count("*").alias("n")).withColumn(
        "back", F.pmod(F.xxhash64("codes", F.lit(secret_scan.SEED)), F.lit(4)) == 0).collect()
    assert sorted((r["label"], r["codes"]) for r in seen) == sorted((r["label"], r["codes"]) for r in found if not r["back"])
    assert len({r["part"] for r in seen}) == 4 and sum(r["n"] for r in found) == 1600
    hits = [(secret_scan.scores(net, np.frombuffer(r["codes"], np.uint8)[None])[0], r["n"]) for r in found if r["back"] and r["label"]]
    kept, every = sum(n for p, n in hits if p >= net.threshold - 1e-9), sum(n for _, n in hits)
    assert kept >= secret_scan.LEAST_RECALL * every or net.threshold == secret_scan.LEAST_SCORE
    again = secret_scan.train(docs)
    assert again.threshold == net.threshold and (again.kernel == net.kernel).all()


def test_rank_of_outputs(spark):
    rng = np.random.default_rng(1)
    values = [(float(v), int(n)) for v, n in zip(np.round(rng.normal(0, 3, 500), 1) * 10.0 ** rng.integers(-9, 3, 500), rng.integers(1, 5, 500))]
    rows, plain = spark.createDataFrame(values, "raw double, n long"), sorted(v for v, n in values for _ in range(n))
    for rank in (0, 1, 17, len(plain) // 2, len(plain) - 1):
        assert secret_scan._value_at(rows, rank) == plain[rank]


# --- Sketches ----------------------------------------------------------------------------------


def test_edited_texts_and_likeness(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    got = result(QUERIES["op9_document_fingerprints"](spark, SF))
    prints, errors = {}, []

    def grams(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)]["text"]
        gone = len(text) // 3
        edited = text[:len(text) - gone] + following[:gone]
        g = got[doc]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, g["fingerprint"]) == g["fingerprint"]
        a, b = grams(text), grams(edited)
        if len(a | b) > 200:
            errors.append(abs(g["near_edited"] - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.06


def test_fingerprints_of_awkward_rows(docs, none, spark):
    got = sketches.fingerprints(docs).collect()
    assert len(got) == 12 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = {r["doc_id"]: r["fingerprint"] for r in got}
    assert same[1] == same[2] and same[3] == same[4] == same[5] == "" and len({same[1], same[6], same[7], ""}) == 4
    assert sketches.fingerprints(none).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert sketches.fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_buckets_of_scattered_ids(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", 7)
    ids = [int(x) for x in np.random.default_rng(2).choice(10**15, 300, replace=False)] + list(range(100)) + [-5, -10**12]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in sketches.with_next(df).collect()}
    ids.sort(reverse=True)
    assert got == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1])}


def test_sketches_merge_and_contain(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[1000:]), " ".join(words))], "a string, b string, c string")
    a, b, c = (sketches.sketch(F.col(x)) for x in "abc")
    row = df.select(sketches.merged(a, b).alias("m"), c.alias("c"), sketches.containment(a, c).alias("in_c"),
                    sketches.likeness(a, b).alias("j"), F.size(c).alias("n")).first()
    assert row["m"] == row["c"] and row["in_c"] == 1.0 and abs(row["j"] - 1 / 3) < 0.1 and 280 < row["n"] < 470


def test_every_query_is_registered():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in sorted(QUERIES, key=lambda q: int(re.match(r"op(\d+)_", q)[1]))] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)

"""Pages, vectors, components, anchors and the pipeline."""

import math
import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plyforge.llm import anchors, embedding_dedup, extraction, near_copies, simhash
from plyforge.llm.common import written
from plyforge.llm.components import components
from plyforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sentence(word, n):
    return " ".join(f"{word}{i}" for i in range(n))


def simple_roots(edges):
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        group[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in list(group)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(4)
    order = rng.permutation(300).tolist()
    edges = {
        "chain": list(zip(order, order[1:])),
        "star": [(500, i) for i in range(300)] + [(7, 7)],
        "random": [(int(a), int(b)) for a, b in rng.integers(-400, 400, (300, 2))],
        "none": [],
    }[kind]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    want = simple_roots([e for e in edges if e[0] != e[1]])
    assert got == want


# --- pages -------------------------------------------------------------------------------------


def article(html):
    inside = re.search(r"<article>(.*)</article>", html, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside).replace("<br>", " "))
    return "\n".join(b for b in (" ".join(unescape(b).split()) for b in blocks) if b)


def test_articles_of_the_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op3_html_extraction"](spark, SF).collect():
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) { x("<p>no</p>"); }</script></head><body>
<header><a href="/">Home of all things here</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies and more words to say so at length, for you to accept.</p></div>
<div id="content"><h1>Head &amp; tail</h1><p>First   paragraph with <b>bold</b> and&nbsp;more words
in two lines.</p><form><label>Name of yours</label><input></form><p>Second &lt;one&gt; is long enough, too &#233;.<aside>By the way, no.</aside></p>
<ul><li>An item of the text itself<li>Another item of the text</ul></div>
<section class="comments"><p>First! I have a lot to say about this, and more, and more.</p></section>
<footer><p>Imprint of the page and other things</p></footer></body></html>"""


def test_a_page_of_another_layout():
    assert extraction.main_text(PAGE, {}) == (
        "Head & tail\nFirst paragraph with bold and more words in two lines.\nSecond <one> is long enough, too é.\n"
        "An item of the text itself\nAnother item of the text")


@pytest.mark.parametrize("page", [
    '<body class="has-sidebar search-enabled"><nav>Home and away</nav><article>%s</article></body>',
    '<body id="nav"><div class="no-sidebar nav-open"><main class="page sidebar">%s</main></div></body>',
    '<body><div class="widget"><article class="post category-social comments-open">%s</article></div></body>',
    '<body><div class="search"><div id="banner"><main>%s</main></div></div><div class="left-sidebar">On the left side</div></body>',
    '<body><div class="layout nav-open">%s</div><div class="cookie-notice">Ok</div></body>',
    '<body><article>%s</article><section class="comments"><article class="comment">Me first, and at length</article></section></body>',
])
def test_names_that_only_hold_such_a_word(page):
    text = '<header class="entry-header"><h1>The title</h1></header><p>Several words of the text itself.</p>'
    text = text if "<article" in page or "<main" in page else "<h1>The title</h1><p>Several words of the text itself.</p>"
    assert extraction.main_text(page % text, {}) == "The title\nSeveral words of the text itself."


BODY = "<h1>The title</h1><p>Several words of the text itself, and a few more of them.</p>"
TEXT = "The title\nSeveral words of the text itself, and a few more of them."


@pytest.mark.parametrize("page", [
    '<body><form id="aspnet"><nav>Home and away</nav><article>%s</article><footer>Imprint</footer></form></body>',
    '<body><form method="post"><nav>Home</nav><div id="content">%s</div><button>Send</button></form></body>',
    '<body><aside><article>%s</article></aside><nav>Home</nav></body>',
    '<body><dialog open><fieldset><main>%s</main></fieldset></dialog></body>',
    '<body><form><div class="search"><main>%s<form><label>Your name and mail</label></form></main></div></form></body>',
    '<body><article>%s</article><section id="discussion"><article>Me first, and at length</article><article>No, me</article></section></body>',
    '<body><main>%s</main><aside><article>Read this as well, it is another long text of ours</article></aside></body>',
    '<body><article>%s</article><form><label>Write what you think of it here and send it to us all</label></form></body>',
])
def test_elements_wrapped_around_the_article(page):
    assert extraction.main_text(page % BODY, {}) == TEXT


def test_formulas_stand_in_their_line():
    math_text = '<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding="tex">x=2</annotation></semantics></math>'
    page = f"<article><p>Let {math_text} hold <svg><title>icon</title></svg>here<script>var a;</script>, too.</p><p>And <math><mi>y</mi></p></article>"
    assert extraction.main_text(page, {}) == "Let x=2 hold here, too.\nAnd y"


def test_deep_paths_differ():
    deep = lambda name: "<div class='abcdefgh'>" * 40 + f"<div class='{name}'>" + "<div>" * 60 + "words" + "</div>" * 101
    paths = {t.path for name in ("one", "two") for t in extraction.tokens(deep(name)) if t.words}
    assert len(paths) == 2 and all(len(p) <= extraction.LONG_PATH for p in paths)


@pytest.mark.parametrize("inner", ['<div class="ad">%s</div>', "<aside>%s</aside>", '<p>Seven.</p><div class="share"><p>%s</p></div>'])
def test_a_long_advert_inside_the_article(inner):
    advert = inner % ("buy this now " * 40)
    page = f"<body><article><p>A short lead.</p>{advert}<p>Body of some words.</p>{advert}<p>The end of it at last.</p></article></body>"
    lines = extraction.main_text(page, {}).split("\n")
    assert [x for x in lines if x != "Seven."] == ["A short lead.", "Body of some words.", "The end of it at last."]


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>only words here", "x"), (3, "u", "no tags at all", "x"),
            (4, "u", "<article><p>a</p></article>" * 3, "x"), (4, "u", "<article><p>a</p></article>" * 3, "x"),
            (5, "u", "<nav>" + "<li>x</li>" * 50 + "</nav>", "x"), (6, "u", "<p class='a", "x"), (7, "u", "<article><p>" + "w " * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extraction.extract(df).collect()]
    assert sorted(got, key=str)[:8] == sorted([
        (1, "", 0), (2, "", 0), (None, "only words here", 15), (3, "no tags at all", 14), (4, "a\na\na", 5), (4, "a\na\na", 5),
        (5, "", 0), (6, "", 0), (7, ("w " * 50_000).strip(), 99_999)], key=str)[:8]
    assert extraction.extract(df.limit(0)).count() == 0


def test_best_run():
    rng = np.random.default_rng(6)
    for _ in range(200):
        values = [float(x) for x in rng.integers(-4, 5, rng.integers(0, 12))]
        a, b = extraction.best_run(values)
        sums = [sum(values[i:j]) for i in range(len(values)) for j in range(i, len(values) + 1)]
        assert sum(values[a:b]) == max([0.0, *sums])


# --- vectors -----------------------------------------------------------------------------------


def simple_links(rows, cosine=0.95):
    unit = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    edges = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    degree = {i: sum(i in e for e in edges) for i, _ in rows}
    roots = simple_roots(edges)
    return degree, {i: roots.get(i, i) for i, _ in rows}


def vectors(rng, centres, each, dim, spread):
    out = []
    for c in range(centres):
        base = rng.normal(size=dim)
        out += [(base + rng.normal(size=dim) * s).astype(np.float32) for s in np.linspace(0, spread, each)]
    return out


@pytest.mark.parametrize("block,visitors", [(1024, 8192), (4, 3)])
def test_vector_links(spark, monkeypatch, block, visitors):
    """Pairs on either side of the limit, copies, and cells and crowds that are split."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "VISITORS", visitors)
    monkeypatch.setattr(embedding_dedup, "IN_CELL", 4)
    rng = np.random.default_rng(8)
    data = vectors(rng, 20, 12, 16, 0.35)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(1000 + i, [float(x) for x in data[i]]) for i in range(0, 40, 3)]
    rows += [(2000, [2 * float(x) for x in data[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(df).collect()}
    degree, root = simple_links(rows)
    found, want = sum(r["n_links"] for r in got.values()), sum(degree.values())
    assert all(got[i]["n_links"] <= degree[i] for i, _ in rows) and found >= 0.97 * want > 100
    if found == want:
        assert {i: r["component_id"] for i, r in got.items()} == root
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_vectors_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.1, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, node int, x int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(df).where("vec_id is not null").collect()))
    assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 1, 9), (10, 1, 9)]
    assert embedding_dedup.link_vectors(df).count() == 12
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0
    assert embedding_dedup.link_vectors(df.where("vec_id = 3")).collect()[0]["kept"]


def test_recall_of_the_index(spark):
    """Against brute force, at the least cosine that links."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_dedup.fit(x, 200_000)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * noise
    rows, cells = embedding_dedup.walk(index, x)
    home = embedding_dedup._cells(index, y)
    hit = np.zeros(len(x), bool)
    np.logical_or.at(hit, rows, cells == home[rows])
    assert hit.mean() > 0.95 and len(rows) / len(x) < 0.05 * len(index.first) * len(index.second)


def test_a_walk_visits_the_nearest_cells():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(50, 6))
    index = embedding_dedup.Index(rng.normal(size=(5, 3)), rng.normal(size=(4, 3)), 0.4)
    rows, cells = embedding_dedup.walk(index, x)
    da, db = (embedding_dedup.margins(h, c) for h, c in zip(embedding_dedup.halves(x), (index.first, index.second)))
    want = {(i, a * 4 + b) for i in range(50) for a in range(5) for b in range(4) if da[i, a] + db[i, b] <= 0.4}
    assert set(zip(rows.tolist(), cells.tolist())) == want


# --- anchors -----------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_equal_windows_have_equal_anchors(monkeypatch, block):
    monkeypatch.setattr(anchors, "BLOCK", block)
    rng = np.random.default_rng(11)
    data = bytes(rng.choice(list(b"ab"), 600))
    r = anchors.runs(anchors.byte_hashes(data), 12, 5)
    assert (np.concatenate([np.arange(f, f + n) for f, n in zip(r.first, r.windows)]) == np.arange(len(data) - 11)).all()
    seen = {}
    for f, n, p, h in zip(r.first.tolist(), r.windows.tolist(), r.place.tolist(), r.anchor.tolist()):
        for w in range(f, f + n):
            assert seen.setdefault(data[w:w + 12], (h, p - w)) == (h, p - w)


def test_words_of_any_length_are_hashed(monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK", 64)
    text = ("a bb  ccc\td " + "x" * 5000 + " a\nbb " + "y" * 70 + " " + "x" * 5000).encode()
    words, hashes = text.split(), anchors.word_hashes(text)
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    assert {h: w for h, w in zip(hashes.tolist(), words)} == {h: w for h, w in reversed(list(zip(hashes.tolist(), words)))}


# --- pipeline ----------------------------------------------------------------------------------


def test_stages_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "secret_scans", "source_mix", "packing"]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, before, SF), name)
        held[name] = docs
        if name != "packing":
            assert docs.columns == columns
        before = docs
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in held["language_id"].collect()}
    assert kept == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in held["simhash_near_dedup"].collect()} == simple_kept({i: texts[i] for i in kept})[0]
    clean = held["secret_scans"].collect()
    assert len(clean) == held["simhash_near_dedup"].count()
    assert not any(re.search(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r["text"]) for r in clean)
    mixed = held["source_mix"]
    words = mixed.select(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))).first()[0]
    assert abs(words - 1.5 * sum(len(r["text"].split()) for r in clean)) <= 2 * mixed.select("source").distinct().count()
    assert set(r["doc_id"] for r in held["packing"].collect()) == {r["doc_id"] for r in mixed.collect()}
    again = corpus_pipeline.run(spark, SF)
    assert again.groupBy().agg(F.sum("length")).first()[0] == held["packing"].groupBy().agg(F.sum("length")).first()[0]


def test_stages_of_awkward_rows(spark, docs, none):
    for start in (docs, none):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = written(stage(spark, rows, SF), name)
            assert name == "packing" or rows.columns == start.columns
        assert (rows.count() > 0) == (start is docs)




def test_sequences_follow_the_training_order(spark):
    """Also where the mix is several files of unequal size, which a scan takes largest first."""
    rows = [(i, sentence(f"w{i}x", 8 if i % 3 < 2 else 120), f"s{i % 3}", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        stages = dict(corpus_pipeline.STAGES)
        mixed = stages["source_mix"](spark, docs, SF).persist()
        want = [r["doc_id"] for r in mixed.collect()]
        files = written(mixed, "order")
        sizes = [r["count"] for r in files.groupBy(F.col("_metadata.file_path"), F.col("_metadata.file_size")).count().collect()]
        assert len(sizes) > 3 and [r["doc_id"] for r in files.collect()] != want
        pieces = stages["packing"](spark, files, SF).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    pieces.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["doc_id"] for r in pieces if r["start"] == 0] == want


# --- near copies -------------------------------------------------------------------------------


def simple_shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def simple_kept(texts):
    sets = {i: simple_shingles(t) for i, t in texts.items()}
    alike = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    roots = simple_roots(alike)
    return {i for i in texts if roots.get(i, i) == i}, alike


def test_one_of_all_near_copies_stays(spark):
    """Against brute-force Jaccard: edits on either side of the limit, a large group, shared passages."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    common, texts = words(60), []
    for base in [words(n) for n in (7, 20, 60, 150, 400)] + [words(150 - 60) + common for _ in range(10)]:
        for edits in (0, 1, 1, 2, 3, 4, 6):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = "edit"
            texts.append(" ".join(copy))
    crowd = words(200)
    for k in range(60):
        copy = list(crowd)
        for at in rng.integers(0, 200, 3):
            copy[at] = f"other{k}"
        texts.append(" ".join(copy))
    texts += ["one two", "One  two", "one three", texts[0].upper()]
    texts = dict(enumerate(texts))
    want, alike = simple_kept(texts)
    prints = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in texts.items()}
    far = [(a, b) for a, b in alike if (prints[a] ^ prints[b]).bit_count() > 3]
    assert len(far) > 100 and 10 < len(want) < len(texts) - 60
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, SF).collect()} == want


def test_pairs_grow_with_the_texts(spark):
    """Texts that share their opening and nothing else are compared with few others, however many they are."""
    rng = np.random.default_rng(3)
    opening = sentence("open", 40)
    compared = {}
    for n in (500, 1000, 2000):
        texts = [(i, opening + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 110))) for i in range(n)]
        rows = near_copies._texts(spark.createDataFrame(texts, "id long, text string"), "text")
        segments = near_copies.segment_plan(n)
        prints = near_copies.fingerprints(rows, segments).withColumn("root", F.col("id"))
        size = len(segments[0])
        met = near_copies._met(near_copies._keyed(prints, size, True), near_copies._keyed(prints, size, False))
        compared[n] = met.count(), near_copies._near(met, prints).count()
    # Of n (n - 1) / 2 pairs fewer meet than there are texts, and hardly any text is moved.
    assert all(met < n and near < n / 10 for n, (met, near) in compared.items())


def test_a_large_group_is_not_all_pairs(spark):
    """Each member of a group of near copies meets a few centres, not every other member."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = []
    for i in range(600):
        copy = list(base)
        for at in rng.integers(0, 300, 4):
            copy[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(copy)))
    texts = near_copies._texts(spark.createDataFrame(rows, "id long, text string"), "text")
    segments = near_copies.segment_plan(50_000)
    prints = near_copies.fingerprints(texts, segments).withColumn("root", F.col("id"))
    size = len(segments[0])
    entries, visits = near_copies._keyed(prints, size, False), near_copies._keyed(prints, size, True)
    assert near_copies._met(visits, entries).count() > 100_000
    assert near_copies._met(entries, near_copies._centres(entries, 0)).count() < near_copies.CENTRES * len(segments) * 600


def test_near_pairs_meet_as_planned(spark):
    """How many of the pairs at 0.8 or more meet in a segment, of texts edited to just above the limit."""
    rng = np.random.default_rng(8)
    sets, pairs = [], []
    for k in range(300):
        base = rng.integers(0, 2**63, 270, dtype=np.uint64)
        other = base.copy()
        other[:30] = rng.integers(0, 2**63, 30, dtype=np.uint64)  # Jaccard 240 / 300
        sets += [base, other]
        pairs.append((2 * k, 2 * k + 1))
    bits = [near_copies.votes(s) for s in sets]
    for texts in (600, 10**6):
        met = sum(any((bits[a][s] != bits[b][s]).sum() <= 1 for s in near_copies.segment_plan(texts)) for a, b in pairs)
        assert met >= 0.99 * len(pairs)


def test_texts_below_the_limit_are_not_all_pairs(spark, monkeypatch):
    """A large group of texts that mostly differ by more than near copies may: hardly any of the pairs that no centre
    joins meet or have their texts compared, and none that belongs together is left out."""
    rng = np.random.default_rng(14)
    base, texts = [f"w{x}" for x in rng.integers(0, 10**6, 150)], {}
    for i in range(400):
        copy = list(base)
        for at in rng.choice(150, 1 + i % 6, replace=False):
            copy[at] = f"edit{i}x{at}"
        texts[i] = " ".join(copy)
    met, moved, verified, near = [], [], near_copies.verified, near_copies._near

    def spied(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    def seen(*rest):
        rows = near(*rest)
        moved.append(rows.count())
        return rows

    monkeypatch.setattr(near_copies, "verified", spied)
    monkeypatch.setattr(near_copies, "_near", seen)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == simple_kept(texts)[0] and 100 < len(kept) < 350
    assert met[-1] < 10 * len(texts) and sum(moved) < 10 * len(texts)


def test_rarest_shingles_and_parities_of_near_copies():
    """Sets at 0.8 or more share one of their first fifths in any order, and differ in no more parities than shingles."""
    rng = np.random.default_rng(15)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    common = np.sort(rng.permutation(base)[:300])
    place, alike = rng.permutation(len(common)), 0
    for size, gone in [(n, g) for n in (1, 4, 5, 9, 10, 50, 200, 390) for g in range(0, 1 + n // 4)]:
        a = np.sort(rng.permutation(base)[:size])
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)]))
        odd = sum((int(x) ^ int(y)).bit_count() for x, y in zip(near_copies.parities(a).view(np.uint64), near_copies.parities(b).view(np.uint64)))
        assert odd <= len(np.setxor1d(a, b))
        if near_copies.alike(a, b):
            alike += 1
            assert 9 * len(np.setxor1d(a, b)) <= len(a) + len(b)
            assert np.intersect1d(near_copies.rarest(a, common, place), near_copies.rarest(b, common, place)).size
    assert alike > 40
    assert near_copies.rarest(base, common[:0], place[:0]).tolist() == base[:81].tolist()


def test_near_copies_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"].split()}
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r["doc_id"] for r in stage(spark, docs.where(F.col("doc_id").isin(list(texts))), SF).collect()}
    assert kept == simple_kept(texts)[0]

"""Main text of web pages: the run of tokens with the largest score."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.common import small_batches

SAMPLE = 2000  # labelled pages that the weights are learned from
FEATURES = 20_000  # most frequent paths and tags that have a weight of their own
LEAST_SEEN = 5  # words or tags from which a weight is learned rather than assumed
CHEAP, DEAR = 0.01, 3.0  # least and most that a tag costs

#: Fixed lists of HTML: elements that hold no text, whose text is no text, that stand in a line of
#: text, that another of their kind ends, and names and classes of what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas audio video head title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot munder "
    "mover semantics".split())
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
LABELS = frozenset(("article", "main"))
OUTSIDE = frozenset("nav footer aside form button select textarea menu dialog fieldset".split())
#: Of these the ones that may be wrapped around the page's article, and around most of a page's words.
WRAPPERS = frozenset("aside form dialog fieldset".split())
WIDE_WRAPPERS = frozenset("form fieldset".split())
OUTSIDE_WORDS = frozenset(
    "nav navigation navbar menu sidebar footer header masthead cookie cookies consent notice banner ad ads advert "
    "adverts advertisement sponsor sponsored promo comment comments discussion reply replies responses disqus share sharing social related breadcrumb "
    "breadcrumbs newsletter subscribe signup login search popup modal widget toolbar pagination".split())
#: What may stand beside one of these words in a name: "left-sidebar" is one, "has-sidebar" or "nav-open" is not.
PLAIN_WORDS = frozenset("site main top bottom left right primary secondary global box bar block list links buttons".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"'>]*(?:>|\Z)))*)(?:>|\Z)", re.DOTALL)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Za-z]+")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW | {"math"}}
MATH_NOTE = re.compile(r"<(annotation(?:-xml)?)\b.*?(?:</\1\s*>|\Z)", re.IGNORECASE | re.DOTALL)
MARKUP = re.compile(r"<[^>]*(?:>|\Z)")
LONG_PATH = 200  # letters above which a path stands as a hash


class Token(NamedTuple):
    """A tag (``name`` set) or a text node, with its path of block elements, whether an element that is no
    article or a label stands above it, the block it belongs to, and whether a class, id or role of
    something else stands above it."""

    name: str
    text: str
    words: int
    path: str
    outside: bool
    labelled: bool
    block: int
    named: bool


Weights = dict[str, tuple[int, int]]


def _signs(attrs: str) -> list[str]:
    if not attrs or "=" not in attrs:
        return []
    return sorted({w.lower() for m in ATTR.finditer(attrs) for w in NAME_PART.findall(m[1] or m[2] or m[3] or "")})


def _outside_name(attrs: str) -> bool:
    """Whether one whole class, id or role consists of a word of what is not the article and plain ones."""
    for m in ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = set(NAME_PART.findall(name))
            if not OUTSIDE_WORDS.isdisjoint(parts) and parts <= OUTSIDE_WORDS | PLAIN_WORDS:
                return True
    return False


def tokens(html: str) -> list[Token]:
    """Tags and text nodes of a page, see ``_tokens``. An element that holds the page's <main>, or an <article>
    if none stands elsewhere, is no sign of something else, whatever its name, nor if it is a form, a dialog or
    the like; nor is a form around most of the words of a page that marks no article elsewhere."""
    out, found = _tokens(html, frozenset())
    holders = found.mains if found.free or not found.articles else found.mains | found.articles
    if not found.free:
        holders |= {start for start, n in found.wide.items() if 2 * n > found.words}
    return _tokens(html, frozenset(holders))[0] if holders else out


class Found:
    """Starts of elements that would be something else but hold a <main> or an <article>, whether any of these
    stands elsewhere, the words under each form, and all words."""

    def __init__(self) -> None:
        self.mains: set[int] = set()
        self.articles: set[int] = set()
        self.free, self.words = False, 0
        self.wide: Counter[int] = Counter()


class Place(NamedTuple):
    """An open element: its tag, the path, whether something else stands above (1: only what may be wrapped
    around an article, 2: other elements), a label, a name of something else, and the starts of the elements
    and names among these."""

    tag: str = ""
    path: str = ""
    outside: int = 0
    labelled: bool = False
    named: bool = False
    starts: tuple[int, ...] = ()
    wide: tuple[int, ...] = ()


def _tokens(html: str, plain: frozenset[int]) -> tuple[list[Token], Found]:
    """Tags and text nodes in page order. Comments, declarations and the insides of scripts, styles
    and the like are left out; an end tag without a start tag is ignored; an element that is never
    closed ends with the element around it; formulas are text of the line they stand in. The elements that start
    at ``plain`` are passed over as signs of something else."""
    out: list[Token] = []
    stack: list[Place] = []
    block, at, end, top, found = 0, 0, len(html), Place(), Found()

    def text(raw: str) -> None:
        n = len(raw.split())
        if raw:
            here = stack[-1] if stack else top
            out.append(Token("", raw, n, here.path, bool(here.outside), here.labelled, block, here.named))
            found.words += n
            for start in here.wide:
                found.wide[start] += n

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        begin, at = m.span()
        if m["cdata"]:
            text(m["cdata"])
        if not m["name"]:
            continue
        name, attrs = m["name"].lower(), m["attrs"] or ""
        if name == "math":
            closing = None if m["end"] else RAW_END[name].search(html, at)
            if closing is not None:
                text(MARKUP.sub("", MATH_NOTE.sub("", html[at:closing.start()])))
                at = closing.end()
            continue
        if name in RAW and name not in ("head", "title"):
            pass  # stands in the line around it
        elif name not in INLINE:
            block += 1
        here = stack[-1] if stack else top
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == name), None)
            if depth is not None and not (name in INLINE and any(s.tag not in INLINE for s in stack[depth + 1:])):
                del stack[depth:]
            out.append(Token(name, "", 0, here.path, bool(here.outside), here.labelled, block, here.named))
            continue
        if name in RAW:
            closing = RAW_END[name].search(html, at)
            if name in ("head", "title", "svg", "object") and closing is None:
                continue  # its end tag may be left out: what follows is page text
            at = closing.end() if closing else end
            continue
        if name in SELF_ENDING:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag not in INLINE), None)
            if depth is not None and stack[depth].tag == name:
                del stack[depth:]
                here = stack[-1] if stack else top
        out.append(Token(name, "", 0, here.path, bool(here.outside), here.labelled, block, here.named))
        if name in VOID or attrs.rstrip().endswith("/") and name not in ("p", "div"):
            continue
        _, path, outside, labelled, named, starts, wide = here
        signs = _signs(attrs)
        inner = path
        if name in OUTSIDE and begin not in plain:
            outside = max(outside, 1 if name in WRAPPERS and not labelled else 2)
            if name in WRAPPERS:
                starts += (begin,)
                wide += (begin,) if name in WIDE_WRAPPERS else ()
        if name == "header" and not labelled:
            outside = 2
        if name in LABELS and outside < 2:
            if (named or outside) and not labelled:
                (found.mains if name == "main" else found.articles).update(starts)
            elif not outside:
                found.free = True
        if name in LABELS and not outside and not named:
            inner, labelled = "", True
        elif name not in INLINE and name not in ("html", "body"):
            inner = f"{path}>{name}" + "".join(f".{s}" for s in signs)
            inner = inner if len(inner) <= LONG_PATH else hashlib.md5(inner.encode("utf-8", "replace")).hexdigest()
        own = signs and begin not in plain and name not in LABELS and name not in ("html", "body")
        if own and not (name == "header" and labelled) and _outside_name(attrs):
            named, starts = True, starts + (begin,)
        stack.append(Place(name, inner, outside, labelled, named, starts, wide))
    return out, found


def page_counts(html: str) -> tuple[Counter, Counter]:
    """For a page that marks its article: words by path and tags by name, inside it and outside."""
    inside, beyond = Counter(), Counter()
    found = tokens(html)
    if any(t.labelled and t.words for t in found):
        for t in found:
            where = inside if t.labelled and not t.outside and not t.named else beyond
            if t.name and t.name not in LABELS:
                where[f"<{t.name}"] += 1
            elif t.words:
                where[t.path] += t.words
    return inside, beyond


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Counts inside and outside the article by path and tag, from at most ``sample`` pages that mark
    theirs: those whose page_id has the smallest hashes. The driver gets the sums of the ``FEATURES``
    most frequent."""
    ids = pages.where("lower(html) like '%<article%' or lower(html) like '%<main%'").select("page_id")
    ids = ids.where("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, beyond = Counter(), Counter()
        for batch in batches:
            for html in batch["html"]:
                a, b = page_counts(html)
                inside.update(a)
                beyond.update(b)
        names = list(inside | beyond)
        if not names:
            return
        yield pd.DataFrame({"feature": names, "inside": [inside[n] for n in names], "beyond": [beyond[n] for n in names]})

    rows = pages.join(ids, "page_id", "left_semi").where("html is not null").select("html").mapInPandas(
        count, "feature string, inside long, beyond long")
    rows = rows.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("beyond").alias("beyond"))
    top = rows.orderBy(F.desc(F.col("inside") + F.col("beyond")), "feature").limit(FEATURES).collect()
    return {r["feature"]: (r["inside"], r["beyond"]) for r in top}


def _odds(weights: Weights, feature: str) -> float | None:
    inside, beyond = weights.get(feature, (0, 0))
    if inside + beyond < LEAST_SEEN:
        return None
    return math.log((inside + 0.5) / (beyond + 0.5))


def score(token: Token, weights: Weights) -> float:
    """A word counts 1 where its path was mostly met inside articles and -1 where outside; a tag never
    counts more than ``-CHEAP``, and less the more it is met outside. What was never met counts as its
    names say. Text and tags of something else inside an article cost the least: they are left out
    afterwards, and must not end the run."""
    if token.labelled and (token.outside or token.named):
        return -CHEAP
    if token.name:
        odds = 0.0 if token.name in LABELS else _odds(weights, f"<{token.name}")
        odds = -0.3 if odds is None else odds
        return -min(DEAR, max(CHEAP, -odds))
    if not token.words:
        return 0.0
    odds = _odds(weights, token.path)
    good = not token.outside and (not token.named if odds is None else odds > 0)
    return float(token.words if good else -token.words)


def best_run(values: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, the first and longest of equals; (0,
    0) where no sum is above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0 and v > 0:
            total, start = 0.0, i
        total += v
        if total > best or total == best and span[0] == start:
            best, span = total, (start, i + 1) if total > 0 else span
    return span


def main_text(html: str | None, weights: Weights) -> str:
    """The article of a page: text nodes of the best run whose own score is not below zero, character
    references decoded, white space turned into one space within a block, blocks joined by line
    breaks."""
    if not html:
        return ""
    found = tokens(html)
    values = [score(t, weights) for t in found]
    a, b = best_run(values)
    blocks: dict[int, list[str]] = {}
    for t, v in zip(found[a:b], values[a:b]):
        if v >= 0 and not t.name and not t.outside:
            blocks.setdefault(t.block, []).append(t.text)
        elif t.name == "br":
            blocks.setdefault(t.block, []).append(" ")
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    The whole html is read. A NULL or empty page has an empty text; a NULL id or url is kept; repeated
    rows stay repeated; an empty table gives no rows; other columns are ignored. Without ``weights``
    they are learned from the pages themselves.
    """
    small_batches(pages)
    weights = learn(pages) if weights is None else weights

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h, weights) for h in batch], dtype=object)

    out = pages.select("page_id", "url", text("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))

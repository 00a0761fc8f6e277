"""Passages of words that repeat anywhere in a corpus, by a compacted graph of word pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from plyforge.llm.anchors import Rolling, runs, word_hashes
from plyforge.llm.common import small_batches, written

WINDOW = 35  # words that must repeat
PIECE = 12  # words of an anchor
TOGETHER = 500  # documents whose edges are handed on together
NO_ID = -(2**63)  # stands for a NULL doc_id inside


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pd.Series([squeeze((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, did, rid, text): rows that agree in did and rid are the same document twice."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("did"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"), "text")


def edges(docs: DataFrame, window: int, piece: int) -> DataFrame:
    """(did, rid, at, n, anchor, node): the edges of the graph as they stand in the documents. An edge is
    a run of ``n`` windows from word ``at`` on that share an anchor; ``node`` tells its whole sequence of
    words, ``anchor`` the piece it is anchored at."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (b.iloc[i:i + TOGETHER] for b in batches for i in range(0, len(b), TOGETHER)):
            found = [runs(word_hashes((t or "").encode("utf-8", "surrogatepass")), window, piece) for t in part["text"]]
            counts = [len(r.first) for r in found]
            if not sum(counts):
                continue
            joined = [np.concatenate(x) for x in zip(*found)]
            yield pd.DataFrame({
                "did": np.repeat(part["did"].to_numpy(), counts), "rid": np.repeat(part["rid"].to_numpy(), counts),
                "at": joined[0].astype(np.int32), "n": joined[1].astype(np.int32),
                "anchor": joined[3].view(np.int64), "node": joined[4].view(np.int64)})

    return docs.select("did", "rid", "text").mapInPandas(listed, "did long, rid long, at int, n int, anchor long, node long")


def compacted(rows: DataFrame) -> DataFrame:
    """(node, path, off): paths of repeated edges along which nothing branches, compacted.

    ``rows`` (did, rid, at, n, node) are all places of the repeated edges. Two edges are one path where
    every place of the first is followed by the second and every place of the second is preceded by the
    first; the end of a document or an edge that does not repeat is a branch like any other, so that a
    path never closes to a ring. Each edge then finds the head of its path and its distance in words by
    pointer doubling: a join per round, over the edges that are not there yet, and as many rounds as the
    logarithm of the longest path.
    """
    # Places of a document that occurs twice are the same places.
    rows = rows.repartition("did", "rid").dropDuplicates(["did", "rid", "at"])
    order = Window.partitionBy("did", "rid").orderBy("at")
    follows = F.lead("at").over(order) == F.col("at") + F.col("n")
    precedes = F.lag("at").over(order) + F.lag("n").over(order) == F.col("at")
    near = rows.select("node", "n", F.when(follows, F.lead("node").over(order)).alias("after"),
                       F.when(precedes, F.lag("node").over(order)).alias("before"))
    every = F.count("*")
    alone = lambda c: F.when((F.count(c) == every) & (F.min(c) == F.max(c)), F.min(c))
    nodes = near.groupBy("node").agg(F.min("n").alias("n"), alone("after").alias("after"), alone("before").alias("before"))
    nodes = written(nodes, "graph-edges")
    left = nodes.where("after is not null").select(F.col("node").alias("before"), F.col("n").alias("step"),
                                                   F.col("after").alias("node"))
    linked = nodes.select("node", "before").join(left, ["node", "before"]).where("node != before")
    moving = written(linked.select("node", F.col("before").alias("to"), F.col("step").cast("long").alias("off")), "graph-links")
    heads = nodes.select("node").join(moving.select("node"), "node", "left_anti")
    ready = written(heads.select("node", F.col("node").alias("path"), F.lit(0).cast("long").alias("off")), "graph-paths")
    while not moving.isEmpty():
        known = ready.select(F.col("node").alias("to"), "path", F.col("off").alias("more"))
        there = moving.join(known, "to").select("node", "path", (F.col("off") + F.col("more")).alias("off"))
        going = moving.join(known.select("to"), "to", "left_anti")
        ahead = moving.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("off").alias("more"))
        off = (F.col("off") + F.col("more")).alias("off")
        moving = written(going.join(ahead, "to").select("node", F.col("next").alias("to"), off), "graph-links")
        ready = ready.unionByName(written(there, "graph-paths"))
    return ready


def _windows(rows: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(did, rid, at, anchor, hash) of each window of the edges ``rows`` (did, rid, at, n, anchor), read at
    their places in the documents."""
    # The lists of one group are filled together, so that they agree in order.
    asked = rows.groupBy("did", "rid").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("at", "n", "anchor")])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for did, rid, data, at, n, anchor in zip(*(batch[c] for c in ("did", "rid", "z", "ats", "ns", "anchors"))):
                rolling = Rolling(word_hashes(_unpacked(data)))
                n = np.asarray(n, np.int64)
                at = np.repeat(np.asarray(at, np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"did": did, "rid": rid, "at": at.astype(np.int32), "anchor": np.repeat(anchor, n),
                                    "hash": rolling.of(at, at + window).view(np.int64)})

    found = docs.join(asked, ["did", "rid"])
    return found.mapInPandas(read, "did long, rid long, at int, anchor long, hash long")


def repeated_spans(docs: DataFrame, texts: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(did, rid, a, b): stretches of window starts, from a to before b, at which a window stands that
    also starts elsewhere. ``docs`` is what ``keyed`` gives, ``texts`` has each document once, packed.

    Edges are looked up by their anchors, of which partial counts are shuffled. Where all edges at an
    anchor that occurs again are the same, all their windows repeat. Where they differ, the same edges are
    counted, and the windows of one place of each different edge are compared at their coordinates.
    """
    places = written(edges(docs, window, piece), "graph-places")
    again = places.groupBy("anchor").agg(F.count("*").alias("places"), (F.min("node") != F.max("node")).alias("mixed"))
    # Written, so that the join below reads both sides from a shuffle and a crowded anchor can be split.
    again = written(again.where("places > 1").select("anchor", "mixed"), "graph-anchors")
    rows = written(places.join(again, "anchor"), "graph-repeats")
    mixed = rows.where("mixed").groupBy("anchor", "node").agg(
        F.count("*").alias("places"), F.min(F.struct("did", "rid", "at", "n")).alias("one"))
    mixed = written(mixed, "graph-mixed")
    same = mixed.where("places > 1").select("anchor", "node")
    whole = rows.where("not mixed").drop("mixed").unionByName(
        rows.where("mixed").drop("mixed").join(same, ["anchor", "node"], "left_semi"))
    whole = written(whole.select("did", "rid", "at", "n", "node"), "graph-whole")
    paths = compacted(whole)
    base = (F.col("at") - F.col("off")).alias("base")
    long_spans = whole.join(paths, "node").groupBy("did", "rid", "path", base).agg(
        F.min("at").alias("a"), F.max(F.col("at") + F.col("n")).alias("b")).select("did", "rid", "a", "b")
    seen = written(_windows(mixed.select("one.*", "anchor"), texts, window), "graph-windows")
    twice = seen.groupBy("anchor", "hash").agg(F.count("*").alias("places")).where("places > 1").select("anchor", "hash")
    twice = written(twice, "graph-twice")
    short_spans = seen.join(twice, ["anchor", "hash"], "left_semi").select(
        "did", "rid", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    return long_spans.unionByName(short_spans)


def covered(n: int, begins: np.ndarray, stops: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, np.minimum(stops - 1 + window, n), -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of ``docs`` (doc_id, text): the words that are left,
    joined by one space.

    Each word goes that is covered by a window of ``window`` words whose sequence also starts anywhere
    else, in the same document or another; windows are judged on the input. A NULL or blank text has no
    words; a text shorter than a window loses nothing; of rows that occur twice all windows repeat; a NULL
    doc_id is kept as it is; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs)
    rows = keyed(docs)
    texts = rows.select("did", "rid", packed("text").alias("z"))
    spans = repeated_spans(rows, texts, window, piece)
    per = spans.groupBy("did", "rid").agg(F.collect_list("a").alias("begins"), F.collect_list("b").alias("stops"))
    joined = rows.select("doc_id", "did", "rid", packed("text").alias("z")).join(per, ["did", "rid"], "left")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(data: pd.Series, begins: pd.Series, stops: pd.Series) -> pd.DataFrame:
        out = []
        for z, a, b in zip(data, begins, stops):
            words, gone = _unpacked(z).split(), 0
            if a is not None and len(a):
                drop = covered(len(words), np.asarray(a, np.int64), np.asarray(b, np.int64), window)
                gone = int(drop.sum())
                words = [w for w, d in zip(words, drop.tolist()) if not d]
            out.append((len(words) + gone, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return joined.select("doc_id", cut("z", "begins", "stops").alias("cut")).select("doc_id", "cut.*")

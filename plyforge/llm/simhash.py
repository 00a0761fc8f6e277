"""Near-duplicate documents by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.llm import near_copies
from plyforge.llm.common import small_batches, written
from plyforge.llm.components import components

SEED = 42
BLOCK = 65_536  # shingles hashed at a time: bounds the memory that one long text takes


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a text; 0 where it has no word.

    ASCII letters are lower-cased, words are runs of anything but ASCII white space, and every
    shingle of ``shingle`` words counts as often as it occurs (a text of fewer words is one
    shingle). A bit is set where more than half the shingles' XXH64 values have it.
    """
    # bytes.lower() and bytes.split() know ASCII only, which is what is asked for.
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) per document: its SimHash as a long."""

    small_batches(docs)

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return docs.select("doc_id", hashed(text).alias("fp"))


def fingerprint_text(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _half(fp: Column, which: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if which == 0 else fp).bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(value: Column, radius: int) -> Column:
    """All 32-bit values within ``radius`` bits of ``value``."""
    masks = [0]
    if radius >= 1:
        masks += [1 << i for i in range(32)]
    if radius >= 2:
        masks += [(1 << i) | (1 << j) for i in range(32) for j in range(i)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def links(fps: DataFrame, hot: int = 256) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that connect all those at three or
    fewer differing bits, and only those.

    Two halves of 32 bits: where at most 3 bits differ, one half differs in at most one. Each
    fingerprint is entered into the table of either half under that half's value, looks up its own
    value and those with one of its zero bits set (the other direction is found from the other
    side), and the full distance of what it meets is verified.

    A value that more than ``hot`` fingerprints share is not looked up in this way, which would make
    all pairs. Its members and visitors meet at the points of the *other* half instead: a member
    enters all points within 1 (as a near one) and 2 bits, a visitor, one bit away already, those
    within 1. Any two at distance 3 or less share such a point, and all that meet at a point are
    linked with the smallest near member there, from which none is farther than 3 bits. The rows are
    in proportion to the members, however many they are.
    """
    fps = fps.select("fp")
    other = {0: _half(F.col("fp"), 1), 1: _half(F.col("fp"), 0)}
    members = [fps.select(F.lit(h).alias("h"), _half(F.col("fp"), h).alias("v"), "fp") for h in (0, 1)]
    entries = members[0].unionByName(members[1])

    def asked(h: int) -> DataFrame:
        value = _half(F.col("fp"), h)
        bits = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
        more = F.filter(F.transform(bits, lambda m: value.bitwiseOR(m)), lambda x: x != value)
        return fps.select(F.lit(h).alias("h"), F.explode(F.concat(F.array(value), more)).alias("v"), "fp")

    visits = asked(0).unionByName(asked(1))
    crowded = entries.groupBy("h", "v").count().where(F.col("count") > hot).select("h", "v")
    crowded = written(crowded, "simhash-hot")
    calm_entries = entries.join(crowded, ["h", "v"], "left_anti")
    met = visits.withColumnRenamed("fp", "a").join(calm_entries.withColumnRenamed("fp", "b"), ["h", "v"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3
    plain = met.where((F.col("a") != F.col("b")) & near).select("a", "b")
    if crowded.isEmpty():
        return plain

    def points(rows: DataFrame, radius: int, near_member: bool) -> DataFrame:
        rest = F.when(F.col("h") == 0, other[0]).otherwise(other[1])
        return rows.select("h", "v", F.explode(_ball(rest, radius)).alias("z"), "fp",
                           F.lit(near_member).alias("near"))

    inside = entries.join(crowded, ["h", "v"])
    outside = visits.join(crowded, ["h", "v"]).where(_half(F.col("fp"), 0) != F.col("v")).where("h = 0").unionByName(
        visits.join(crowded, ["h", "v"]).where(_half(F.col("fp"), 1) != F.col("v")).where("h = 1"))
    met = points(inside, 1, True).unionByName(points(inside, 2, False)).unionByName(points(outside, 1, False))
    keys = ["h", "v", "z"]
    centre = met.where("near").groupBy(*keys).agg(F.min("fp").alias("a"))
    star = met.join(centre, keys).where("a != fp").select("a", F.col("fp").alias("b")).distinct()
    return plain.unionByName(star)


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3, hot: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: its fingerprint and the smallest doc_id
    that can be reached over links of at most 3 differing bits, its own included.

    Rows with equal fingerprints are one node, so that copies are never paired. A NULL or blank text
    has fingerprint zero and is linked like any other; a NULL doc_id keeps its row, and its component
    is the smallest id of the others (NULL if there is none); repeated rows stay repeated; an empty
    table gives no rows; other columns are ignored.
    """
    prints = written(with_fingerprints(docs, text, shingle), "simhash")
    return _named(prints, components(links(prints.select("fp").distinct(), hot), "simhash-links"))


def _named(prints: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp), with the groups (node, root) of their nodes ``fp``."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = nodes.join(groups, nodes["fp"] == groups["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-groups")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest doc_id, and
    one row where several rows carry that id. A row without an id cannot be named and stays. Components
    are those of ``near_copies``: 5-word shingles at Jaccard 0.8 or more, all texts without a word alike."""
    prints = written(docs.select("doc_id", near_copies.node(F.col(text)).alias("fp")), "near-nodes")
    found = _named(prints, near_copies.groups(docs, text)).where("doc_id = component_id")
    found = written(found.groupBy("doc_id").agg(F.count("*").alias("rows")), "simhash-kept")
    single, repeated = found.where("rows = 1").select("doc_id"), found.where("rows > 1").select("doc_id")
    # The ids kept grow with the documents: they are never sent to all tasks, at any size. Repeated ids are
    # few as a rule; only their rows are gathered to take one of each.
    return (docs.join(single.hint("merge"), "doc_id", "left_semi")
            .unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
            .unionByName(docs.where("doc_id is null")).select(*docs.columns))

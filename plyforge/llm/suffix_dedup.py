"""Byte strings that an earlier document also holds, by a logarithmic family of suffix indexes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.anchors import U, Rolling, Runs, byte_hashes, runs
from plyforge.llm.common import small_batches, written

LENGTH = 50  # bytes that must match
PIECE = 16  # bytes by which suffixes are chosen and first ordered
BATCH = 1 << 20  # bytes of a batch of documents, a block of ``anchors`` at most
IN_BUCKET = 250_000  # suffixes of one bucket of the index, about
WINDOWS_IN_BUCKET = 250_000
CROWD = 20_000  # suffixes of one key whose surroundings may meet in one group
FANOUT = 8  # levels of one size that merge into one of the next
LAST = 2**63 - 1  # stands for a NULL doc_id inside: such a document comes after all others


class Level(NamedTuple):
    """A part of the index, sorted by key, then by the rest: each different suffix with the smallest id
    of a document that holds it."""

    key: np.ndarray
    rest: np.ndarray
    doc: np.ndarray


def merged(levels: list[Level]) -> Level:
    """One level of several: the smallest id of equals stays."""
    key, rest, doc = (np.concatenate(x) for x in zip(*levels))
    order = np.lexsort((doc, rest, key))
    key, rest, doc = key[order], rest[order], doc[order]
    first = np.concatenate(([True], (key[1:] != key[:-1]) | (rest[1:] != rest[:-1]))) if len(key) else np.empty(0, bool)
    return Level(key[first], rest[first], doc[first])


class Family:
    """Indexes of sizes that grow geometrically: a batch becomes a level of the lowest size; as soon as
    there are ``FANOUT`` levels of one size they are merged into one of the next, so that each suffix is
    merged as often as the logarithm of their number."""

    def __init__(self) -> None:
        self.sizes: list[list[Level]] = []

    def add(self, batch: Level) -> None:
        i = 0
        while True:
            if len(self.sizes) == i:
                self.sizes.append([])
            self.sizes[i].append(batch)
            if len(self.sizes[i]) < FANOUT:
                return
            batch, self.sizes[i] = merged(self.sizes[i]), []
            i += 1

    def levels(self) -> list[Level]:
        return [level for size in self.sizes for level in size]

    def settle(self) -> None:
        """Merge what is left of all sizes, for scans after the last batch."""
        if len(self.levels()) > 1:
            self.sizes = [[merged(self.levels())]]

    def scan(self, batch: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of a batch, or of several: the smallest id of a document that holds it, and how
        many others have the same key. It is looked up in each sorted level."""
        least, other = np.full(len(batch.key), LAST, np.int64), np.zeros(len(batch.key), np.int64)
        for level in self.levels():
            low = np.searchsorted(level.key, batch.key, "left")
            high = np.searchsorted(level.key, batch.key, "right")
            hit = np.zeros(len(low), bool)
            at, rows = low.copy(), np.flatnonzero(low < high)
            crowded = rows[(high - low)[rows] > 16]
            for i in crowded.tolist():  # a key with many suffixes: these are sorted
                a, b = int(low[i]), int(high[i])
                k = a + int(np.searchsorted(level.rest[a:b], batch.rest[i]))
                if k < b and level.rest[k] == batch.rest[i]:
                    hit[i], least[i] = True, min(least[i], level.doc[k])
            rows = rows[(high - low)[rows] <= 16]
            while len(rows):
                same = level.rest[at[rows]] == batch.rest[rows]
                found = rows[same]
                hit[found] = True
                least[found] = np.minimum(least[found], level.doc[at[found]])
                rows = rows[~same]
                at[rows] += 1
                rows = rows[at[rows] < high[rows]]
            other += high - low - hit
        return least, other


def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    if not _codecs:
        _codecs.append((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _codecs[0]


_codecs: list[tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]] = []


def _squeeze(*arrays: np.ndarray) -> bytes:
    return _zstd()[0].compress(b"".join(a.tobytes() for a in arrays))


def _open(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def _level_bytes(level: Level) -> bytes:
    steps = np.diff(level.key, prepend=level.key.dtype.type(0))
    return _squeeze(steps, level.rest, level.doc)


def _level(data: bytes, n: int, key: type) -> Level:
    raw, wide = _open(data), np.dtype(key).itemsize * n
    return Level(np.cumsum(np.frombuffer(raw[:wide], key), dtype=key), np.frombuffer(raw[wide:wide + 8 * n], U),
                 np.frombuffer(raw[wide + 8 * n:], np.int64))


def batches_of(docs: DataFrame) -> DataFrame:
    """(batch, docs, sizes, z): the documents as they come, gathered into batches of about ``BATCH`` bytes
    (a longer one is alone): their ids, their sizes, and their bytes, packed."""

    def gather(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pd.DataFrame:
            z = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pd.DataFrame({"batch": [number], "docs": [np.array(ids, np.int64)],
                                 "sizes": [np.array([len(t) for t in texts], np.int64)], "z": [z]})

        for part in rows:
            for doc, text in zip(part["doc"], part["text"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                if ids and size + len(data) > BATCH:
                    yield out()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc)
                texts.append(data)
                size += len(data)
        if ids:
            yield out()

    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text")
    return rows.mapInPandas(gather, "batch long, docs array<long>, sizes array<long>, z binary")


class _Batch:
    """A batch unpacked, with its runs; the different ones in the order in which they are indexed."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, z: bytes, length: int, piece: int, bits: int) -> None:
        self.data, self.docs, self.sizes = _open(z), np.asarray(docs, np.int64), np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.hashes = byte_hashes(self.data)
        self.runs: Runs = runs(self.hashes, length, piece, self.sizes)
        r = self.runs
        self.of = self.docs[np.searchsorted(self.ends, r.first, side="right")] if len(r.first) else np.empty(0, np.int64)
        self.order = np.lexsort((self.of, r.whole, r.anchor))
        anchor, whole, doc = r.anchor[self.order], r.whole[self.order], self.of[self.order]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))) if len(anchor) else np.empty(0, bool)
        self.number = np.cumsum(new) - 1  # of each run in order among the different ones
        self.anchor, self.whole, self.doc = anchor[new], whole[new], doc[new]
        self.one = self.order[new]  # the run of each that stands for it: of the smallest id
        # The first bits of the anchor are the bucket, the next 32 the key within it.
        self.bucket = (self.anchor >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.anchor), np.int64)
        self.key = ((self.anchor << U(bits)) >> U(32)).astype(np.uint32)

    def buckets(self) -> Iterator[tuple[int, slice]]:
        yield from _stretches(self.bucket)


def _stretches(sorted_numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.concatenate(([True], sorted_numbers[1:] != sorted_numbers[:-1]))) if len(sorted_numbers) else []
    for a, b in zip(edges, [*edges[1:], len(sorted_numbers)]):
        yield int(sorted_numbers[a]), slice(int(a), int(b))


def _bits(n: float, each: int) -> int:
    return max(2, int(np.ceil(np.log2(max(1.0, n / each)))))


def _entries(batches: DataFrame, length: int, piece: int, bits: int) -> DataFrame:
    """(bucket, batch, n, level): each batch's suffix index, divided by bucket."""

    def index(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            for number, docs, sizes, z in zip(part["batch"], part["docs"], part["sizes"], part["z"]):
                b = _Batch(docs, sizes, z, length, piece, bits)
                out = [(k, number, s.stop - s.start, _level_bytes(Level(b.key[s], b.whole[s], b.doc[s])))
                       for k, s in b.buckets()]
                if out:
                    yield pd.DataFrame(out, columns=["bucket", "batch", "n", "level"])

    return batches.mapInPandas(index, "bucket long, batch long, n long, level binary")


def _family(group: pd.DataFrame, key: type) -> tuple[Level, Family]:
    """All batches of a bucket one after the other, and the family that they have become one by one. A
    batch may hold smaller ids than one before it, so that all are scanned when the last is in."""
    batches = [_level(level, n, key) for level, n in zip(group["level"], group["n"])]
    family = Family()
    for batch in batches:
        family.add(batch)
    family.settle()
    return Level(*(np.concatenate(x) for x in zip(*batches))), family


def _marks(group: pd.DataFrame, marks: np.ndarray) -> pd.DataFrame:
    out, at = [], 0
    for bucket, batch, n in zip(group["bucket"], group["batch"], group["n"]):
        own = marks[at:at + n].astype(np.uint8)
        at += n
        if own.any():
            out.append((batch, bucket, _squeeze(own)))
    return pd.DataFrame(out, columns=["batch", "bucket", "marks"])


def _scanned(entries: DataFrame) -> DataFrame:
    """(batch, bucket, marks): of each suffix of a batch's part of a bucket 1 where a smaller id holds all
    of it, 2 where none does but others share its key, 3 where more than ``CROWD`` do, else 0. Parts
    without a mark are left out."""

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("batch", ignore_index=True)
        own, family = _family(group, np.uint32)
        least, other = family.scan(own)
        return _marks(group, np.where(least < own.doc, 1, np.where(other > CROWD, 3, np.where(other, 2, 0))))

    return entries.groupBy("bucket").applyInPandas(scan, "batch long, bucket long, marks binary")


def _gathered(marks: DataFrame, name: str) -> DataFrame:
    """The marks of a batch together; lists of one group agree in order."""
    return marks.groupBy("batch").agg(F.collect_list("bucket").alias(f"{name}_buckets"),
                                      F.collect_list("marks").alias(f"{name}_marks"))


def _spread(total: int, buckets: Iterator[tuple[int, slice]], got_buckets, got_marks) -> np.ndarray:
    out = np.zeros(total, np.uint8)
    if got_buckets is not None and len(got_buckets):
        at = dict(buckets)
        for bucket, marks in zip(got_buckets, got_marks):
            out[at[bucket]] = np.frombuffer(_open(marks), np.uint8)
    return out


class _Windows:
    """The windows of a batch's runs that share a crowded key in part, and the different ones in the order in
    which they are compared."""

    def __init__(self, b: _Batch, marks: np.ndarray, length: int, bits: int) -> None:
        # All places of such a run that belong to its smallest id; the others go as a whole.
        chosen = b.order[(marks[b.number] == 3) & (b.of[b.order] == b.doc[b.number])] if len(b.order) else b.order
        n = b.runs.windows[chosen]
        self.at = _spelled(b.runs.first[chosen], n)
        hashes = Rolling(b.hashes).of(self.at, self.at + length) if len(self.at) else np.empty(0, U)
        # A second hash, that of the anchor, tells apart what the first may confuse.
        anchor, doc = np.repeat(b.runs.anchor[chosen], n), np.repeat(b.of[chosen], n)
        self.order = np.lexsort((doc, anchor, hashes))
        hashes, anchor, doc = hashes[self.order], anchor[self.order], doc[self.order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (anchor[1:] != anchor[:-1]))) if len(hashes) else np.empty(0, bool)
        self.number = np.cumsum(new) - 1
        self.hash, self.anchor, self.doc = hashes[new], anchor[new], doc[new]
        self.bucket = (self.hash >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.hash), np.int64)


def _spelled(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of n numbers for each."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class _Surroundings:
    """The runs of a batch that share a key with a bounded number of others: of each different one the bytes
    of all its windows, in the order of the index, and where each one's windows begin among all."""

    def __init__(self, b: _Batch, marks: np.ndarray, length: int) -> None:
        self.chosen = np.flatnonzero(marks == 2)
        runs_ = b.one[self.chosen]
        self.n, self.first = b.runs.windows[runs_], b.runs.first[runs_]
        self.size, self.doc, self.bucket = self.n + length - 1, b.doc[self.chosen], b.bucket[self.chosen]
        self.begin = np.cumsum(self.n) - self.n
        self.data = b.data

    def bytes_of(self, s: slice) -> bytes:
        raw = np.frombuffer(self.data, np.uint8)[_spelled(self.first[s], self.size[s])]
        return _squeeze(self.n[s].astype(np.uint8), self.doc[s], raw)

    def places(self, b: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """First window of each place of these runs that belongs to its smallest id, and which run it is."""
        of = np.full(len(b.key), -1)
        of[self.chosen] = np.arange(len(self.chosen))
        which = of[b.number]
        mine = (which >= 0) & (b.of[b.order] == b.doc[b.number])
        return b.runs.first[b.order[mine]], which[mine]


def _part_entries(batches: DataFrame, length: int, piece: int, bits: int, window_bits: int) -> DataFrame:
    """(kind, bucket, batch, n, part): what has to be compared window by window, as the bytes around a run
    (kind 0, by the bucket of its key) or as hashes of windows (kind 1, by these)."""

    def index(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            for number, docs, sizes, z, of, marks in zip(*(part[c] for c in ("batch", "docs", "sizes", "z", "run_buckets", "run_marks"))):
                b = _Batch(docs, sizes, z, length, piece, bits)
                run = _spread(len(b.key), b.buckets(), of, marks)
                around, w = _Surroundings(b, run, length), _Windows(b, run, length, window_bits)
                out = [(0, k, number, s.stop - s.start, around.bytes_of(s)) for k, s in _stretches(around.bucket)]
                out += [(1, k, number, s.stop - s.start, _level_bytes(Level(w.hash[s], w.anchor[s], w.doc[s])))
                        for k, s in _stretches(w.bucket)]
                if out:
                    yield pd.DataFrame(out, columns=["kind", "bucket", "batch", "n", "part"])

    return batches.mapInPandas(index, "kind int, bucket long, batch long, n long, part binary")


def _least_of_equals(first: np.ndarray, second: np.ndarray, doc: np.ndarray) -> np.ndarray:
    order = np.lexsort((doc, second, first))
    a, b = first[order], second[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)
    out = np.empty(len(doc), np.int64)
    out[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _compared(entries: DataFrame, length: int) -> DataFrame:
    """(kind, batch, bucket, marks): 1 for each window that a document with a smaller id holds."""

    def windows_of(part: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = _open(part)
        count = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
        doc, data = np.frombuffer(raw[n:9 * n], np.int64), raw[9 * n:]
        size = count + length - 1
        at = _spelled(np.cumsum(size) - size, count)
        return Rolling(byte_hashes(data)).of(at, at + length), Rolling(byte_hashes(data, 1)).of(at, at + length), np.repeat(doc, count)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        kind = int(group["kind"].iloc[0])
        if kind:
            levels = [_level(part, n, U) for part, n in zip(group["part"], group["n"])]
            counts = group["n"].to_numpy()
        else:
            levels = [windows_of(part, n) for part, n in zip(group["part"], group["n"])]
            counts = np.array([len(x[0]) for x in levels])
        first, second, doc = (np.concatenate(x) for x in zip(*levels))
        out = _marks(group.assign(n=counts), _least_of_equals(first, second, doc) < doc)
        out.insert(0, "kind", kind)
        return out

    return entries.groupBy("kind", "bucket").applyInPandas(compare, "kind int, batch long, bucket long, marks binary")


def remove_earlier(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of ``docs`` (doc_id, text): the bytes that are
    left.

    Each byte goes that is covered by a string of ``length`` bytes that also starts in a document with a
    smaller doc_id; strings are judged on the input and never reach over the end of a document. A suffix
    of a document enters the index where a run of windows begins (see ``anchors``): every string of the
    length has one near its beginning, and equal strings have the same. The index is divided by the first
    bytes of the suffixes, hashed; in each part the batches become a family of levels, against which each
    batch is scanned. Suffixes that agree for a whole run are settled there. Of those that part ways within
    it the bytes around them meet by key and are compared window by window; where more than ``CROWD`` share
    a key, hashes of their windows meet instead, each by its own value, so that no key is gathered.

    A NULL text is empty; a text shorter than ``length`` loses nothing. A document without an id comes
    after all others; rows that share an id do not count for each other. An empty table gives no rows;
    other columns are ignored.
    """
    small_batches(docs)
    batches = written(batches_of(docs), "suffix-batches")
    total = batches.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = _bits(total * 2 / (length - piece + 2), IN_BUCKET)
    run_marks = written(_scanned(_entries(batches, length, piece, bits)), "suffix-runs")
    marked = batches.join(_gathered(run_marks, "run"), "batch", "left")
    window_bits = _bits(total / 10, WINDOWS_IN_BUCKET)
    parts = _part_entries(marked.where("run_buckets is not null"), length, piece, bits, window_bits)
    part_marks = written(_compared(parts, length), "suffix-windows")
    for kind, name in ((0, "around"), (1, "window")):
        marked = marked.join(_gathered(part_marks.where(F.col("kind") == kind), name), "batch", "left")

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("docs", "sizes", "z", "run_buckets", "run_marks", "around_buckets", "around_marks", "window_buckets", "window_marks")
        for part in rows:
            for docs, sizes, z, of, marks, around_of, held, window_of, found in zip(*(part[c] for c in names)):
                b = _Batch(docs, sizes, z, length, piece, bits)
                run = _spread(len(b.key), b.buckets(), of, marks)
                w = _Windows(b, run, length, window_bits)
                window = _spread(len(w.hash), _stretches(w.bucket), window_of, found)
                change = np.zeros(len(b.data) + 1, np.int32)
                # A run goes where a smaller id holds it; within the batch, where it is not the first's.
                mine = b.of[b.order]
                gone = b.order[(run[b.number] == 1) | (mine > b.doc[b.number])] if len(b.order) else b.order
                np.add.at(change, b.runs.first[gone], 1)
                np.add.at(change, b.runs.first[gone] + b.runs.windows[gone] - 1 + length, -1)
                at = w.at[w.order[(window[w.number] == 1) | (_owners(b, w) > w.doc[w.number])]] if len(w.at) else w.at
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
                around = _Surroundings(b, run, length)
                ends = around.begin + around.n
                spans = ((k, slice(int(around.begin[s.start]), int(ends[s.stop - 1]))) for k, s in _stretches(around.bucket))
                window = _spread(int(around.n.sum()), spans, around_of, held)
                first, which = around.places(b)
                offset = _spelled(np.zeros(len(which), np.int64), around.n[which])
                hit = window[np.repeat(around.begin[which], around.n[which]) + offset] == 1
                at = (np.repeat(first, around.n[which]) + offset)[hit]
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
                drop = np.cumsum(change[:-1]) > 0
                yield _rows(b, drop)

    return marked.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumn(
        "doc_id", F.nullif("doc_id", F.lit(LAST)))


def _owners(b: _Batch, w: _Windows) -> np.ndarray:
    """Ids of the documents of a batch's windows, in the order in which they are compared."""
    return b.docs[np.searchsorted(b.ends, w.at[w.order], side="right")]


def _rows(b: _Batch, drop: np.ndarray) -> pd.DataFrame:
    raw, out = np.frombuffer(b.data, np.uint8), []
    for doc, start, end in zip(b.docs.tolist(), (b.ends - b.sizes).tolist(), b.ends.tolist()):
        gone = drop[start:end]
        spans = int(np.count_nonzero(gone[1:] > gone[:-1]) + gone[0]) if len(gone) else 0
        n = int(gone.sum())
        kept = raw[start:end][~gone].tobytes() if n else b.data[start:end]
        out.append((doc, end - start, n, spans, kept))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

"""Files whose records can only be told from their beginning, read by many tasks.

What a range of a file means depends on what stands before it: whether a string or a comment is open, and how
deep it is nested. Read alone, a range is therefore a function from the state at its start to the state at its
end. A first scan hands on this function for every range (one small row each, as the driver holds one for each
range that it plans anyhow); composed in order they tell where every range starts, and a second scan cuts all
ranges at once. What lies over a border is joined from the pieces on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.session import small_batches

HEAD_BYTES = 4096
THREADS = 16  # files whose beginnings the driver looks at together
BLANKS = b" \t\r\n\x0b\x0c"
BOM = b"\xef\xbb\xbf"
EVENT = "\n[Event"  # before which an archive is cut

Range = tuple[object, int]  # file and first byte


def _each_range(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Range, list[tuple]]]:
    """The rows of a task by the range they come from; the first two columns name it."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns))
        for key, some in groupby(rows, key=lambda r: r[:2]):
            yield key, list(some)


def _known(starts: dict, key: Range):
    if key not in starts:
        raise RuntimeError(f"the range {key} was not there in the first scan: the files were divided anew meanwhile")
    return starts[key]


# --- JSON arrays ---------------------------------------------------------------------------------


def first_signs(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The first sign of each file that is not blank, from its first bytes alone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(file: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream, codec = path.getFileSystem(conf).open(path), codecs.getCodec(path)
        try:
            read = codec.createInputStream(stream) if codec else stream
            while head := bytes(read.readNBytes(HEAD_BYTES)):
                if sign := head.removeprefix(BOM).lstrip(BLANKS)[:1]:
                    return sign.decode("latin-1")
            return ""
        finally:
            stream.close()

    with ThreadPoolExecutor(THREADS) as pool:
        return dict(zip(files, pool.map(first, files)))


def outside_strings(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Which bytes of JSON text stand outside strings, and whether its end is inside one. No string goes over
    a line end, so that one that is never closed ends there."""
    n = len(data)
    other = np.maximum.accumulate(np.where(data != 92, np.arange(n), -1))
    slashes = np.zeros(n, np.int64)  # right before a byte
    slashes[1:] = np.arange(n - 1) - other[:-1]
    quotes = (data == 34) & (slashes % 2 == 0)
    turns = np.cumsum(quotes) + inside
    line = np.maximum.accumulate(np.where(data == 10, turns, 0))
    within = (turns - line) % 2 == 1
    return ~within & ~quotes, bool(within[-1]) if n else inside


def _nesting(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """1 at each opening bracket or brace, -1 at each closing one."""
    opens, closes = (data == 123) | (data == 91), (data == 125) | (data == 93)
    return ((opens & outside).astype(np.int8) - (closes & outside).astype(np.int8)).astype(np.int64)


def _json_text(rows: list[tuple]) -> bytes:
    """What was read: pieces that each ended before a brace (but perhaps the last of a file)."""
    return b"}".join(r[-1] for r in rows) + b"}"


def _array_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: its bytes, and for a start outside or inside a string whether the end is inside one and how
    much deeper it is nested."""
    held: dict[Range, list] = {}
    for key, rows in _each_range(batches):
        text = _json_text(rows)
        state = held.setdefault(key, [rows[0][2], 0, [False, 0], [True, 0]])
        state[1] += len(text)
        data, done = np.frombuffer(text, np.uint8), {}
        for way in state[2:]:
            if way[0] not in done:
                outside, end = outside_strings(data, way[0])
                done[way[0]] = end, int(_nesting(data, outside).sum())
            end, deeper = done[way[0]]
            way[0], way[1] = end, way[1] + deeper
    rows = [(*key, size, length, *out, *into) for key, (size, length, out, into) in held.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=EFFECT_NAMES)


EFFECT_NAMES = ["file", "block", "size", "length", "end0", "deeper0", "end1", "deeper1"]
EFFECTS = "file long, block long, size long, length long, end0 boolean, deeper0 long, end1 boolean, deeper1 long"


def array_starts(effects: Iterable[tuple]) -> tuple[dict[Range, tuple[bool, int]], set]:
    """Where every range starts (inside a string, depth), by composing the functions of the ranges before it;
    and the files whose last piece was not followed by a brace, which their lengths tell."""
    starts: dict[Range, tuple[bool, int]] = {}
    open_ended = set()
    for file, ranges in groupby(sorted(effects), key=lambda r: r[0]):
        inside, depth, total = False, 0, 0
        for _, block, size, length, end0, deeper0, end1, deeper1 in ranges:
            starts[file, block] = inside, depth
            inside, depth = (end1, depth + deeper1) if inside else (end0, depth + deeper0)
            total += length
        if total not in (size, size - len(BOM)):  # the reader leaves a byte order mark out
            open_ended.add(file)
    return starts, open_ended


def cut_array(text: bytes, inside: bool, depth: int) -> tuple[list[bytes], bool, int]:
    """The pieces of a text between the signs that divide or bound an array's elements, and the state at its
    end. The first piece continues what stands before the text, the last is continued."""
    data = np.frombuffer(text, np.uint8)
    outside, end = outside_strings(data, inside)
    step = _nesting(data, outside)
    after = depth + np.cumsum(step)
    divides = ((data == 44) & outside & (after == 1)) | ((step == 1) & (after == 1)) | ((step == -1) & (after == 0))
    at = [-1, *np.flatnonzero(divides).tolist(), len(text)]
    return [text[a + 1:b] for a, b in zip(at, at[1:])], end, int(after[-1]) if len(text) else depth


WHOLE, HEAD, TAIL, THROUGH = range(4)  # an element; what is before the first cut of a range, after its last; no cut
CUTS = "file long, block long, kind int, cuts long, value binary"


def _array_pieces(batches: Iterator[pa.RecordBatch], starts: dict) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[list[tuple]]:
        key, cuts, held, inside, depth = None, 0, [], False, 0

        def ended() -> list[tuple]:
            return [(*key, TAIL if cuts else THROUGH, cuts, b"".join(held))] if key is not None else []

        for now, some in _each_range(batches):
            out = []
            if now != key:
                out += ended()
                key, cuts, held = now, 0, []
                inside, depth = _known(starts, key)
            pieces, inside, depth = cut_array(_json_text(some), inside, depth)
            for piece in pieces[:-1]:
                value = b"".join([*held, piece])
                held = []
                if cuts == 0:
                    out.append((*key, HEAD, 0, value))
                elif value := value.strip(BLANKS):
                    out.append((*key, WHOLE, 0, value))
                cuts += 1
            held.append(pieces[-1])
            yield out
        yield ended()

    names = [f.split()[0] for f in CUTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for out in rows():
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _over_borders(batches: Iterator[pa.RecordBatch], open_ended: set) -> Iterator[pa.RecordBatch]:
    """The elements that lie over borders of ranges, from the pieces of a file in order."""
    file, lead, pending, cuts, out = None, None, b"", 0, []

    def ended() -> None:
        rest = pending
        if file in open_ended and rest.endswith(b"}"):
            rest = rest[:-1]  # the brace that was put behind the last piece
        if cuts == 1:
            out.append((lead or b"").removeprefix(BOM) + b"[" + rest)  # no array after all
        elif rest := rest.strip(BLANKS):
            out.append(rest)

    for batch in batches:
        for now, _, kind, n, value in zip(*(c.to_pylist() for c in batch.columns)):
            if now != file:
                if file is not None:
                    ended()
                file, lead, pending, cuts = now, None, b"", 0
            if kind == HEAD:
                whole, pending = pending + value, b""
                if lead is None:
                    lead = whole  # before the array
                elif whole := whole.strip(BLANKS):
                    out.append(whole)
            else:
                pending, cuts = pending + value, cuts + n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
            out = []
    if file is not None:
        ended()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def array_elements(spark: SparkSession, files: list[str]) -> DataFrame:
    """DataFrame[value]: the text of every element of JSON arrays, one array a file.

    Ranges are read up to closing braces, wherever these stand, so that an array on one line is divided as well.
    An element is what stands between the commas of the array itself, whether or not it can be read; one that
    lacks a brace of its own takes what follows until the braces balance; ``null`` is an element without values. A file whose array holds no comma and
    never ends is one element with all its text.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "}").text(files).select(
        F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"),
        F.col("value").cast("binary").alias("value"))
    small_batches(raw)
    starts, open_ended = array_starts(tuple(r) for r in raw.mapInArrow(_array_effects, EFFECTS).collect())
    known, unclosed = spark.sparkContext.broadcast(starts), spark.sparkContext.broadcast(open_ended)
    pieces = raw.select("file", "block", "value").mapInArrow(lambda batches: _array_pieces(batches, known.value), CUTS)
    borders = pieces.where(F.col("kind") != WHOLE).repartition("file").sortWithinPartitions("file", "block", "kind")
    joined = borders.mapInArrow(lambda batches: _over_borders(batches, unclosed.value), "value binary")
    text = F.col("value").cast("string")
    texts = pieces.where(F.col("kind") == WHOLE).select("value").unionByName(joined)
    return texts.select(F.when(text == "null", "{}").otherwise(text).alias("value"))


# --- archives ------------------------------------------------------------------------------------


def _ends_blank(text: bytes) -> bool:
    """Whether a text ends with white space that holds a line end, so that a line break behind it ends a blank line."""
    return b"\n" in text[len(text.rstrip(BLANKS)):]


def _archive_summary(raw: DataFrame) -> DataFrame:
    """Per range: whether its last brace opens a comment (NULL without a brace), and whether it ends with a
    blank line."""
    at = F.monotonically_increasing_id()
    brace = F.regexp_extract("value", r"([{}])[^{}]*$", 1)
    blank = F.regexp_extract("value", r"(\s*)$", 1).contains("\n")
    rows = raw.select("file", "block", at.alias("at"), brace.alias("brace"), blank.alias("blank"))
    return rows.groupBy("file", "block").agg(
        F.max(F.when(F.col("brace") != "", F.struct("at", F.col("brace") == "{")))["col2"].alias("opens"), F.max_by("blank", "at").alias("blank"))


def archive_starts(summary: Iterable[tuple]) -> dict[Range, tuple[bool, bool, bool]]:
    """For every range: whether its first piece starts a game, whether a comment is open there, and whether the
    first piece of the next range goes on with its last game."""
    starts: dict[Range, tuple[bool, bool, bool]] = {}
    for file, ranges in groupby(sorted(summary, key=lambda r: r[:2]), key=lambda r: r[0]):
        inside, last = False, None
        for _, block, opens, blank in ranges:
            new = last is None or (starts_blank and not inside)
            if not new:
                starts[last] = (*starts[last][:2], True)
            last = file, block
            starts[last] = new, inside, False
            inside, starts_blank = inside if opens is None else opens, blank
    return starts


GAMES = "file string, block long, n long, begins boolean, over boolean, value binary"


def _archive_games(batches: Iterator[pa.RecordBatch], starts: dict) -> Iterator[pa.RecordBatch]:
    mark = EVENT.encode()

    def rows() -> Iterator[list[tuple]]:
        key, n, held, begins = None, 0, [], True
        new = inside = blank = goes_on = False

        def closed(last: bool) -> tuple:
            return (*key, n, begins, not begins or (last and goes_on), b"".join(held))

        for now, some in _each_range(batches):
            out = []
            for row in some:
                piece = row[-1]
                if now != key:
                    if key is not None:
                        out.append(closed(True))
                    key, n = now, 0
                    new, inside, goes_on = _known(starts, key)
                    begins = new
                    held = [piece if now[1] == 0 else (mark if not new else mark[1:]) + piece]
                elif blank and not inside:
                    out.append(closed(False))
                    n, begins, held = n + 1, True, [mark[1:] + piece]
                else:
                    held.append(mark + piece)
                brace = max(piece.rfind(b"{"), piece.rfind(b"}"))
                inside = inside if brace < 0 else piece[brace] == 123
                blank = _ends_blank(piece)
            yield out
        if key is not None:
            yield [closed(True)]

    names = [f.split()[0] for f in GAMES.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    for out in rows():
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _games_over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Games that lie over borders of ranges, from their pieces in order."""
    held: list[bytes] = []
    of = None
    for batch in batches:
        out = []
        for file, _, _, begins, _, value in zip(*(c.to_pylist() for c in batch.columns)):
            if begins and held:
                out.append((of, b"".join(held)))
                held = []
            of = file
            held.append(value)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary()))], names=["file", "value"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([of], pa.string()), pa.array([b"".join(held)], pa.binary())], names=["file", "value"])


def archive_texts(spark: SparkSession, path: str | list[str], file: Column) -> DataFrame:
    """DataFrame[file, value]: the games of archives, cut where a line that starts with ``[Event`` follows a
    blank line outside comments, whatever the line ends. What stands before the first is a row of its own."""
    raw = spark.read.option("lineSep", EVENT).text(path).select(
        file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    small_batches(raw)
    starts = archive_starts(tuple(r) for r in _archive_summary(raw).collect())
    known = spark.sparkContext.broadcast(starts)
    binary = raw.select("file", "block", F.col("value").cast("binary").alias("value"))
    games = binary.mapInArrow(lambda batches: _archive_games(batches, known.value), GAMES)
    out = games.where("NOT over").select("file", "value")
    if any(not new or goes_on for new, _, goes_on in starts.values()):  # else no game lies over a border
        borders = games.where("over").repartition("file").sortWithinPartitions("file", "block", "n")
        out = out.unionByName(borders.mapInArrow(_games_over_borders, "file string, value binary"))
    return out.select("file", F.replace(F.col("value").cast("string"), F.lit("\r\n"), F.lit("\n")).alias("value"))

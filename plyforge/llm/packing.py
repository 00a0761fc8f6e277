"""Packing tokenised documents into training sequences of one length."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.common import fresh, small_batches

LENGTH = 2048
SHORT = (256, 512, 1024)  # sequences of these lengths need no padding either
END = 1  # the id that ends a document
SENTENCE = 4  # cost of a cut between sentences of a document, in tokens of padding
INSIDE = 48  # cost of a cut inside a sentence
STEP = 64  # places inside a sentence at which it may be cut
BLOCK = 1 << 19  # tokens for which cuts are chosen at a time
WORDS_KEPT = 500_000  # chunks of either generation whose ids a worker remembers
MARKS = ".,!?;:|$%*#&"
TOKENIZER = "word_bpe_49k.json"

PIECE = ("doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


#: How byte-level tokenizers write the bytes that stand for no printable character.
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: How a tokenizer file must treat text for chunks between blanks to be independent: white space becomes blanks, no
#: match of the splitting pattern holds any, and a run of letters is split from what follows it.
_INDEPENDENT = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_LAST_LETTER = "\u0530"  # letters below it are letters in every version of Unicode in use


class Encoder:
    """A tokenizer file with a memory for the ids of chunks between blanks.

    Where a file normalises and splits texts in the way of ``_INDEPENDENT``, a text has the ids of its chunks in
    a row, and a chunk those of its letters and of the marks after them, if its last letter stays one when it is
    lower-cased (a capital dotted I leaves a combining dot, which goes with the marks). With any other file, and
    where a text holds one of the special strings in whatever case, texts are encoded whole. New chunks of
    lower-case Latin letters are nothing to normalise or split, and go straight to the merges.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.lower() for t in special.values()]
        self.split_id, self.split = next(iter((n, t.content) for n, t in special.items()), (None, None))
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.lean = None
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        raw = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in parts["added_tokens"])
        self.chunked = self.split is not None and raw and all(parts[k] == v for k, v in _INDEPENDENT.items())
        if self.chunked and parts["model"]["type"] == "BPE":
            lean = Tokenizer.from_str(json.dumps({**parts, "normalizer": None, "added_tokens": [],
                                                  "pre_tokenizer": {"type": "WhitespaceSplit"}}))
            stop = self._plain(lean, "!")
            if len(stop) == 1:
                model = lean.model
                if hasattr(model, "_resize_cache"):
                    model._resize_cache(0)  # what is remembered is remembered here
                    lean.model = model
                self.lean, self.stop = lean, stop[0]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, number in vocabulary.items():
            bare = piece.removesuffix("</w>")
            self.ends[number] = bool(bare) and not bare.strip(".!?")
        self.end_mark = np.uint32(END).tobytes()

    @staticmethod
    def _plain(tokenizer, text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _signs(chunk: str) -> str:
        """A chunk's bytes as the vocabulary writes them."""
        return chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTE_SIGNS)

    @staticmethod
    def _lowered(text: str) -> str:
        """Lower-casing the ASCII letters first changes no id, and fewer chunks differ."""
        return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")

    @staticmethod
    def _core(chunk: str) -> str:
        """A chunk without its last marks, if it has any and a letter that stays one stands before them."""
        core = chunk.rstrip(MARKS)
        if not core or len(core) == len(chunk) or core[-1] >= _LAST_LETTER:
            return ""
        last = core[-1].lower()
        return core if len(last) == 1 and last.isalpha() else ""

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks: they are encoded together, with a mark between them."""
        if len(self.young) + len(chunks) > WORDS_KEPT:
            self.old, self.young = self.young, {"": b""}
        plain = [c for c in chunks if c.isalpha() and c.islower() and (c.isascii() or max(c) < "\u0100")] if self.lean else []
        if plain:
            text = " ! ".join(map(self._signs, plain))
            ids = self.lean.encode_batch_fast([text], add_special_tokens=False)[0].ids
            self._keep(plain, np.array(ids, "<u4"), self.stop)
            done = set(plain)
            chunks = [c for c in chunks if c not in done]
        if chunks:
            self._keep(chunks, self._ids(self.split.join(chunks)), self.split_id)

    def _keep(self, chunks: list[str], ids: np.ndarray, stop: int) -> None:
        splits = np.flatnonzero(ids == stop).tolist()
        data = ids.tobytes()
        for chunk, a, b in zip(chunks, [-1, *splits], [*splits, len(ids)]):
            self.young[chunk] = data[4 * a + 4:4 * b]

    def _find(self, chunks: set[str]) -> None:
        """Bring chunks into the memory."""
        young, old, new, marked = self.young, self.old, set(), []
        for c in chunks:
            if c in old:
                young[c] = old[c]
                continue
            core = self._core(c)
            if core:
                marked.append((c, core))
                new.update(p for p in (core, c[len(core):]) if p not in young)
            else:
                new.add(c)
        if new:
            self._learn(list(new))
        for c, core in marked:
            # What went to the old generation just now is still there.
            self.young[c] = self._of(core) + self._of(c[len(core):])

    def _of(self, chunk: str) -> bytes:
        found = self.young.get(chunk)
        return self.old[chunk] if found is None else found

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text, its end mark included."""
        text = text or ""
        low = self._lowered(text)
        if not self.chunked or any(s in low for s in self.special):
            return self._ids(text).tobytes() + self.end_mark
        chunks = low.replace("\n", " ").split(" ")
        found = list(map(self.young.get, chunks))
        try:
            ids = b"".join(found)
        except TypeError:  # some are not known
            gaps = [i for i, known in enumerate(found) if known is None]
            self._find({chunks[i] for i in gaps})
            for i in gaps:
                found[i] = self._of(chunks[i])
            ids = b"".join(found)
        return ids + self.end_mark


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(str(path))
    return _ENCODERS[path]


def cut_places(ids: np.ndarray, document_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a run of tokens may be cut, and what a cut there costs: nothing at the end of a
    document, little between sentences, more inside one (only where it is longer than ``STEP``)."""
    kind = np.zeros(len(ids) + 1, np.uint8)
    ends = np.flatnonzero(sentence_end[ids]) + 1
    kind[ends] = 2
    kind[document_ends] = 3
    kind[0] = kind[-1] = 3
    marked = np.flatnonzero(kind)
    gaps = np.diff(marked)
    for a, gap in zip(marked[:-1][gaps > STEP].tolist(), gaps[gaps > STEP].tolist()):
        kind[a + STEP:a + gap:STEP] = 1
    places = np.flatnonzero(kind)
    return places, np.array([0, INSIDE, SENTENCE, 0])[kind[places]]


def best_cuts(places: np.ndarray, costs: np.ndarray, length: int, last: bool) -> list[int]:
    """Places where sequences end, so that padding and the costs of the cuts are least.

    ``least[j]`` is the least cost with a sequence ending at place j: the minimum over all places i
    within ``length`` before it of ``least[i] + length - (j - i)``, that is, of ``least[i] + i`` but for
    terms of j alone. The window only moves on, so a queue whose values rise has its minimum at its head:
    each place enters and leaves once. A sequence of one of the ``SHORT`` lengths has no padding. Unless
    the run is the ``last``, what follows the best cut of the final window stays for the next run.
    """
    at, cost = places.tolist(), costs.tolist()
    # Where a sequence of a short length that ends at a place would begin, if that is a place too.
    begins: dict[int, list[int]] = {}
    for short in SHORT:
        k = np.searchsorted(places, places - short)
        for j in np.flatnonzero((places >= short) & (places[k] == places - short)).tolist():
            begins.setdefault(j, []).append(int(k[j]))
    least, back = [0.0] * len(at), [0] * len(at)
    total = at[:]  # of each place, least + place
    # Of the queue, the part from head to end is in use: it never holds more places than were seen.
    queue, head, end = [0] * len(at), 0, 0
    for j in range(1, len(at)):
        here = at[j]
        first = here - length
        i = queue[head]
        while at[i] < first:
            head += 1
            i = queue[head]
        best = total[i] - first
        if j in begins:
            for k in begins[j]:
                if least[k] < best:
                    best, i = least[k], k
        best += cost[j]
        least[j], back[j] = best, i
        total[j] = value = best + here
        while end >= head and total[queue[end]] >= value:
            end -= 1
        end += 1
        queue[end] = j
    j = len(at) - 1
    if not last:
        j = min(range(int(np.searchsorted(places, at[-1] - length)), len(at)), key=total.__getitem__)
    cuts = []
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


class _Run:
    """Tokens of consecutive documents that have no sequence yet."""

    def __init__(self, sentence_end: np.ndarray, first_sequence: int) -> None:
        self.sentence_end, self.sequence = sentence_end, first_sequence
        self.ids: list[bytes] = []
        self.docs: list[tuple[str | None, int, int, int]] = []  # id, its ids before this run, ids here, all its ids
        self.size = 0

    def add(self, doc_id: str | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.ids.append(ids)
        self.docs.append((doc_id, 0, n, n))
        self.size += n

    def pack(self, last: bool) -> pd.DataFrame:
        data = b"".join(self.ids)
        ids = np.frombuffer(data, "<u4")
        lengths = np.array([d[2] for d in self.docs], np.int64)
        ends = np.cumsum(lengths)
        places, costs = cut_places(ids, ends, self.sentence_end)
        cuts = best_cuts(places, costs, LENGTH, last)
        stop = cuts[-1] if cuts else 0
        edges = np.unique(np.concatenate(([0], ends[ends < stop], cuts))).astype(np.int64)
        starts, length = edges[:-1], np.diff(edges)
        which = np.searchsorted(ends, starts, side="right")
        sequence = np.searchsorted(cuts, starts, side="right")
        before = np.array([d[1] for d in self.docs], np.int64)
        begins = np.concatenate(([0], cuts)).astype(np.int64)
        view = memoryview(data)
        out = pd.DataFrame({
            "doc_id": pd.Series([self.docs[i][0] for i in which], dtype=object),
            "start": before[which] + starts - (ends - lengths)[which], "length": length,
            "ids_crc32": [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(starts.tolist(), length.tolist())],
            "doc_tokens": np.array([self.docs[i][3] for i in which], np.int64),
            "sequence_id": self.sequence + sequence, "offset": starts - begins[sequence],
        })
        self.sequence += len(cuts)
        if last:
            self.ids, self.docs, self.size = [], [], 0
        else:
            first = int(np.searchsorted(ends, stop, side="right"))
            rest = []
            for i in range(first, len(self.docs)):
                doc_id, done, n, total = self.docs[i]
                gone = max(0, stop - int(ends[i] - n))
                rest.append((doc_id, done + gone, n - gone, total))
            self.ids, self.docs, self.size = [data[4 * stop:]], rest, len(ids) - stop
        return out


def in_written_order(docs: DataFrame) -> DataFrame:
    """Rows read from files, range-sorted by the number of their file and their place in it.

    Spark numbers the files it writes by partition, so that this is the order of the rows when they were
    written. A scan does not keep it: it deals out the largest files first. Rows that do not come straight
    from files stay as they are.
    """
    try:
        places = docs.select("*", "_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return docs
    file, row = fresh(docs, "_file"), fresh(docs, "_row")
    rows = places.toDF(*docs.columns, file, row)
    # part-00012-<id>-c000: both numbers get more digits when the room is not enough.
    number = [F.regexp_extract(F.col(file), pattern, 1).try_cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    order = [*number, F.col(file), F.col(row)]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """Pieces of the documents (doc_id, start, length, ids_crc32, doc_tokens) and where they lie
    (sequence_id, offset).

    The documents of a partition stay in their order; cuts are chosen for a run of about ``BLOCK``
    tokens at a time, and what is left of a run begins the next, so that only the last sequence of a
    partition is short. There is no shuffle, and a task that is run again makes the same rows. A NULL
    or empty text is its end mark alone; a NULL doc_id is kept; repeated rows are packed as often as
    they occur; an empty table gives no rows; other columns are ignored.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        run = _Run(enc.ends, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, t in zip(batch["doc_id"], batch["text"]):
                run.add(doc_id, enc.encode(t))
                if run.size >= BLOCK:
                    yield run.pack(False)
        if run.size:
            yield run.pack(True)

    small_batches(docs)
    # The id travels as text: pandas would turn a column of numbers with NULLs into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(packed, PIECE)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))

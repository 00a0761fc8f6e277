"""The n-grams of a batch of texts, interned in an open-addressed table of NumPy arrays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

WINDOW_WORDS = 1 << 18  # words whose n-grams are interned at a time: what bounds the memory of one long text
SPACE = 0x20
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Every byte as it counts: A-Z as a-z, what is neither a letter, a digit nor above 0x7F as a space.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else SPACE for b in range(256)], np.uint8)


def _crc_entries() -> np.ndarray:
    entries = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        entries = np.where(entries & 1, (entries >> 1) ^ np.uint32(0xEDB88320), entries >> 1)
    return entries


CRC_ENTRIES = _crc_entries()


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


class Words:
    """The words of some texts, each followed by one space in ``data``; ``doc`` is the text of each word."""

    def __init__(self, texts: Sequence[str | None]):
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        starts = np.zeros(len(coded) + 1, np.int64)
        np.cumsum([len(c) + 1 for c in coded], out=starts[1:])
        folded = FOLDED[np.frombuffer(b" ".join(coded) + b" ", np.uint8)]
        inside = folded != SPACE
        after = np.zeros_like(inside)  # whether the byte before is part of a word
        after[1:] = inside[:-1]
        first = np.flatnonzero(inside & ~after)
        kept = folded[inside | after]
        self.doc = np.searchsorted(starts, first, "right") - 1
        self.end = np.flatnonzero(kept == SPACE)
        self.start = np.concatenate([np.zeros(1, np.int64), self.end[:-1] + 1]) if len(self.end) else self.end
        self.data = np.concatenate([kept, np.zeros(8, np.uint8)])
        #: The eight bytes from each place on, as one number.
        self.eight = np.ndarray((len(self.data) - 7,), "<u8", self.data.tobytes(), 0, (1,))

    def windows(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, length, doc) of all runs of 1 to ``longest`` words of one text, by windows of the word
        that they start with."""
        n = len(self.start)
        for low in range(0, n, WINDOW_WORDS):
            high, found = min(n, low + WINDOW_WORDS), []
            for more in range(longest):
                at = np.arange(low, max(low, min(high, n - more)))
                at = at[self.doc[at] == self.doc[at + more]] if more else at
                found.append((self.start[at], self.end[at + more] - self.start[at], self.doc[at]))
            yield tuple(np.concatenate(parts) for parts in zip(*found))

    def bytes_at(self, start: int, length: int) -> bytes:
        return self.data[start:start + length].tobytes()

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """XXH64 of each span, all spans of less than 32 bytes at once."""
        h = P5 + length.astype(np.uint64)
        left, at = length.copy(), start.copy()
        for _ in range(3):
            some = np.flatnonzero(left >= 8)
            if not len(some):
                break
            lane = _rotated(self.eight[at[some]] * P2, 31) * P1
            h[some] = _rotated(h[some] ^ lane, 27) * P1 + P4
            at[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        h[some] = _rotated(h[some] ^ ((self.eight[at[some]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[some] += 4
        left[some] -= 4
        for _ in range(3):
            some = np.flatnonzero(left > 0)
            h[some] = _rotated(h[some] ^ (self.data[at[some]].astype(np.uint64) * P5), 11) * P1
            at[some] += 1
            left[some] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(length >= 32):
            h[i] = xxhash.xxh64_intdigest(self.bytes_at(start[i], length[i]))
        return h

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans at ``a`` and ``b``, of the same lengths, have the same bytes."""
        same = np.ones(len(a), bool)
        done, todo = 0, np.flatnonzero(a != b)
        while len(todo):
            part = np.minimum(length[todo] - done, 8).astype(np.uint64)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - part) * np.uint64(8))
            alike = ((self.eight[a[todo] + done] ^ self.eight[b[todo] + done]) & mask) == 0
            same[todo[~alike]] = False
            done += 8
            todo = todo[alike & (length[todo] > done)]
        return same

    def checksums(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of each span, byte by byte over all spans that are that long."""
        by = np.argsort(-length, kind="stable")
        at, size = start[by], length[by]
        crc = np.full(len(by), 0xFFFFFFFF, np.uint32)
        long = int(np.searchsorted(-size, -64, "right"))  # spans of 64 bytes and more come first
        for step in range(int(size[long]) if long < len(size) else 0):
            n = int(np.searchsorted(-size, -step, "left"))
            crc[long:n] = CRC_ENTRIES[(crc[long:n] ^ self.data[at[long:n] + step]) & 255] ^ (crc[long:n] >> np.uint32(8))
        crc = ~crc
        for i in range(long):
            crc[i] = zlib.crc32(self.bytes_at(at[i], size[i]))
        out = np.empty(len(by), np.uint32)
        out[by] = crc
        return out


class Table:
    """Open addressing over the spans of one window: ``slot`` is the place of each span's n-gram, and for each
    slot in use ``bucket`` and ``count`` hold what belongs to it. A slot is found by the hash of the bytes, then
    linear probing; a span is only given a slot whose n-gram has the same bytes."""

    def __init__(self, words: Words, start: np.ndarray, length: np.ndarray, buckets: int):
        n = len(start)
        places = 1 << max(3, (2 * n - 1).bit_length())  # at most half full
        mask = np.uint64(places - 1)
        key = words.hashes(start, length)
        place = (key & mask).astype(np.int64)
        held = np.full(places, -1, np.int64)  # the span that stands for the n-gram of a slot
        self.slot = np.empty(n, np.int64)
        waiting = np.arange(n)
        while len(waiting):
            at = place[waiting]
            free = held[at] < 0
            held[at[free]] = waiting[free]
            other = held[at]
            same = (key[other] == key[waiting]) & (length[other] == length[waiting])
            alike = np.flatnonzero(same)
            same[alike] = words.equal(start[other[alike]], start[waiting[alike]], length[waiting[alike]])
            self.slot[waiting[same]] = at[same]
            waiting = waiting[~same]
            place[waiting] = (place[waiting] + 1) & (places - 1)
        self.used = np.flatnonzero(held >= 0)
        self.bucket = np.zeros(places, np.int64)
        self.bucket[self.used] = words.checksums(start[held[self.used]], length[held[self.used]]) % buckets
        self.count = np.bincount(self.slot, minlength=places)


def bucket_counts(texts: Sequence[str | None], longest: int, buckets: int) -> np.ndarray:
    """How many n-grams of the texts, repeats counted, fall into each bucket."""
    total, words = np.zeros(buckets, np.int64), Words(texts)
    for start, length, _ in words.windows(longest):
        table = Table(words, start, length, buckets)
        np.add.at(total, table.bucket[table.used], table.count[table.used])
    return total


def gain_sums(texts: Sequence[str | None], longest: int, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its words, its n-grams, and the sum of their buckets' gains, gathered by slot."""
    words, n = Words(texts), len(texts)
    grams, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for start, length, doc in words.windows(longest):
        table = Table(words, start, length, len(gains))
        by_slot = gains[table.bucket]
        grams += np.bincount(doc, minlength=n)
        # Sums of whole numbers far below 2^53 are exact.
        total += np.bincount(doc, by_slot[table.slot], n).astype(np.int64)
    return np.bincount(words.doc, minlength=n), grams, total

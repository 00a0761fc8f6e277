"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.llm.common import small_batches

UNKNOWN = "und"
DIM = 1024  # components of a vector
SYMBOLS = 64  # word boundary, a to z, and buckets that the other letters share
GRAMS = SYMBOLS**3
SEED = 20_240_501
BLOCK = 1 << 20  # characters counted at a time


class Profiles(NamedTuple):
    """Prototype vectors, one row per language, of length 1, and what centres a document vector."""

    langs: list[str]
    prototypes: np.ndarray
    centre: np.ndarray


def _letters() -> np.ndarray:
    """One random vector of +1 and -1 per symbol."""
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))


LETTERS = _letters()


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The vectors of 3-grams: each letter's vector is permuted (rotated) by its place, and the three
    are bound by multiplication."""
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    first, second = np.roll(LETTERS, 2, axis=1), np.roll(LETTERS, 1, axis=1)
    return first[a] * second[b] * LETTERS[c]


def _symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane: 0 where it is no letter."""
    table = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()[0]
            table[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2_654_435_761 % 2**32 * (SYMBOLS - 27) // 2**32
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """A text's symbols; code points beyond the basic plane share the buckets of those below."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[0][cps & 0xFFFF]
    for i in np.flatnonzero(cps > 0xFFFF):
        out[i] = 27 + int(cps[i]) % (SYMBOLS - 27) if chr(cps[i]).isalpha() else 0
    return out


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 3-grams of a text and how often each occurs; none where it has no letter. Runs of
    other characters are one word boundary, and a boundary stands at either end."""
    found: dict[int, int] = {}
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    text = text or ""
    tail = np.zeros(1, np.int64)
    for at in range(0, len(text), BLOCK):
        s = np.concatenate((tail, symbols(text[at:at + BLOCK])))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        if at + BLOCK >= len(text) and s[-1]:
            s = np.append(s, 0)
        if len(s) > 2:
            grams, counts = np.unique(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], return_counts=True)
            if len(text) > BLOCK:
                for g, n in zip(grams.tolist(), counts.tolist()):
                    found[g] = found.get(g, 0) + n
        tail = s[-2:]
    if found:
        grams = np.array(sorted(found), np.int64)
        counts = np.array([found[g] for g in grams.tolist()], np.int64)
    return grams, counts


class _Vectors:
    """3-gram vectors made so far; there are at most ``GRAMS`` and in practice a few thousand."""

    def __init__(self, limit: int = 20_000) -> None:
        self.row = np.full(GRAMS, -1, np.int32)
        self.vectors = np.empty((0, DIM), np.int8)
        self.limit = limit

    def of(self, grams: np.ndarray) -> np.ndarray:
        new = grams[self.row[grams] < 0]
        if len(new):
            if len(self.vectors) + len(new) > self.limit:
                self.row[:] = -1
                self.vectors, new = np.empty((0, DIM), np.int8), grams
            self.row[new] = np.arange(len(self.vectors), len(self.vectors) + len(new))
            self.vectors = np.concatenate((self.vectors, gram_vectors(new)))
        return self.vectors[self.row[grams]].astype(np.float32)


TOGETHER = 64  # documents whose vectors are one matrix product


def document_vectors(texts: list[str | None], vectors: _Vectors) -> np.ndarray:
    """The bundle of each text's n-gram vectors, as a row of length 1 (all zero where there is no
    letter). An n-gram counts by the root of its frequency, so that a few very common ones do not
    drown the rest."""
    found = [gram_counts(t) for t in texts]
    grams = np.unique(np.concatenate([g for g, _ in found])) if found else np.empty(0, np.int64)
    weights = np.zeros((len(texts), len(grams)), np.float32)
    for row, (g, n) in zip(weights, found):
        row[np.searchsorted(grams, g)] = np.sqrt(n)
    bundles = weights @ vectors.of(grams)
    return bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)


def _vector_batches(batch: pd.Series, vectors: _Vectors) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(batch), TOGETHER):
        yield at, document_vectors(list(batch.iloc[at:at + TOGETHER]), vectors)


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Profiles:
    """Language prototypes from the rows of ``docs`` (``text``, ``lang``) whose lang is not NULL.

    A prototype bundles the vectors of all the documents of its language, each of length 1. The sums
    are made in the tasks and added up by Spark, and the driver gets one vector per language. They
    are centred on their mean, which holds what all languages have in common.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, total, number = _Vectors(), {}, {}
        for batch in batches:
            for at, rows in _vector_batches(batch["text"], vectors):
                langs = batch["lang"].iloc[at:at + TOGETHER].to_numpy()
                some = rows.any(axis=1)
                for lang in set(langs[some]):
                    mine = rows[some & (langs == lang)]
                    total[lang] = total.get(lang, 0.0) + mine.sum(axis=0, dtype=np.float64)
                    number[lang] = number.get(lang, 0) + len(mine)
        for lang, v in total.items():
            # Rounded to integers, the sums do not depend on the order in which they are added.
            yield pd.DataFrame({"lang": lang, "i": np.arange(DIM), "v": np.rint(v * 2**20).astype(np.int64),
                                "n": number[lang]})

    small_batches(docs)
    parts = docs.where("lang is not null").select("text", "lang").mapInPandas(sums, "lang string, i int, v long, n long")
    rows = parts.groupBy("lang", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    got = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v"), F.max("n").alias("n")).collect()
    got = sorted(got, key=lambda r: r["lang"])
    if not got:
        return Profiles([], np.empty((0, DIM), np.float32), np.zeros(DIM, np.float32))
    means = np.array([[x["v"] for x in r["v"]] for r in got], np.float64) / 2**20 / np.array([[r["n"]] for r in got])
    centre = means.mean(axis=0) if len(got) > 1 else np.zeros(DIM)
    means -= centre
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    return Profiles([r["lang"] for r in got], means.astype(np.float32), centre.astype(np.float32))


def predictor(profiles: Profiles):
    """Column function from a text to (lang_pred, score).

    The language is that of the prototype with the largest cosine (the first by name on a tie); the
    score maps this cosine from -1..1 to 0..1. A text that is NULL or has no letter is ``und`` with
    score 0, and so is every text where nothing was learned.
    """

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = _Vectors()
        for batch in batches:
            parts = [pd.DataFrame({"lang_pred": [], "score": []}).astype({"lang_pred": object, "score": float})]
            for _, rows in _vector_batches(batch, vectors):
                some = rows.any(axis=1) & bool(profiles.langs)
                names, scores = np.full(len(rows), UNKNOWN, object), np.zeros(len(rows))
                if some.any():
                    v = rows[some] - profiles.centre
                    cosines = v @ profiles.prototypes.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    names[some] = np.array(profiles.langs, object)[cosines.argmax(axis=1)]
                    scores[some] = np.clip((cosines.max(axis=1) + 1) / 2, 0, 1)
                parts.append(pd.DataFrame({"lang_pred": names, "score": scores}))
            yield pd.concat(parts, ignore_index=True)

    return guess


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Profiles are learned from text and non-null lang of the documents that are not held out, and from
    nothing else; neither lang nor source nor doc_id is an input of a prediction. A NULL doc_id is not
    held out; repeated rows are learned from and predicted as often as they occur; an empty table
    gives no rows; other columns are ignored.
    """
    guess = predictor(train(docs.where(~held_out(F.col("doc_id")))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), guess("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told: those with a letter in their text. Where nothing was
    learned, no language is predicted and the letters alone decide."""

    @F.pandas_udf("boolean")
    def has_letter(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([bool(t) and bool(symbols(t).any()) for t in batch], dtype=bool)

    profiles = train(docs.where(~held_out(F.col("doc_id"))))
    if not profiles.langs:
        return docs.where(has_letter("text"))
    return docs.where(predictor(profiles)("text")["lang_pred"] != UNKNOWN)

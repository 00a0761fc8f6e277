"""Per-row scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.functions.core import words
from plyforge.functions.stem import porter


def set_prf(pred: Column, ref: Column) -> Column:
    """struct<p, r, f1> of two token arrays taken as sets; two empty sets score 1."""
    p_set, r_set = F.array_distinct(pred), F.array_distinct(ref)
    n_p, n_r = F.size(p_set), F.size(r_set)
    both = F.size(F.array_intersect(p_set, r_set)).cast("double")
    empty = (n_p == 0) & (n_r == 0)
    p = F.when(empty, 1.0).when(n_p > 0, both / n_p).otherwise(0.0)
    r = F.when(empty, 1.0).when(n_r > 0, both / n_r).otherwise(0.0)
    f1 = F.when(empty, 1.0).when(both > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.struct(p.alias("p"), r.alias("r"), f1.alias("f1"))


def overlap_counts(a: Column | str, b: Column | str, orders: tuple[int, ...], stem: bool = False) -> Column:
    """struct<m<n>, ..., lcs>: for each order the n-grams that two token arrays share, each as often as in
    the one that has fewer; and the longest common subsequence where the orders hold 0.

    The cost is in proportion to the tokens: n-grams are counted in a table, as built-in functions on
    arrays only compare each with each. With ``stem`` every word is first cut to its stem, a different one
    once. The function is made here, not at import, so that it travels to the tasks by value.
    """
    fields = [T.StructField("lcs" if n == 0 else f"m{n}", T.LongType()) for n in orders]

    @F.pandas_udf(T.StructType(fields))
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        stems: dict[str, str] = {}

        def cut(words) -> list[str]:
            for w in words:
                if w not in stems:
                    if len(stems) > 500_000:
                        stems.clear()
                    stems[w] = porter(w)
            return [stems.get(w) or porter(w) for w in words]

        for left, right in batches:
            rows = []
            for x, y in zip(left, right):
                x, y = (None, None) if x is None or y is None else (cut(x), cut(y)) if stem else (list(x), list(y))
                rows.append([None if x is None else _lcs(x, y) if n == 0 else _shared(x, y, n) for n in orders])
            yield pd.DataFrame(rows, columns=[f.name for f in fields], dtype="Int64")

    return count(a, b)


def _shared(x: list[str], y: list[str], n: int) -> int:
    one, other = (Counter(zip(*(t[i:] for i in range(n)))) for t in (x, y))
    if len(other) < len(one):
        one, other = other, one
    return sum(min(k, other[g]) for g, k in one.items() if g in other)


def _lcs(x: list[str], y: list[str]) -> int:
    """Longest common subsequence with one bit per token of ``x``."""
    spots: dict[str, int] = {}
    for i, token in enumerate(x):
        spots[token] = spots.get(token, 0) | (1 << i)
    full = (1 << len(x)) - 1
    row = full
    for token in y:
        hit = row & spots.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def f_measure(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """2PR/(P+R) written with counts; 0 when nothing is shared."""
    return F.when(hits > 0, 2.0 * hits / (n_pred + n_ref)).otherwise(0.0)


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Longest common subsequence of two token arrays."""
    return overlap_counts(a, b, (0,))["lcs"].cast("int")


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance of two texts in code points; NULL if either is."""

    @F.pandas_udf("int")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([None if x is None or y is None else _edits(x, y) for x, y in zip(left, right)], dtype="Int32")

    return distance(a, b)


def _edits(x: str, y: str) -> int:
    """Edit distance with one bit per letter of the longer text.

    A column of the table of distances is kept as the places at which it rises and those at which it falls from
    one row to the next; a letter of the shorter text takes it to the next column by a few operations on whole
    numbers, so that two texts of m and n letters cost m n / 64 steps of the machine, not m n.
    """
    if len(x) < len(y):
        x, y = y, x
    start, shorter = 0, len(y)
    while start < shorter and x[start] == y[start]:
        start += 1
    end = 0
    while end < shorter - start and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[start:len(x) - end], y[start:shorter - end]
    if not y:
        return len(x)
    letters = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
    spots = {c: int.from_bytes(np.packbits(letters == ord(c), bitorder="little").tobytes(), "little") for c in set(y)}
    full = (1 << len(x)) - 1
    rises, falls = full, 0
    for c in y:
        same = spots[c]
        level = same | falls
        carried = (((same & rises) + rises) ^ rises) | same
        up = falls | (full & ~(carried | rises))
        down = rises & carried
        up = (up << 1 | 1) & full
        rises = (down << 1 | ~(level | up)) & full
        falls = up & level
    return len(y) + rises.bit_count() - falls.bit_count()


def norm_edit_distance(pred: Column, ref: Column) -> Column:
    longest = F.greatest(F.length(pred), F.length(ref))
    return F.when(longest > 0, edit_distance(pred, ref) / longest).otherwise(0.0)


def pseudo_perplexity(text: Column) -> Column:
    """exp(tokens / distinct tokens); infinite for a text without tokens."""
    tokens = words(text)
    distinct = F.size(F.array_distinct(tokens))
    return F.when(distinct > 0, F.exp(F.size(tokens) / distinct)).otherwise(F.lit(float("inf")))


def in_top_k(move: Column, top: Column, k: Column | int) -> Column:
    size = F.lit(k) if isinstance(k, int) else k
    return F.coalesce(F.array_contains(F.slice(top, 1, size), move), F.lit(False))


def move_exact_match(answer: Column, reference: Column, alias: Column | None = None) -> Column:
    """Equality after the answer is resolved through ``alias`` (its coordinate form) if there is one."""
    resolved = answer if alias is None else F.coalesce(alias, answer)
    return F.coalesce(resolved == reference, F.lit(False))


def tokens_until_stop(ids: Column, prompt_len: Column, stop_ids: list[int]) -> Column:
    """Number of generated ids after the prompt and before the first stop or pad id."""
    made = F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))
    stops = F.array(*[F.lit(s) for s in stop_ids])
    first = F.array_position(F.transform(made, lambda x: F.array_contains(stops, x)), F.lit(True))
    return F.when(first > 0, first - 1).otherwise(F.size(made)).cast("int")


def mask_labels(
    ids: Column, prompt_len: Column, attention: Column | None = None, ignore: int = -100
) -> Column:
    """Copy of the ids with the prompt, and the padding if an attention mask is given, ignored."""
    masked = F.transform(ids, lambda x, i: F.when(i < prompt_len, ignore).otherwise(x))
    if attention is None:
        return masked
    return F.zip_with(masked, attention, lambda x, a: F.when(a == 0, ignore).otherwise(x))

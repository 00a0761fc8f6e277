"""Small shared column helpers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space between words, also outside ASCII.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The same as ranges of a character class, which is matched faster than a list of single signs.
SPACE_RANGES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
JAVA_META = re.compile(r"([\\\[\](){}.*+?^$|])")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_pattern(text: str) -> str:
    """Regular expression matching ``text`` itself."""
    return JAVA_META.sub(r"\\\1", text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it.

    A lambda's body is run for every element, and so is each outer expression it names; an array
    that a lambda looks into is therefore bound with this first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Drop white space, line breaks included, at both ends."""
    return F.btrim(c, F.lit(SPACES))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def words(c: Column) -> Column:
    """White-space tokens, case kept; a blank text has none."""
    return F.array_remove(F.split(c, f"[{SPACE_RANGES}]+"), "")


def alnum_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array, repeats kept."""
    if n == 1:
        return tokens

    def grams(t: Column) -> Column:
        joined = t
        for i in range(1, n):
            # The longer list is padded with NULL, which makes the last joins NULL and drops them.
            joined = F.zip_with(joined, F.slice(t, i + 1, F.greatest(F.size(t) - i, F.lit(0))),
                                lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_compact(joined)

    return let(tokens, grams)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Near-equality with the tolerance taken from the second value."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def hash01(seed: int | str, rule: str, *keys: Column) -> Column:
    """Number in [0, 1) that depends only on seed, rule and key, never on row order."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(rule), *[k.cast("string") for k in keys])
    prefix = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return prefix / F.lit(4294967296.0)


def pick(arr: Column, seed: int | str, *keys: Column, rule: str = "pick") -> Column:
    """One element of an array, chosen by the hash of the key; NULL for an empty array."""
    spot = F.floor(hash01(seed, rule, *keys) * F.size(arr)).cast("int")
    return F.try_element_at(arr, spot + 1)


def move_key(fen: Column, move_number: Column, side: Column) -> Column:
    return F.md5(F.concat_ws("|", fen, move_number.cast("string"), side))


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def sanitize_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def array_mean(arr: Column) -> Column:
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(arr) > 0, total / F.size(arr))


def sorted_distinct(arr: Column) -> Column:
    return F.sort_array(F.array_distinct(arr))


def overlap_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def split_last(arr: Column) -> Column:
    """(all but the last element, last element); NULL for an empty array."""
    return F.when(
        F.size(arr) > 0,
        F.struct(
            F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0))).alias("prefix"),
            F.try_element_at(arr, F.lit(-1)).alias("last"),
        ),
    )


def round_mean(c: Column, n: int) -> Column:
    """Rounding of array means: scaled, rounded half-even, scaled back."""
    return F.rint(c * 10.0**n) / 10.0**n


def round_ratio(c: Column, n: int) -> Column:
    """Correct rounding of the value that the double really holds, ties half-even.

    `bround` goes by the shortest decimal text instead and takes 0.12345, which is held as a little
    more, for a tie. Number formatting is correct except just below its last digit, where the one
    double next to half a unit is decided here.
    """
    unit, half = 10.0**-n, float(f"5e-{n + 1}")
    tiny = F.when(F.abs(c) > half, unit).when(F.abs(c) == half, round(half, n)).otherwise(0.0)
    pattern = "0." + "0" * n if n else "0"
    shown = F.call_function("format_number", c.cast("double"), F.lit(pattern)).try_cast("double")
    return F.when(F.abs(c) < unit, tiny * F.signum(c)).otherwise(F.coalesce(shown, c))


def format_fixed(value: Column, spec: str) -> Column:
    """Text of a number by a ``%.Nf`` spec, rounded as the value is really held."""
    n = int(spec[2:-1])
    pattern = "0." + "0" * n if n else "0"
    return F.call_function("format_number", round_ratio(value.cast("double"), n), F.lit(pattern))


def format_metric(value: Column, spec: str = "%.3f", default: str = "N/A") -> Column:
    return F.coalesce(format_fixed(value, spec), F.lit(default))

"""Secrets in texts: base patterns, and a small character network for what they leave."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.common import fresh, small_batches, written

#: Fixed patterns and least lengths of the base findings, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # the same runs, without a match for each short one
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "model")
HINTS = ("passw", "secret", "token", "api")

#: What the network looks at: runs that could be a key, with a digit among them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
BEFORE, INSIDE, AFTER = 16, 48, 8
WIDTH, FILTERS, EPOCHS, BATCH, SEED = 5, 24, 20, 128, 7
PART = 32_768  # findings that one task learns from in a round, about
LEAST_FINDINGS = 8  # of either label
BINS = 1024  # that the place of the threshold is narrowed by
LEAST_RECALL = 0.98
LEAST_SCORE = 0.5
REDACTED = "[SECRET]"

_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:;,\"' \n@#$%&*()<>[]{}"
_CODE = np.full(0x110000, 1, np.uint8)  # 0 pads, 1 is any other character
_CODE[[ord(c) for c in _CHARS]] = np.arange(2, len(_CHARS) + 2)
CODES = len(_CHARS) + 2

Span = tuple[int, int, str]


class Network(NamedTuple):
    """Convolution of one-hot characters, maximum over all places, one linear unit; then the slope and
    offset that calibrate its output, and the threshold."""

    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float
    offset: float
    threshold: float


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base findings by start, then kind; leftmost and without overlap
    within a kind, short ones dropped."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if any(c.isdigit() for c in m[0])]


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """A candidate and its surroundings as character codes; a long one as several overlapping pieces,
    so that all of it is seen."""
    out = []
    for at in range(start, max(end - INSIDE // 2, start + 1), INSIDE // 2):
        stop = min(at + INSIDE, end)
        piece = text[max(0, at - BEFORE):stop + AFTER]
        codes = np.zeros(BEFORE + INSIDE + AFTER, np.uint8)
        got = _CODE[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        skip = BEFORE - min(at, BEFORE)
        codes[skip:skip + len(got)] = got
        out.append(codes)
    return out


def _overlaps(span: tuple[int, int], spans: list[Span]) -> bool:
    return any(a < span[1] and span[0] < b for a, b, _ in spans)


def labelled_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(label, codes) of every candidate: 1 where a base pattern finds it, else 0."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels, codes = [], []
            for t in batch["text"]:
                if not t:
                    continue
                spans = base_spans(t)
                for span in candidates(t):
                    hit = int(_overlaps(span, spans))
                    for w in windows(t, *span):
                        labels.append(hit)
                        codes.append(w.tobytes())
            if labels:
                yield pd.DataFrame({"label": labels, "codes": codes})

    small_batches(docs)
    return docs.select(F.col(text).alias("text")).mapInPandas(mark, "label int, codes binary")


def _pool(net_kernel: np.ndarray, bias: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places = x.shape[1] - WIDTH + 1
    conv = sum(net_kernel[k][x[:, k:k + places]] for k in range(WIDTH)) + bias
    top = conv.argmax(axis=1)
    return np.maximum(np.take_along_axis(conv, top[:, None, :], axis=1)[:, 0], 0), top


def scores(net: Network, x: np.ndarray) -> np.ndarray:
    """Calibrated probabilities of rows of codes."""
    out = np.empty(len(x))
    for at in range(0, len(x), 512):
        pooled, _ = _pool(net.kernel, net.bias, x[at:at + 512])
        out[at:at + 512] = pooled @ net.out + net.shift
    return 1 / (1 + np.exp(-np.clip(net.scale * out + net.offset, -30, 30)))


def _chance(value: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def _calibrated(sums: Callable[[float, float], Sequence[float]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-back outputs. ``sums`` gives, for a slope and an
    offset, the sums over all of them that a Newton step takes."""
    a, b = 1.0, 0.0
    for _ in range(50):
        gr, g, wrr, wr, w = sums(a, b)
        h = np.array([[wrr + 1e-3, wr], [wr, w + 1e-3]])
        step = np.linalg.solve(h, np.array([gr + 1e-3 * (a - 1), g]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    # Digits that depend on the order of adding go.
    return round(float(max(a, 1e-3)), 9), round(float(b), 9)


def _platt(n0: int, n1: int) -> tuple[float, float]:
    """What the curve should be for held-back findings of either label (Platt's targets)."""
    return 1 / (n0 + 2), (n1 + 1) / (n1 + 2)


def _threshold(raw: float, scale: float, offset: float) -> float:
    return max(LEAST_SCORE, float(_chance(np.float64(scale * raw + offset))))


class State(NamedTuple):
    """What is learned: the parameters, and Adam's two moments and number of steps."""

    params: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: float

    def packed(self) -> bytes:
        return np.concatenate([a.ravel() for part in self[:3] for a in part] + [np.array([self.step])]).tobytes()

    def like(self, flat: np.ndarray) -> State:
        """A state of this shape from its numbers."""
        at, parts = 0, []
        for part in self[:3]:
            parts.append([])
            for a in part:
                parts[-1].append(flat[at:at + a.size].reshape(a.shape))
                at += a.size
        return State(*parts, float(flat[-1]))


def _start() -> State:
    rng = np.random.default_rng(SEED)
    params = [rng.normal(0, 0.15, (WIDTH, CODES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), np.zeros(1)]
    return State(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0)


def _balance(n0: int, n1: int) -> tuple[float, float]:
    """Weights of the labels that make them count alike."""
    return 0.5 * (n0 + n1) / n0, 0.5 * (n0 + n1) / n1


def _epoch(state: State, x: np.ndarray, y: np.ndarray, balance: tuple[float, float], rng: np.random.Generator) -> State:
    """One pass over findings, in batches."""
    params, first, second, step = [list(part) for part in state[:3]] + [state.step]
    filters, weight, order = np.arange(FILTERS), np.where(y == 1, balance[1], balance[0]), rng.permutation(len(y))
    for at in range(0, len(order), BATCH):
        rows = order[at:at + BATCH]
        kernel, bias, out, shift = params
        pooled, top = _pool(kernel, bias, x[rows])
        delta = (_chance(pooled @ out + shift[0]) - y[rows]) * weight[rows] / len(rows)
        back_pool = delta[:, None] * out * (pooled > 0)
        grad = np.zeros_like(kernel)
        for k in range(WIDTH):
            np.add.at(grad[k], (np.take_along_axis(x[rows], top + k, axis=1), filters), back_pool)
        grads = [grad + 1e-4 * kernel, back_pool.sum(axis=0), pooled.T @ delta, np.array([delta.sum()])]
        step += 1
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return State(params, first, second, step)


def fit(x: np.ndarray, y: np.ndarray) -> Network | None:
    """`train` for findings that are at hand as arrays: learn from three quarters of them, calibrate on the rest,
    and take the largest threshold that keeps ``LEAST_RECALL`` of its findings, but no score below
    ``LEAST_SCORE``. None where either label has too few."""
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_FINDINGS:
        return None
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    x, y = x[order], y[order].astype(np.float64)
    back = np.arange(len(y)) % 4 == 0
    state, balance = _start(), _balance(max((y[~back] == 0).sum(), 1), max((y[~back] == 1).sum(), 1))
    for _ in range(EPOCHS):
        state = _epoch(state, x[~back], y[~back], balance, rng)
    kernel, bias, out, shift = state.params
    raw, hit = _pool(kernel, bias, x[back])[0] @ out + shift[0], y[back] == 1
    target = np.where(hit, *_platt((~hit).sum(), hit.sum())[::-1])

    def sums(a: float, b: float) -> list[float]:
        p = _chance(a * raw + b)
        g, w = p - target, p * (1 - p) + 1e-6
        return [(g * raw).sum(), g.sum(), (w * raw * raw).sum(), (w * raw).sum(), w.sum()]

    scale, offset = _calibrated(sums)
    hits = np.sort(raw[hit])
    threshold = _threshold(hits[int((1 - LEAST_RECALL) * len(hits))], scale, offset) if len(hits) else 1.0
    return Network(kernel, bias, out, float(shift[0]), scale, offset, threshold)


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(batch["codes"]), np.uint8).reshape(len(batch), -1)
    return x, batch["label"].to_numpy(np.float64)


def _pass(state: State, i: int, balance: tuple[float, float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Round ``i`` for a part: the state that its findings lead to."""

    def passed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["codes", "label"])
        part = int(rows["part"].iloc[0])
        new = _epoch(state, *_arrays(rows), balance, np.random.default_rng([SEED, i, part]))
        return pd.DataFrame({"part": [part], "n": [len(rows)], "state": [new.packed()]})

    return passed


def _learned(found: DataFrame) -> State:
    """The state after ``EPOCHS`` passes over all findings (part, label, codes). In each round every part is
    passed once, all from the same state, and the next state is their mean by numbers of findings; one state
    a part comes to the driver."""
    n = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    state, balance = _start(), _balance(max(n.get(0, 0), 1), max(n.get(1, 0), 1))
    for i in range(EPOCHS):
        got = sorted(found.groupBy("part").applyInPandas(_pass(state, i, balance), "part long, n long, state binary").collect())
        total = sum(r["n"] for r in got)
        if total:
            state = state.like(sum(np.frombuffer(r["state"]) * (r["n"] / total) for r in got))
    return state


def _value_at(rows: DataFrame, rank: int) -> float:
    """The value ``raw`` at a 0-based rank, where each counts ``n`` times: the bin that holds it is divided
    again until it holds one value."""
    low, high = rows.agg(F.min("raw"), F.max("raw")).first()
    while low < high:
        place = F.floor((F.col("raw") - low) / F.lit((high - low) / BINS))
        inside = rows.where(F.col("raw").between(low, high)).groupBy(F.least(place, F.lit(BINS - 1)).alias("bin"))
        for r in sorted(inside.agg(F.sum("n").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).collect()):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def train(docs: DataFrame, text: str = "text") -> Network | None:
    """The network for a corpus, from all its findings: it learns from three quarters of the different ones, is
    calibrated on the rest, and its threshold is the largest that keeps ``LEAST_RECALL`` of these, but no score
    below ``LEAST_SCORE``. Findings that recur are learned from once a round and count as often as they occur
    in calibration and threshold; which ones are held back depends on their codes alone, so that none is on
    both sides. None where either label has too few."""
    found = labelled_findings(docs, text).groupBy("label", "codes").agg(F.count("*").alias("n"))
    found = found.withColumn("back", F.pmod(F.xxhash64("codes", F.lit(SEED)), F.lit(4)) == 0)
    found = written(found, "secret-findings")
    counts = {(r["label"], r["back"]): r for r in found.groupBy("label", "back").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    number = lambda label, back: counts[label, back]["n"] if (label, back) in counts else 0
    if min(number(0, True) + number(0, False), number(1, True) + number(1, False)) < LEAST_FINDINGS:
        return None
    parts = math.ceil(sum(r["rows"] for r in counts.values()) / PART)
    dealt = found.where(~F.col("back")).select("label", "codes", F.pmod(F.xxhash64("codes"), F.lit(parts)).alias("part"))
    state = _learned(dealt)
    kernel, bias, out, shift = state.params

    def outputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = _pool(kernel, bias, _arrays(batch)[0])[0] @ out + shift[0]
            yield pd.DataFrame({"label": batch["label"], "n": batch["n"], "raw": raw})

    rest = found.where("back").select("label", "codes", "n")
    rest = written(rest.mapInPandas(outputs, "label int, n long, raw double"), "secret-outputs")
    low, high = _platt(number(0, True), number(1, True))

    def sums(a: float, b: float) -> list[float]:
        raw, n = F.col("raw"), F.col("n")
        bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), raw * F.lit(a) + F.lit(b)))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))
        g, w = p - F.when(F.col("label") == 1, high).otherwise(low), p * (F.lit(1.0) - p) + F.lit(1e-6)
        return [v or 0.0 for v in rest.agg(*[F.sum(n * v) for v in (g * raw, g, w * raw * raw, w * raw, w)]).first()]

    scale, offset = _calibrated(sums)
    hits = number(1, True)
    threshold = _threshold(_value_at(rest.where("label = 1"), int((1 - LEAST_RECALL) * hits)), scale, offset) if hits else 1.0
    return Network(kernel, bias, out, float(shift[0]), scale, offset, threshold)


def all_spans(text: str, net: Network | None) -> tuple[list[Span], list[Span]]:
    """Base findings, and all findings: those and the candidates apart from them that the network
    scores at its threshold or higher; by start, then kind."""
    base = base_spans(text)
    if net is None:
        return base, base
    rest = [c for c in candidates(text) if not _overlaps(c, base)]
    pieces = [(i, w) for i, c in enumerate(rest) for w in windows(text, *c)]
    best = np.zeros(len(rest))
    if pieces:
        np.maximum.at(best, [i for i, _ in pieces], scores(net, np.array([w for _, w in pieces])))
    more = [(*c, "model") for c, p in zip(rest, best) if p >= net.threshold]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``docs``; ``spans`` lists
    kind:start:end in code points. A NULL or empty text has no finding; repeated rows stay repeated; an
    empty table gives no rows; other columns are ignored."""

    small_batches(docs)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                base, spans = all_spans(t or "", net)
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, _joined(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", scan(text).alias("found")).select("doc_id", "found.*")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every finding (overlapping ones together) replaced by ``REDACTED``."""
    out, done = [], 0
    for a, b, _ in spans:
        if a >= done:
            out += [text[done:a], REDACTED]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with all findings in ``text`` replaced, and ``n_chars`` of the changed texts to match."""

    small_batches(docs)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else redacted(t, all_spans(t, net)[1]) for t in batch], dtype=object)

    new = fresh(docs, "clean")
    cleaned = docs.withColumn(new, clean("text"))
    n_chars = F.when(F.col(new) != F.col("text"), F.char_length(new).cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).withColumn("text", F.col(new)).select(*docs.columns)

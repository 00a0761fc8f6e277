"""Near-duplicate vectors with an inverted multi-index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.common import written
from plyforge.llm.components import components

COSINE = 0.95
SAMPLE = 8192  # vectors that the codebooks and the reach are fitted on
RECALL = 0.99  # share of links that either end's walk has to find, at the least similar that still link
IN_CELL = 32  # vectors that a cell holds on average, as far as MOST_CENTRES allows
MOST_CENTRES = 1024  # of either half
BLOCK = 1024  # members of a cell that are compared in one group
VISITORS = 8192  # and visitors
SEED = 11


class Index(NamedTuple):
    """Codebooks of the two halves of a vector, and how far a walk over the cells goes."""

    first: np.ndarray
    second: np.ndarray
    reach: float


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of a half, by Lloyd's rounds."""
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(12):
        own = _distances(x, centres).argmin(axis=1)
        for c in range(len(centres)):
            mine = x[own == c]
            if len(mine):
                centres[c] = mine.mean(axis=0)
    return centres


def margins(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance from each half to the border of each centre's region, 0 for its own: what a
    neighbour must have moved by, at the least, to lie there."""
    d = _distances(x, centres)
    own = d.argmin(axis=1)
    gap = np.sqrt(_distances(centres, centres))[own]
    step = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * gap, 1e-12)
    return np.where(np.arange(len(centres))[None] == own[:, None], 0.0, np.maximum(step, 0) ** 2)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def fit(sample: np.ndarray, rows: int, cosine: float = COSINE, recall: float = RECALL) -> Index:
    """Codebooks for about ``rows`` vectors, and the reach of the walk: how far the cells' summed
    margins may go so that ``recall`` of the partners of the sample's vectors is met. The partners are
    made by turning each vector to a random direction until the cosine is just the limit: real links
    are closer. A walk from either end finds a link, so that both must miss it for it to be lost."""
    rng = np.random.default_rng(SEED)
    k = int(min(MOST_CENTRES, max(1, 2 ** round(math.log2(max(1.0, math.sqrt(rows / IN_CELL)))))))
    a, b = halves(sample)
    first = _codebook(a, k, rng)
    second = _codebook(b, k, rng) if b.shape[1] else np.zeros((1, 0))
    noise = rng.normal(size=sample.shape)
    noise -= (noise * sample).sum(1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    moved = cosine * sample + math.sqrt(1 - cosine * cosine) * noise
    rest = np.arange(len(sample))
    total = np.zeros(len(sample))
    for own, other, centres in zip(halves(sample), halves(moved), (first, second)):
        if centres.shape[1]:
            total += margins(own, centres)[rest, _distances(other, centres).argmin(axis=1)]
    return Index(first, second, float(np.quantile(total, recall)) if len(total) else 0.0)


def _cells(index: Index, x: np.ndarray) -> np.ndarray:
    a, b = halves(x)
    i = _distances(a, index.first).argmin(axis=1)
    j = _distances(b, index.second).argmin(axis=1) if b.shape[1] else np.zeros(len(x), np.int64)
    return i * len(index.second) + j


def walk(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells that each vector visits: both halves' centres are put in the order of
    their margins, and the grid of pairs is gone through from the nearest on until the sum of the two
    margins is beyond the reach. A row of the grid ends at its first pair that is too far, and so does
    the column of rows."""
    a, b = halves(x)
    da = margins(a, index.first)
    db = margins(b, index.second) if b.shape[1] else np.zeros((len(x), 1))
    oa, ob = np.argsort(da, axis=1, kind="stable"), np.argsort(db, axis=1, kind="stable")
    da, db = np.take_along_axis(da, oa, 1), np.take_along_axis(db, ob, 1)
    rows, cells = [], []
    for p in range(da.shape[1]):
        near = da[:, p] <= index.reach
        if not near.any():
            break
        for q in range(db.shape[1]):
            hit = np.flatnonzero(near & (da[:, p] + db[:, q] <= index.reach))
            if not len(hit):
                break
            rows.append(hit)
            cells.append(oa[hit, p] * len(index.second) + ob[hit, q])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cells)


def _visits(index: Index, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether the walk of each vector (rows) gets to each of the cells (columns)."""
    a, b = halves(x)
    da = margins(a, index.first)[:, cells // len(index.second)]
    db = margins(b, index.second)[:, cells % len(index.second)] if b.shape[1] else 0.0
    return da + db <= index.reach


class _Forest:
    """Edges that keep what links between visitors and members connect: a visitor to one member of each
    group of members that it touches, which are then one group."""

    def __init__(self, members: np.ndarray) -> None:
        self.members, self.group = members, np.arange(len(members))
        self.edges: list[tuple[int, int]] = []

    def add(self, visitors: np.ndarray, link: np.ndarray) -> None:
        for i in np.flatnonzero(link.any(axis=1)).tolist():
            touched = np.unique(self.group[link[i]])
            self.edges += [(int(visitors[i]), int(self.members[g])) for g in touched]
            if len(touched) > 1:
                self.group[np.isin(self.group, touched)] = touched[0]


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.to_list(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that can link: not NULL, not empty, all components finite, not all
    zero; as doubles."""
    v = F.transform(F.col(embedding), lambda c: c.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where("v is not null and vec_id is not null").where(finite & F.exists("v", lambda c: c != 0))


def _slices(batch: pd.DataFrame, column: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for at in range(0, len(batch), BLOCK):
        part = batch.iloc[at:at + BLOCK]
        yield part, np.array(part[column].to_list(), np.float64)


def _links_of_length(distinct: DataFrame, dim: int, rows: int, cosine: float) -> DataFrame:
    """(kind, a, b, n): how many others ``a`` is linked with (kind 0, to be added up), and edges (kind 1)."""
    mine = distinct.where(F.size("v") == dim)
    sample = mine.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toPandas()
    index = fit(_unit(sample["v"]), rows, cosine)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, v in _slices(batch, "v"):
                x = v / np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "own": _cells(index, x),
                                    "copies": part["copies"].to_numpy(), "x": list(x)})

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, x in _slices(batch, "x"):
                r, cells = walk(index, x)
                yield pd.DataFrame({"node": part["node"].to_numpy()[r], "cell": cells})

    members = written(mine.select("node", "copies", "v").mapInPandas(
        placed, "node long, own long, copies long, x array<double>"), "multi-index")
    visits = written(members.select("node", "x").mapInPandas(walked, "node long, cell long"), "multi-index-walks")
    # A crowded cell is split, and so are those who visit it; each part of the one meets each of the other.
    held = members.groupBy(F.col("own").alias("cell")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(VISITORS)).cast("int").alias("crowds"))
    split = written(held.join(asked, "cell"), "multi-index-parts")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    columns = ["cell", "part", "crowd", "node", "own", "copies", "x", "member"]
    inside = members.withColumn("cell", F.col("own")).join(split, "cell").withColumn("part", one("parts")).withColumn(
        "crowd", every("crowds")).withColumn("member", F.lit(True)).select(columns)
    outside = visits.join(split, "cell").join(members, "node").withColumn("crowd", one("crowds")).withColumn(
        "part", every("parts")).withColumn("member", F.lit(False)).select(columns)

    def met(group: pd.DataFrame) -> pd.DataFrame:
        home, guests = group[group["member"]], group[~group["member"]]
        out: list[tuple] = []
        if len(home) and len(guests):
            x, ids, copies = np.array(home["x"].to_list()), home["node"].to_numpy(), home["copies"].to_numpy()
            degree, forest = np.zeros(len(home), np.int64), _Forest(ids)
            for part, y in _slices(guests, "x"):
                others, weight = part["node"].to_numpy(), part["copies"].to_numpy()
                link = (y @ x.T >= cosine) & (others[:, None] != ids[None, :])
                if not link.any():
                    continue
                # A pair that both walks find counts where the visitor has the larger id.
                cells, which = np.unique(part["own"].to_numpy(), return_inverse=True)
                found_back = _visits(index, x, cells)[:, which].T
                link &= ~found_back | (others[:, None] > ids[None, :])
                degree += weight @ link
                out += [(0, int(o), None, int(n)) for o, n in zip(others, link @ copies) if n]
                forest.add(others, link)
            out += [(0, int(i), None, int(n)) for i, n in zip(ids, degree) if n]
            out += [(1, a, b, None) for a, b in forest.edges]
        return pd.DataFrame(out, columns=["kind", "a", "b", "n"]).astype({"b": "Int64", "n": "Int64"})

    groups = inside.unionByName(outside).groupBy("cell", "part", "crowd")
    return groups.applyInPandas(met, "kind int, a long, b long, n long")


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Equal vectors are one node with its number of copies. Codebooks of both halves are fitted on a
    bounded sample, every vector is entered into the cell of its two nearest centres, and walks from
    its nearest cells on until the reach that the target recall asks for. In the cells the cosine is
    computed in full in double precision; pairs are counted and reduced to spanning edges where they
    are met, and never leave the task. Vectors that are NULL, empty, zero, or hold a NULL or a
    component that is not finite link with nothing, and those of different lengths not with each
    other. Rows that share a vec_id are one vector each; a row without one has no links and no
    component of its own. An empty table gives no rows; other columns are ignored.
    """
    good = usable(vectors, vec_id, embedding)
    node = F.min("vec_id").alias("node")
    distinct = written(good.groupBy("v").agg(node, F.count("*").alias("copies")), "vectors")
    lengths = distinct.groupBy(F.size("v").alias("dim")).count().collect()
    found = None
    for row in sorted(lengths, key=lambda r: r["dim"]):
        one = _links_of_length(distinct, row["dim"], row["count"], cosine)
        found = one if found is None else found.unionByName(one)
    named = vectors.select(F.col(vec_id).alias("vec_id"),
                           F.transform(F.col(embedding), lambda c: c.cast("double")).alias("v"))
    if found is None:
        out = named.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
    else:
        found = written(found, "vector-links")
        degree = found.where("kind = 0").groupBy("a").agg(F.sum("n").alias("far"))
        groups = components(found.where("kind = 1").select("a", "b"), "vector-components")
        nodes = distinct.join(degree, F.col("node") == F.col("a"), "left").drop("a")
        nodes = nodes.join(groups.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        nodes = nodes.select("v", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("root", "node").alias("component_id"))
        out = named.join(nodes, "v", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
        out = out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

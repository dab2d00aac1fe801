"""Exact nearest neighbours without comparing all pairs.

A bounded number of rows, drawn by a hash of their number, serve as pivots. Every row belongs to the
cell of its nearest pivot, and a cell knows how near and how far its rows are. By the triangle
inequality a query that is d from a pivot is at least d - far from every row of its cell. Its distance to
pivots, which are rows themselves, bounds its k-th best from above before any row is compared; cells
beyond that bound are never visited. Cells of many rows, and of many visitors, are dealt over parts,
so that a task compares two bounded blocks.

How much is saved depends on the data: rows that lie in groups are compared with few cells, rows
spread evenly over many dimensions with most of them. Where a bounded number of queries shows that they
visit many cells, both sides are dealt to a grid of blocks instead, and all blocks meet: a row then
goes to as many tasks as the grid is wide, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


@dataclass(frozen=True)
class Params:
    """cell: rows of a cell, about. most: pivots, at most. block: rows of one side in a task. visits: cells
    that a query may visit on average before all blocks meet; these are ``grid`` to a side, more only where
    they would have over ``wide`` rows."""

    cell: int = 256
    most: int = 4096
    block: int = 4096
    visits: int = 64
    grid: int = 16
    wide: int = 131_072


@dataclass(frozen=True)
class Cells:
    """Pivots, and for each cell the number of rows, how near and far they are from the pivot; ``most_own``:
    rows of the camera that has most."""

    lane: np.ndarray
    camera: np.ndarray
    pivot: np.ndarray
    count: np.ndarray
    near: np.ndarray
    far: np.ndarray
    most_own: int
    scale: float = field(default=1.0)

    def distance(self, x: np.ndarray) -> np.ndarray:
        """From each row to each pivot."""
        square = (x * x).sum(1)[:, None] - 2 * (x @ self.pivot.T) + (self.pivot * self.pivot).sum(1)
        return np.sqrt(np.maximum(square, 0))

    def least(self, d: np.ndarray) -> np.ndarray:
        """A lower bound on the distance to any row of each cell."""
        return np.maximum(np.maximum(d - self.far, self.near - d), 0)

    @property
    def slack(self) -> float:
        """What squared distances may be wrong by, with nine digits of a similarity."""
        return 1e-7 * self.scale**2


#: Distances to pivots that a task holds at a time, about; it has several such arrays.
HELD = 1 << 20


def slices(stream: Iterator[pd.DataFrame], pivots: int) -> Iterator[pd.DataFrame]:
    """The rows in tables so short that their distances to pivots take little memory, however many pivots there are."""
    step = max(1, HELD // max(1, pivots))
    for t in stream:
        for first in range(0, len(t), step):
            yield t.iloc[first : first + step]


def stacked(lists: pd.Series) -> np.ndarray:
    return np.stack(lists.to_numpy()).astype(float)


def build(refs: DataFrame, p: Params = Params()) -> tuple[DataFrame | None, Cells | None]:
    """``refs`` (lane, camera, e) with their cells, and what is known of these. No rows give none."""
    n, own = refs.groupBy("camera").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if not n:
        return None, None
    pivots = refs.orderBy(F.xxhash64("lane"), "lane").limit(int(min(p.most, max(1, n // p.cell)))).toPandas()  # at most ``most`` rows
    lane, camera, pivot = pivots.lane.to_numpy(), pivots.camera.to_numpy(), stacked(pivots.e)
    start = Cells(lane, camera, pivot, *(np.zeros(len(pivot)) for _ in range(3)), most_own=int(own))

    def assign(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in slices(stream, len(pivot)):
            d = start.distance(stacked(t.e))
            yield t.assign(cell=d.argmin(axis=1), r=d.min(axis=1, initial=np.inf))

    kind = dict(refs.dtypes)
    rows = refs.select("lane", "camera", "e").mapInPandas(assign, f"lane {kind['lane']}, camera {kind['camera']}, e {kind['e']}, cell int, r double")
    rows, _ = written(rows, "cells")
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    known = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("near"), F.max("r").alias("far"), F.max(norm).alias("norm")).toPandas()  # a row a pivot
    count, near, far = np.zeros(len(pivot), np.int64), np.zeros(len(pivot)), np.full(len(pivot), -np.inf)
    count[known.cell], near[known.cell], far[known.cell] = known.n, known.near, known.far
    return rows, Cells(lane, camera, pivot, count, near, far, int(own), max(float(known.norm.max()), 1e-9))


def bounds(cells: Cells, d: np.ndarray, lane: np.ndarray, camera: np.ndarray, k: int, other_camera: bool) -> np.ndarray:
    """An upper bound on each query's k-th best distance, from its distances to pivots alone."""
    own = camera[:, None] == cells.camera if other_camera else lane[:, None] == cells.lane
    out = np.full(len(d), np.inf)
    if d.shape[1] >= k:
        out = np.partition(np.where(own, np.inf, d), k - 1, axis=1)[:, k - 1]
    # the cells that surely hold k rows of others
    whole = np.where(cells.count > 0, d + cells.far, np.inf)
    order = np.argsort(whole, axis=1)
    enough = np.cumsum(cells.count[order], axis=1) >= k + (cells.most_own if other_camera else 1)
    first = enough.argmax(axis=1)
    rows = np.arange(len(d))
    return np.minimum(out, np.where(enough[rows, first], whole[rows, order[rows, first]], np.inf))


def visit(queries: DataFrame, refs: DataFrame, cells: Cells, choose: Callable[[pd.DataFrame, np.ndarray], np.ndarray], compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, p: Params = Params(), extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """What ``compare`` gives for each block of queries and each block of a cell that they visit; pairs compared.

    ``choose`` tells, from queries and their distances to pivots, which cells each visits. Both sides have
    lane, camera, e and the columns ``extra``; ``refs`` have cell.
    """
    columns = ["lane", "camera", "e", *extra]
    kind = dict(queries.dtypes)

    def ask(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in slices(stream, len(cells.count)):
            at = choose(t, cells.distance(stacked(t.e))) & (cells.count > 0)
            yield t.assign(cells=[np.flatnonzero(row).tolist() for row in at])

    asked, _ = written(queries.select(*columns).mapInPandas(ask, ", ".join(f"{c} {kind[c]}" for c in columns) + ", cells array<int>"), "asked")
    asked = asked.select(*columns, F.explode("cells").alias("cell"))
    visits = asked.groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # a row a pivot
    pairs = int((visits.n * cells.count[visits.cell]).sum())
    parts = [(int(c), max(1, -(-int(n) // p.block)), max(1, -(-int(cells.count[c]) // p.block))) for c, n in zip(visits.cell, visits.n, strict=True)]
    dealt = F.broadcast(queries.sparkSession.createDataFrame(parts, "cell int, nq int, nr int"))  # a row a pivot
    h = F.xxhash64("lane")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(dealt, "cell").select(F.lit(0).alias("side"), "cell", F.pmod(h, F.col("nq")).cast("int").alias("bq"), every("nr").alias("br"), *columns)
    right = refs.join(dealt, "cell").select(F.lit(1).alias("side"), "cell", every("nq").alias("bq"), F.pmod(h, F.col("nr")).cast("int").alias("br"), *columns)
    nothing = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, r = rows[rows.side == 0], rows[rows.side == 1].sort_values("lane")
        return compare(q, r) if len(q) and len(r) else nothing

    return left.unionByName(right).groupBy("cell", "bq", "br").applyInPandas(run, schema), pairs


def many_visits(queries: DataFrame, cells: Cells, choose: Callable[[pd.DataFrame, np.ndarray], np.ndarray], p: Params = Params()) -> bool:
    """Whether queries visit many cells. Some of them, drawn by their number, only tell which way is shorter."""
    if len(cells.count) <= p.visits:
        return False
    some = queries.orderBy(F.xxhash64("lane"), "lane").limit(512).toPandas()
    return len(some) > 0 and float((choose(some, cells.distance(stacked(some.e))) & (cells.count > 0)).sum(axis=1).mean()) > p.visits


def meet(queries: DataFrame, refs: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, p: Params = Params(), extra: tuple[str, ...] = ()) -> DataFrame:
    """What ``compare`` gives for each block of queries and each block of all ``refs``; both have lane, camera, e and ``extra``."""
    columns = ["lane", "camera", "e", *extra]

    def blocks(n: int) -> int:
        return max(1, min(p.grid, -(-n // p.block)), -(-n // p.wide))

    nq, nr = blocks(queries.count()), blocks(refs.count())
    h = F.xxhash64("lane")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.lit(0).alias("side"), F.pmod(h, F.lit(nq)).cast("int").alias("bq"), every(nr).alias("br"), *columns)
    right = refs.select(F.lit(1).alias("side"), every(nq).alias("bq"), F.pmod(h, F.lit(nr)).cast("int").alias("br"), *columns)
    nothing = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, r = rows[rows.side == 0], rows[rows.side == 1].sort_values("lane")
        return compare(q, r) if len(q) and len(r) else nothing

    return left.unionByName(right).groupBy("bq", "br").applyInPandas(run, schema)


def largest(x: np.ndarray, y: np.ndarray, own_x: np.ndarray, own_y: np.ndarray, k: int, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j and x[i] @ y[j] of the pairs that may be among the k largest of an i, by slices of x; pairs of the same owner never are.

    Pairs less than the k-th by no more than ``slack`` come, too. Rows that hold non-finite numbers have no pairs.
    """
    rows, at = np.flatnonzero(np.isfinite(x).all(axis=1)), np.flatnonzero(np.isfinite(y).all(axis=1))
    codes = pd.factorize(np.concatenate([own_x[rows], own_y[at]]))[0]
    of_x, of_y = codes[: len(rows)], codes[len(rows) :]
    order = np.argsort(of_y, kind="stable")
    at, of_y = at[order], of_y[order]
    begin, end = np.searchsorted(of_y, of_x, "left"), np.searchsorted(of_y, of_x, "right")
    y = y[at].T
    n = y.shape[1]
    if not n:
        return
    groups = min(n, max(256, 16 * k))
    deep = n // groups
    step = max(1, 4_000_000 // n)
    for first in range(0, len(rows), step):
        s = x[rows[first : first + step]] @ y
        for m in range(len(s)):
            s[m, begin[first + m] : end[first + m]] = -np.inf
        # the k-th of the groups' largest is no more than the k-th of all
        tops = s[:, : groups * deep].reshape(len(s), deep, groups).max(axis=1)
        kth = np.partition(tops, groups - k, axis=1)[:, groups - k] if groups >= k else np.full(len(s), -np.inf)
        i, j = np.nonzero(s >= np.maximum(kth - slack, -1e300)[:, None])
        yield rows[first + i], at[j], s[i, j]


def first_of(i: np.ndarray, k: int, *by: np.ndarray) -> np.ndarray:
    """Places of the first k of each i in the order of ``by``."""
    order = np.lexsort((*reversed(by), i))
    ordered = i[order]
    return order[np.arange(len(i)) - np.searchsorted(ordered, ordered, "left") < k]


def k_nearest(queries: DataFrame, refs: DataFrame, k: int, other_camera: bool = True, p: Params = Params()) -> tuple[DataFrame | None, int]:
    """query, ref, sim of a few candidates that hold each query's k most similar rows; pairs compared."""
    # both sides are read several times, and may be much work to make
    once = written(refs.select("lane", "camera", "e"), "refs")[0]
    queries, refs = once if queries is refs else written(queries.select("lane", "camera", "e"), "queries")[0], once
    rows, cells = build(refs, p)
    if cells is None:
        return None, 0
    schema, name = "query long, ref long, sim double", "camera" if other_camera else "lane"

    def choose(t: pd.DataFrame, d: np.ndarray) -> np.ndarray:
        u = bounds(cells, d, t.lane.to_numpy(), t.camera.to_numpy(), k, other_camera)
        return cells.least(d) ** 2 <= (u * u)[:, None] + cells.slack

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        lanes, refs_ = q.lane.to_numpy(), r.lane.to_numpy()
        out = []
        for i, j, sim in largest(stacked(q.e), stacked(r.e), q[name].to_numpy(), r[name].to_numpy(), k, 2e-9):
            some = first_of(i, k, -np.round(sim, 9), refs_[j])
            out.append(pd.DataFrame({"query": lanes[i[some]], "ref": refs_[j[some]], "sim": sim[some]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "ref": [], "sim": []})

    if many_visits(queries, cells, choose, p):
        return meet(queries, refs, compare, schema, p), queries.count() * int(cells.count.sum())
    return visit(queries, rows, cells, choose, compare, schema, p)

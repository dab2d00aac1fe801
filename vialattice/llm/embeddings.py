"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A random rotation cuts a vector into blocks, and each block has its own random directions. A filter
is one direction of each block, so few directions span very many filters. A vector is decoded to
the list of all filters whose inner product comes within ``slack`` of its best one, by extending
partial codes block by block and dropping those that already lost too much. Vectors that share a
filter and a label are compared in double precision: small groups many at a time, large ones in
blocks of bounded size. The number of directions grows with the number of different vectors, so
that groups by chance stay small.

Of a pair with cosine c, each vector's best filter has with the other vector an inner product lower
by about (1-c) of it, with a spread of sqrt((1-c*c)/d). ``slack`` is several such spreads, and either
vector's best filter is enough, so pairs are missed with a probability far below one in a million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, drop_path, materialize, pick, tidied, whole_groups
from .graph import components


@dataclass(frozen=True)
class Params:
    """cosine: least of a link. blocks, directions: of the product code; the directions are those for
    up to ``planned`` different vectors, beyond which they grow with the root that keeps the filters
    in proportion, up to ``most_directions``. slack: of the inner product of unit vectors at 64
    dimensions, scaled for others. at_once: most vectors in a compared block. One direction puts all
    vectors of a label under one filter, which is the exact comparison in blocks."""

    cosine: float = 0.98
    blocks: int = 3
    directions: int = 64
    slack: float = 0.045
    planned: int = 65_536
    most_directions: int = 1024
    at_once: int = 1024
    seed: int = 20260

    def at_size(self, n: int) -> Params:
        """The parameters for n different vectors."""
        if self.directions == 1:
            return self
        more = self.directions * (max(n, self.planned) / self.planned) ** (1 / self.blocks)
        return replace(self, directions=min(max(self.most_directions, self.directions), math.ceil(more)))

    def slack_at(self, d: int) -> float:
        return self.slack * (64 / max(d, 1)) ** 0.5


@lru_cache(maxsize=8)
def _code(d: int, p: Params) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation and each block's directions for vectors of d components."""
    rng = np.random.default_rng([p.seed, d])
    rotation, _ = np.linalg.qr(rng.standard_normal((d, d)))
    blocks = max(1, min(p.blocks, d // 8))
    sizes = [len(x) for x in np.array_split(np.arange(d), blocks)]
    found = [rng.standard_normal((p.directions, n)) for n in sizes]
    return rotation, [x / np.linalg.norm(x, axis=1, keepdims=True) / blocks**0.5 for x in found]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, without overflow."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def decode(vectors: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters whose inner product is within the slack of the row's best."""
    d = vectors.shape[1]
    rotation, code = _code(d, p)
    x, most = unit(vectors) @ rotation, p.slack_at(d)
    row, filters, lost = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    at = 0
    for directions in code:
        score = x[:, at : at + directions.shape[1]] @ directions.T
        at += directions.shape[1]
        short = score.max(axis=1, keepdims=True) - score
        of, which = np.nonzero(short <= most)
        count = np.bincount(of, minlength=len(x))
        start = np.cumsum(count) - count
        times = count[row]
        take = np.repeat(start[row], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, filters, lost = np.repeat(row, times), np.repeat(filters, times) * p.directions + which[take], np.repeat(lost, times) + short[of[take], which[take]]
        row, filters, lost = row[lost <= most], filters[lost <= most], lost[lost <= most]
    return row, filters


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _with_filters(classes: DataFrame, p: Params) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 512):
            size = np.asarray(batch.column(1).value_lengths())
            lists: list = [None] * len(size)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                row, filters = decode(_matrix(batch.column(1).take(pa.array(rows))), p)
                order = np.lexsort((filters, row))
                for k, part in enumerate(np.split(filters[order], np.cumsum(np.bincount(row, minlength=len(rows)))[:-1])):
                    lists[rows[k]] = part
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["id", "filters"])

    return classes.select("id", "embedding").mapInArrow(tidied(run), "id long, filters array<long>")


#: Groups of more vectors than this are compared as a matrix, smaller ones together.
SMALL = 32

MEMBER = ("label_key", "dims", "filter", "i", "j", "block", "id", "copies", "label", "embedding", "filters")


def _pairs(t: pa.Table, x: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (a < b, by row) within the groups of a table that is sorted by group."""
    keys = np.stack([t[c].to_numpy() for c in MEMBER[:5]], axis=1)
    group = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)])
    size = np.bincount(group)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = size[group] <= SMALL
    for step in range(1, int(size[size <= SMALL].max(initial=0))):
        a = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        near = np.einsum("ij,ij->i", x[a], x[a + step]) >= p.cosine
        left.append(a[near])
        right.append(a[near] + step)
    first = np.cumsum(size) - size
    part = t["block"].to_numpy() != t["i"].to_numpy()
    for g in np.flatnonzero(size > SMALL):
        rows = slice(first[g], first[g] + size[g])
        near = np.triu(x[rows] @ x[rows].T >= p.cosine, 1)
        if part[rows].any():  # two blocks meet: only pairs across count
            near &= part[rows][:, None] != part[rows][None, :]
        a, b = np.nonzero(near)
        left.append(a + first[g])
        right.append(b + first[g])
    a, b = np.concatenate(left), np.concatenate(right)
    label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    same = label[a] == label[b]  # keys of labels are hashes
    return a[same], b[same]


def _first_met(lists: pa.ListArray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of rows has no filter in common that is less than the one it meets under."""
    n = np.asarray(lists.value_lengths())
    start, values = np.cumsum(n) - n, lists.flatten().to_numpy()
    of = np.repeat(np.arange(len(n)), n)
    every = (of << 40) + values  # ascending: a row's filters are sorted
    lesser = np.bincount(of, values < key[of], len(n)).astype(np.int64)
    swap = lesser[a] > lesser[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    times = lesser[a]
    pair = np.repeat(np.arange(len(a)), times)
    value = values[np.repeat(start[a], times) + np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)]
    wanted = (b[pair] << 40) + value
    at = np.searchsorted(every, wanted)
    met = (at < len(every)) & (every[np.minimum(at, len(every) - 1)] == wanted) if len(every) else np.zeros(0, bool)
    return np.bincount(pair, met, len(a)) == 0


def _compare(t: pa.Table, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over whole groups: linked ids, links that no lesser filter has counted, and who they hang on."""
    ids, copies, key = (t[c].to_numpy() for c in ("id", "copies", "filter"))
    x = unit(_matrix(t["embedding"].combine_chunks()))
    a, b = _pairs(t, x, p)
    own = _first_met(t["filters"].combine_chunks(), key, a, b)
    links, to = np.zeros(len(ids), np.int64), np.arange(len(ids))
    np.add.at(links, a[own], copies[b[own]])
    np.add.at(links, b[own], copies[a[own]])
    while len(a):
        least = np.minimum(to[a], to[b])
        if (to[a] == least).all() and (to[b] == least).all():
            break
        np.minimum.at(to, a, least)
        np.minimum.at(to, b, least)
    linked = np.unique(np.concatenate([a, b]))
    return ids[linked], links[linked], ids[to[linked]]


def _scan(rows: DataFrame, p: Params) -> DataFrame:
    """rows: sorted by (label_key, dims, filter, i, j) in each partition."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(stream, range(5), 4 * p.at_once):
            for dims in np.unique(t["dims"].to_numpy()):
                found = _compare(t.filter(pa.array(t["dims"].to_numpy() == dims)).combine_chunks(), p)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "links", "to"])

    return rows.select(*MEMBER).mapInArrow(tidied(run), "id long, links long, to long")


def near_duplicates(embeddings: DataFrame, p: Params | None = None) -> DataFrame:
    """Link vectors of equal label whose cosine reaches ``p.cosine``.

    Returns vec_id, n_links, component_id, kept for each row. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null label, link with nothing; so do vectors
    of different lengths. Equal vectors count once in the search and each in ``n_links``. A null
    vec_id links with nothing, has no component and is kept. Rows that repeat a vec_id are each
    returned and count as two vectors. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    p = p or Params()
    rows = pick(embeddings, "vec_id", "embedding", "label")
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False))
    # equal vectors of a label have equal keys of 128 bits; other rows have none
    rows = rows.withColumns({f"h{k}": F.when(valid, F.xxhash64(F.lit(k), "label", "embedding")) for k in (1, 2)})
    used: list[str] = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        df, path = materialize(df, tag)
        used.append(path)
        return df

    key = ["h1", "h2"]
    classes = rows.where("h1 is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").cast("string").alias("label"), F.first("embedding").alias("embedding"))
    classes = kept(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so an id stays with its class
    p = p.at_size(classes.count())
    known = kept(_with_filters(classes, p), "filters").join(classes, "id")
    known = kept(known.select("id", "copies", "label", "embedding", "filters", F.xxhash64("label").alias("label_key"), F.size("embedding").alias("dims")), "known")

    group = ["label_key", "dims", "filter"]
    hits = known.select("id", "label_key", "dims", F.explode("filters").alias("filter"))
    shared = hits.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").select(*group, F.ceil(F.col("n") / F.lit(p.at_once // 2)).alias("n_blocks"))
    placed = hits.join(shared, group).select("id", "filter", "n_blocks", F.pmod(F.xxhash64("id"), F.col("n_blocks")).alias("block"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("other")
    placed = placed.select("id", "filter", "block", other).select("id", "filter", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sent = placed.join(known, "id").repartition(*MEMBER[:5]).sortWithinPartitions(*MEMBER[:5], "id")
    found = kept(_scan(sent, p), "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = kept(components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))), "parts")
    named = classes.select("id", "rep").join(parts, "id")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("name")), "component").select("id", "name")
    labels = classes.select(*key, "id", "copies", "rep").join(links, "id", "left").join(named, "id", "left")
    labels = labels.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "rep").alias("component"), "copies")
    # rows of a class with many copies are dealt over salts first, the others by their keys
    salts = 64
    common = labels.where(f"copies >= {salts * 16}").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("copies")
    keyed = rows.select("vec_id", *key).withColumn("salt", F.when(F.col("h1").isNotNull(), F.pmod(F.xxhash64("vec_id"), F.lit(salts))).cast("int"))
    met = kept(keyed.join(common, [*key, "salt"], "left"), "met").drop("salt")
    rest = met.where("component is null").select("vec_id", *key).join(labels.drop("copies"), key, "left")
    out = met.where("component is not null").select(*rest.columns).unionByName(rest)
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    out, _ = materialize(out, "near-vectors")
    for path in used:
        drop_path(embeddings.sparkSession, path)
    return out

"""Matching of lanes by embeddings and roles.

``index``: lane, camera, grp, ordinal, rank, is_left, is_right, has_successor, group_size, role, e (unit
length). Nearest neighbours are searched in the cells that can hold them: each task multiplies a block
of queries with a block of a cell and keeps each query's best few, which a second step merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, LaneConfig
from ..functions import vectors as v
from ..tables import drop, written
from . import neighbours

MATCH = "query long, ref long, sim double"
#: Pairs that a task makes at a time.
SLICE = 1 << 17


def positive_pairs(index: DataFrame, config: LaneConfig = DEFAULT, block: int = 1024) -> DataFrame:
    """Pairs of lanes of different cameras with alike roles.

    Roles are compared once for each two kinds of lanes, which have the same edge flags, rank and role;
    a kind is sent to its rank's bin and the two beside it, so that only near ranks meet. Lanes of a kind
    are dealt to blocks of about ``block``, and two blocks of alike kinds are paired in one row, so
    that no task has more than its share of the pairs, whose number grows with the square of the lanes'.
    A row's pairs are made in slices, as a million rows made of one by Spark would all wait in memory.
    """
    of = dict(index.dtypes)["lane"]
    return _met(index, config, block).mapInArrow(_expanded, f"i {of}, j {of}")


def _met(index: DataFrame, config: LaneConfig, block: int) -> DataFrame:
    """once, lanes_i, lanes_j: each two blocks of alike kinds, in even tasks; once: a block with itself."""
    gap = config.rank_gap
    same = ["is_left", "is_right", "rank", "role"]
    kinds = index.groupBy(*same).agg(F.min("lane").alias("kind"), F.count("*").alias("n"))
    bin_ = F.floor(F.col("rank") / gap)
    a = kinds.select("is_left", "is_right", bin_.alias("bin"), F.col("kind").alias("kind_i"), F.col("rank").alias("rank_i"), F.col("role").alias("role_i"))
    b = kinds.select("is_left", "is_right", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"), F.col("kind").alias("kind_j"), F.col("rank").alias("rank_j"), F.col("role").alias("role_j"))
    near = F.round(F.abs(F.col("rank_i") - F.col("rank_j")), 9) <= gap
    alike = F.round(v.cosine(F.col("role_i"), F.col("role_j")), 9) >= config.role_cosine
    pairs = a.join(b, ["is_left", "is_right", "bin"]).where((F.col("kind_i") <= F.col("kind_j")) & near & alike).select("kind_i", "kind_j")
    dealt = F.pmod(F.xxhash64("lane"), F.ceil(F.col("n") / block))
    blocks = index.where("lane is not null and camera is not null").join(kinds, same).groupBy("kind", dealt.alias("b")).agg(F.collect_list(F.struct("lane", "camera")).alias("lanes"))
    i = blocks.select(F.col("kind").alias("kind_i"), F.col("b").alias("b_i"), F.col("lanes").alias("lanes_i"))
    j = blocks.select(F.col("kind").alias("kind_j"), F.col("b").alias("b_j"), F.col("lanes").alias("lanes_j"))
    met = pairs.join(i, "kind_i").join(j, "kind_j").where((F.col("kind_i") < F.col("kind_j")) | (F.col("b_i") <= F.col("b_j")))
    spark = index.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    met = met.repartition(tasks, "kind_i", "b_i", "kind_j", "b_j")
    once = (F.col("kind_i") == F.col("kind_j")) & (F.col("b_i") == F.col("b_j"))
    return met.select(once.alias("once"), "lanes_i", "lanes_j")


def _expanded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each row's two blocks (once, lanes_i, lanes_j: lists of lane, camera), but those of one camera; of a block with itself each pair once."""
    for batch in stream:
        for k, once in enumerate(batch.column("once").to_pylist()):
            x, y = (batch.column(c)[k].values for c in ("lanes_i", "lanes_j"))
            a, b = (t.field("lane").to_numpy(zero_copy_only=False) for t in (x, y))
            of = pa.concat_arrays([x.field("camera"), y.field("camera")]).dictionary_encode().indices.to_numpy()
            of_a, of_b = of[: len(a)], of[len(a) :]
            step = max(1, SLICE // len(b))
            for first in range(0, len(a), step):
                part = a[first : first + step, None]
                keep = of_a[first : first + step, None] != of_b
                keep &= part < b if once else part != b
                i, j = np.nonzero(keep)
                i, j = a[first + i], b[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["i", "j"])


def retrieve(index: DataFrame, asked: DataFrame, k: int = 3, cross_camera: bool = True, excluded: DataFrame | None = None) -> DataFrame:
    """The k nearest lanes to lanes of the index by their number (J12), but those excluded.

    ``asked``, ``excluded``: a column lane.
    """
    refs = index if excluded is None else index.join(excluded.select("lane").distinct(), "lane", "left_anti")
    return nearest(index.join(asked.select("lane").distinct(), "lane", "left_semi"), refs, k, cross_camera)


def nearest(queries: DataFrame, refs: DataFrame, k: int = 1, other_camera: bool = True, params: neighbours.Params = neighbours.Params(), block: int | None = None) -> DataFrame:
    """The k most similar references of each query: query, ref, sim, place from 1.

    Both sides: lane, camera, e of unit length. References of the query's own camera, or the query
    itself, are left out. Similarities equal to nine digits go by the lower lane. Exact: cells that
    can't hold one of the k best are passed over. ``block``: rows of one side in a task, instead of ``params``'.
    """
    params = params if block is None else replace(params, block=block)
    found, _ = neighbours.k_nearest(queries, refs, k, other_camera, params)
    if found is None:
        return queries.sparkSession.createDataFrame([], MATCH + ", place int")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("sim", 9).desc(), "ref"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def with_roles(matches: DataFrame, index: DataFrame) -> DataFrame:
    """Matches with both lanes' roles."""
    role = ["rank", "is_left", "is_right", "has_successor", "role"]
    q = index.select(F.col("lane").alias("query"), "camera", *(F.col(c).alias(f"q_{c}") for c in role))
    r = index.select(F.col("lane").alias("ref"), *(F.col(c).alias(f"m_{c}") for c in role))
    return matches.join(q, "query").join(r, "ref")


def f1(predicted: Column, actual: Column) -> Column:
    """F1 of a flag over a group of rows; 0 where it isn't defined."""
    tp, fp, fn = (F.sum(c.cast("int")) for c in (predicted & actual, predicted & ~actual, ~predicted & actual))
    return F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def loco_metrics(matches: DataFrame) -> DataFrame:
    """Leave-one-camera-out metrics of each camera."""
    edge = (f1(F.col("m_is_left"), F.col("q_is_left")) + f1(F.col("m_is_right"), F.col("q_is_right"))) / 2
    both = (F.col("m_is_left") == F.col("q_is_left")) & (F.col("m_is_right") == F.col("q_is_right"))
    return matches.groupBy("camera").agg(
        F.avg("sim").alias("mean_match_sim"),
        F.avg(F.abs(F.col("q_rank") - F.col("m_rank"))).alias("mean_lat_rank_diff"),
        edge.alias("edge_f1"),
        F.avg(both.cast("double")).alias("edge_accuracy"),
        F.avg((F.col("m_has_successor") == F.col("q_has_successor")).cast("double")).alias("successor_accuracy"),
        F.avg(v.cosine(F.col("q_role"), F.col("m_role"))).alias("mean_role_similarity"),
        F.count("*").alias("n_query"),
    )


def macro(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over cameras."""
    long = metrics.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("m"))
    return long.groupBy("m.metric").agg(F.avg("m.value").alias("mean"), F.stddev_pop("m.value").alias("std"))


def role_filter(left: bool | None = None, right: bool | None = None, successor: bool | None = None, rank: float | None = None) -> Column:
    """Conjunction of what is asked for; unset parts ask nothing."""
    out = F.lit(True)
    for name, want in (("is_left", left), ("is_right", right), ("has_successor", successor)):
        if want is not None:
            out = out & (F.col(name) == want)
    return out if rank is None else out & (F.abs(F.col("rank") - rank) < 0.2)


def centroid(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row with the (weighted) mean vector."""
    w = F.lit(1.0) if weight is None else weight
    parts = rows.select(w.alias("w"), F.posexplode("e").alias("k", "x")).groupBy("k").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("e"))


def retrieve_by_role(index: DataFrame, condition: Column, k: int = 3) -> DataFrame:
    """Nearest lanes to the mean of the lanes that a filter keeps, or of all if it keeps none."""
    chosen = centroid(index.where(condition))
    mean = centroid(index).select(F.col("e").alias("all"))
    query = mean.crossJoin(chosen).select(F.when(F.size("e") > 0, F.col("e")).otherwise(F.col("all")).alias("q"))  # a row each
    sims = index.crossJoin(F.broadcast(query)).select(F.col("lane").alias("ref"), (v.dot(F.col("e"), F.col("q")) / F.greatest(v.norm(F.col("q")), F.lit(1e-8))).alias("sim"))
    best = sims.orderBy(F.round("sim", 9).desc(), "ref").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.round("sim", 9).desc(), "ref")))


def interpolate(matches: DataFrame, geometry: DataFrame) -> DataFrame:
    """Each query's matches' polylines, weighted by their positive similarities.

    ``geometry``: ref, k, x, y. Weights are equal where no similarity is positive.
    """
    query = Window.partitionBy("query")
    w = F.greatest(F.col("sim"), F.lit(0.0))
    total = F.sum(w).over(query)
    rows = matches.withColumn("w", F.when(total < 1e-8, 1.0 / F.count("*").over(query)).otherwise(w / total))
    return rows.join(geometry, "ref").groupBy("query", "k").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"))


def behaviour_weighted(index: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """Mean vector with a Gaussian weight of how near each lane's statistics are to those wanted."""
    if not wanted:
        return centroid(index)
    stds = index.agg(*(F.greatest(F.stddev_pop(n), F.lit(1e-8)).alias(f"std_{n}") for n in wanted))  # one row
    rows = index.crossJoin(F.broadcast(stds))
    d2 = sum((((F.col(n) - x) / F.col(f"std_{n}")) ** 2 for n, x in wanted.items()), F.lit(0.0))
    rows = rows.withColumn("w", F.exp(-d2 / 2))
    total = rows.agg(F.sum("w").alias("total"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("w", F.when(F.col("total") < 1e-8, 1.0).otherwise(F.col("w")))
    return centroid(rows, F.col("w"))


KINDS = ("same group", "same camera", "same rank", "other")
#: Ranges of similarity that pairs are counted in first.
FINE = 1 << 14


def _pair_blocks(index: DataFrame, block: int | None) -> DataFrame:
    """Lanes dealt to pairs of blocks, enough of these to keep a cluster busy."""
    n = index.count()
    blocks = max(1, -(-n // (block or max(128, min(2048, n // 16)))))
    b = F.pmod(F.xxhash64("lane"), F.lit(blocks)).cast("int")
    rows = index.select(b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"), "lane", "camera", "grp", "rank", "e")
    return rows.select(F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "lane", "camera", "grp", "rank", "e")


def _pairs_of(t: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lanes by number, and places, kind and similarity of their pairs; of two blocks only pairs across."""
    t = t.sort_values("lane", ignore_index=True)
    i, j = np.triu_indices(len(t), 1)
    own = t.b.to_numpy()
    if int(t.bi.iloc[0]) != int(t.bj.iloc[0]):
        keep = own[i] != own[j]
        i, j = i[keep], j[keep]
    e = np.stack(t.e.to_numpy())
    cam, grp, rank = (pd.factorize(t[c])[0] if c != "rank" else t[c].to_numpy() for c in ("camera", "grp", "rank"))
    sim = (e @ e.T)[i, j]
    same_cam, near = cam[i] == cam[j], np.round(np.abs(rank[i] - rank[j]), 9) < 0.15
    return t, i, j, np.where(same_cam, np.where(grp[i] == grp[j], 0, 1), np.where(near, 2, 3)), sim


def pair_types(index: DataFrame, block: int | None = None) -> DataFrame:
    """Every pair's kind and similarity (J18), compared in blocks: i, j, kind, sim."""

    def pairs(t: pd.DataFrame) -> pd.DataFrame:
        t, i, j, kind, sim = _pairs_of(t)
        lane = t.lane.to_numpy()
        return pd.DataFrame({"i": lane[i], "j": lane[j], "kind": np.asarray(KINDS, object)[kind], "sim": sim})

    return _pair_blocks(index, block).groupBy("bi", "bj").applyInPandas(pairs, "i long, j long, kind string, sim double")


def _grid(index: DataFrame, block: int | None) -> DataFrame:
    """Lanes dealt to pairs of blocks. There are at most 16 blocks, and more only where one would have over
    131,072 lanes, so that the shuffle is 16 copies of the table at most, however many lanes there are."""
    n = index.count()
    blocks = max(1, -(-n // block) if block else min(16, -(-n // 128)), -(-n // 131_072))
    b = F.pmod(F.xxhash64("lane"), F.lit(blocks)).cast("int")
    rows = index.select(b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"), "lane", "camera", "grp", "rank", "e")
    return rows.select(F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "lane", "camera", "grp", "rank", "e")


def _spans(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From where to where lanes of ``b``, which are in the order of their ranks, are near in rank to each lane of ``a``."""
    rank, (mine, at) = b["rank"].to_numpy(), np.unique(a["rank"].to_numpy(), return_inverse=True)
    near = lambda r: np.flatnonzero(np.round(np.abs(r - rank), 9) < 0.15)
    if len(mine) <= 64:
        found = [near(r) for r in mine]
        spans = np.array([(k[0], k[-1] + 1) if len(k) else (0, 0) for k in found]).reshape(-1, 2)[at]
        return spans[:, 0], spans[:, 1]
    first, last = np.searchsorted(rank, mine - 0.2), np.searchsorted(rank, mine + 0.2, "right")
    spans = np.zeros((len(mine), 2), np.int64)
    for k, r in enumerate(mine):
        some = np.flatnonzero(np.round(np.abs(r - rank[first[k] : last[k]]), 9) < 0.15)
        if len(some):
            spans[k] = first[k] + some[0], first[k] + some[-1] + 1
    return spans[at, 0], spans[at, 1]


def _by_kind(t: pd.DataFrame, top: float, rows: int = 256, columns: int = 1024):
    """kind, and places of similarities of pairs, each pair once: from 1 for -top to ``FINE`` + 1 for top.

    Small tiles stay in a processor's cache. Lanes lie in the order of their ranks, so that those near to a lane
    in rank are one range. Pairs on one camera, which are few to a lane, are taken out one by one; 0 stands in
    their place, and in that of pairs which come with the other lane.
    """
    t = t.sort_values(["rank", "lane"], ignore_index=True)
    own, same = t.b.to_numpy(), int(t.bi.iloc[0]) == int(t.bj.iloc[0])
    a, b = (t, t) if same else (t[own == t.bi.iloc[0]], t[own == t.bj.iloc[0]])
    if not len(a) or not len(b):
        return
    camera, grp = (pd.factorize(pd.concat([a[c], b[c]]))[0] for c in ("camera", "grp"))
    cam_a, cam_b, grp_a, grp_b = camera[: len(a)], camera[len(a) :], grp[: len(a)], grp[len(a) :]
    order = np.argsort(cam_b, kind="stable")
    begin, end = np.searchsorted(cam_b[order], cam_a, "left"), np.searchsorted(cam_b[order], cam_a, "right")
    low, high = _spans(a, b)
    scale = FINE / (2 * top)
    x, y = np.stack(a.e.to_numpy()) * scale, np.stack(b.e.to_numpy()).astype(float).T
    for first in range(0, len(a), rows):
        r = np.arange(first, min(first + rows, len(a)))
        n = end[r] - begin[r]
        i = np.repeat(r, n)
        j = order[np.repeat(begin[r] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        by = np.argsort(j, kind="stable")
        i, j = i[by], j[by]
        lo, hi = low[r], high[r]
        cuts = np.flatnonzero(np.r_[True, (np.diff(lo) != 0) | (np.diff(hi) != 0), True])
        for at in range(first // columns * columns if same else 0, len(b), columns):
            s = x[r] @ y[:, at : at + columns]
            s += 1 + top * scale
            if same:
                s[np.arange(at, at + s.shape[1]) <= r[:, None]] = 0
            some = slice(*np.searchsorted(j, (at, at + s.shape[1])))
            if some.start < some.stop:
                here, mate = s[i[some] - first, j[some] - at], grp_a[i[some]] == grp_b[j[some]]
                s[i[some] - first, j[some] - at] = 0
                yield 0, here[mate]
                yield 1, here[~mate]
            for c, to in zip(cuts[:-1], cuts[1:], strict=True):
                left, right = np.clip((lo[c] - at, hi[c] - at), 0, s.shape[1])
                for kind, part in ((2, s[c:to, left:right]), (3, s[c:to, :left]), (3, s[c:to, right:])):
                    if part.size:
                        yield kind, part.ravel()


def pair_type_stats(index: DataFrame, block: int | None = None) -> DataFrame:
    """Box statistics of the similarities of each kind of pair (A18), exact, without a row for each pair.

    Tasks multiply two blocks and count pairs by kind and range of similarity. The ranges that hold the quartiles
    are known from the counts; a second pass counts within these by as many ranges again, and only similarities
    in the narrow ones that hold the quartiles come out of a third.
    """
    spark = index.sparkSession
    blocks, path = written(_grid(index, block), "blocks")
    square = blocks.agg(F.max(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    top = 1.001 * max(square or 0.0, 1e-6)
    scale = FINE / (2 * top)

    def count(t: pd.DataFrame) -> pd.DataFrame:
        n, total = np.zeros((4, FINE + 1), np.int64), np.zeros(4)
        for kind, place in _by_kind(t, top):
            n[kind] += np.bincount(place.astype(np.int64), minlength=FINE + 1)
            total[kind] += place.sum()
        n[:, 0] = 0
        kind, at = np.nonzero(n)
        # a kind's total goes with its first range
        first = np.r_[True, kind[1:] != kind[:-1]] if len(kind) else np.zeros(0, bool)
        total = (total - n.sum(axis=1) * (1 + top * scale)) / scale
        return pd.DataFrame({"kind": kind, "at": at, "n": n[kind, at], "total": np.where(first, total[kind], 0.0)})

    found = blocks.groupBy("bi", "bj").applyInPandas(count, "kind int, at long, n long, total double")
    counts = found.groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()  # at most 4 * FINE rows
    sizes: dict[int, tuple[int, float]] = {}
    ranks: list[tuple[int, str, int, int, float]] = []  # kind, quartile, range, place in the range, weight
    for kind, part in counts.sort_values(["kind", "at"]).groupby("kind"):
        end = part.n.cumsum().to_numpy()
        sizes[int(kind)] = int(end[-1]), float(part.total.sum())
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            at = (int(end[-1]) - 1) * q
            for place, weight in ((int(at), 1 - at % 1), (int(at) + 1, at % 1)):
                if weight:
                    k = int(np.searchsorted(end, place, "right"))
                    ranks.append((int(kind), name, int(part["at"].iloc[k]), place - int(end[k] - part.n.iloc[k]), weight))
    wide = np.zeros((4, FINE + 1), bool)
    for kind, _, at, _, _ in ranks:
        wide[kind, at] = True

    def within(t: pd.DataFrame):
        """kind, narrow range and similarity of pairs in the wide ranges asked for."""
        for kind, place in _by_kind(t, top):
            at = place.astype(np.int64)
            some = np.flatnonzero(wide[kind][at])
            at, place = at[some], place[some]
            yield kind, at * FINE + ((place - at) * FINE).astype(np.int64), (place - (1 + top * scale)) / scale

    def recount(t: pd.DataFrame) -> pd.DataFrame:
        parts: dict[int, list[np.ndarray]] = {}
        for kind, at, _ in within(t):
            parts.setdefault(kind, []).append(at)
        out = [pd.DataFrame({"kind": [], "at": [], "n": []})]
        for kind, some in parts.items():
            at, n = np.unique(np.concatenate(some), return_counts=True)
            out.append(pd.DataFrame({"kind": kind, "at": at, "n": n}))
        return pd.concat(out)

    recounted = blocks.groupBy("bi", "bj").applyInPandas(recount, "kind int, at long, n long")
    narrow = recounted.groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas().sort_values(["kind", "at"])  # at most 24 * FINE rows
    asked: list[tuple[int, str, int, int, float]] = []
    for kind, name, at, place, weight in ranks:
        part = narrow[(narrow.kind == kind) & (narrow["at"] // FINE == at)]
        end = part.n.cumsum().to_numpy()
        k = int(np.searchsorted(end, place, "right"))
        asked.append((kind, name, int(part["at"].iloc[k]), place - int(end[k] - part.n.iloc[k]), weight))
    wanted = {kind: np.array(sorted({a[2] for a in asked if a[0] == kind}), np.int64) for kind in range(4)}

    def select(t: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"kind": [], "at": [], "sim": []})]
        for kind, at, sim in within(t):
            keep = np.isin(at, wanted[kind])
            if keep.any():
                out.append(pd.DataFrame({"kind": kind, "at": at[keep], "sim": sim[keep]}))
        return pd.concat(out)

    values = blocks.groupBy("bi", "bj").applyInPandas(select, "kind int, at long, sim double")
    place = F.row_number().over(Window.partitionBy("kind", "at").orderBy("sim")) - 1
    asked_for = spark.createDataFrame(asked, "kind int, name string, at long, place int, weight double")
    picked = values.withColumn("place", place).join(F.broadcast(asked_for), ["kind", "at", "place"])  # at most 24 rows are asked for
    out = picked.groupBy("kind").agg(*(F.sum(F.when(F.col("name") == n, F.col("sim") * F.col("weight"))).alias(n) for n in ("q1", "median", "q3")))
    names = spark.createDataFrame([(k, KINDS[k], n, total / n) for k, (n, total) in sizes.items()], "kind int, name string, n long, mean double")
    out, _ = written(out.join(F.broadcast(names), "kind").select(F.col("name").alias("kind"), "n", "q1", "median", "q3", "mean"), "box")
    drop(spark, path)
    return out


def relative_features(stats: DataFrame, keys: list[str], lane: str) -> DataFrame:
    """Differences of each ordered pair of lanes of a group, itself included."""
    a = stats.select(*keys, F.col(lane).alias("i"), F.col("lateral_offset").alias("l_i"), F.col("speed").alias("s_i"), F.col("density").alias("d_i"))
    b = stats.select(*keys, F.col(lane).alias("j"), F.col("lateral_offset").alias("l_j"), F.col("speed").alias("s_j"), F.col("density").alias("d_j"))
    ratio = F.least(F.greatest(F.col("d_i") / (F.col("d_j") + 1e-6), F.lit(-10.0)), F.lit(10.0))
    return a.join(b, keys).select(*keys, "i", "j", (F.col("l_i") - F.col("l_j")).alias("lateral_diff"), (F.col("s_i") - F.col("s_j")).alias("speed_diff"), ratio.alias("density_ratio"))


def heading_match(headings: DataFrame, groups: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """The annotated group of a camera whose heading is nearest to each one asked, either way."""
    free = groups.join(claimed, ["camera", "group_id"], "left_anti") if claimed is not None else groups
    d = F.col("heading") - F.col("group_heading")
    score = F.greatest(F.cos(d), F.cos(d + F.lit(3.141592653589793)))
    best = headings.join(free, "camera").withColumn("score", score).groupBy("camera", "query").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "group_id", "score")).alias("b"))
    return best.select("camera", "query", F.col("b.group_id").alias("group_id"), F.col("b.score").alias("score"))


def cross_camera_queries(index: DataFrame, cameras: int = 6) -> DataFrame:
    """Of the first cameras, the lane that is most similar on average to all other cameras' (J14).

    The mean of dot products is the dot product with the mean, so no pair is formed.
    """
    parts = index.select("camera", F.posexplode("e").alias("k", "x"))
    total = parts.groupBy("k").agg(F.sum("x").alias("t"))
    own = parts.groupBy("camera", "k").agg(F.sum("x").alias("o"))
    n = index.groupBy("camera").agg(F.count("*").alias("n"))
    whole = index.agg(F.count("*").alias("m"))
    mean = own.join(total, "k").join(n, "camera").crossJoin(F.broadcast(whole)).select("camera", "k", ((F.col("t") - F.col("o")) / F.greatest(F.col("m") - F.col("n"), F.lit(1))).alias("c"))
    sims = index.select("camera", "lane", F.posexplode("e").alias("k", "x")).join(mean, ["camera", "k"]).groupBy("camera", "lane").agg(F.sum(F.col("x") * F.col("c")).alias("mean_sim"))
    best = sims.groupBy("camera").agg(F.min(F.struct((-F.round("mean_sim", 9)).alias("s"), "lane", "mean_sim")).alias("b"))
    return best.select("camera", F.col("b.lane").alias("lane"), F.col("b.mean_sim").alias("mean_sim")).orderBy("camera").limit(cameras)


def info_nce_batches(index: DataFrame, size: int = 500, temperature: float = 0.07, config: LaneConfig = DEFAULT) -> DataFrame:
    """Contrastive loss of every lane within its batch, ``lane div size`` (N8): lane, batch, loss, n_pos.

    The loss is the logarithm of all other lanes' exponentials less that of the positives'. Batches cover all lanes, so work grows with their number. Positives are as in ``positive_pairs``,
    of the same batch. A lane without positives in its batch has a null loss and ``n_pos`` 0.
    """

    def losses(t: pd.DataFrame) -> pd.DataFrame:
        e, lane, pos = np.stack(t.e.to_numpy()), t.lane.to_numpy(), _positives(t, config)
        s = e @ e.T / temperature
        s[lane[:, None] == lane] = -np.inf  # not with itself
        n_pos = pos.sum(axis=1)
        some = n_pos > 0
        loss = np.full(len(t), np.nan)
        loss[some] = log_sum_exp(s[some]) - log_sum_exp(np.where(pos[some], s[some], -np.inf))
        return pd.DataFrame({"lane": lane, "batch": t.batch.to_numpy(), "loss": pd.Series(loss).astype(object).where(some, None), "n_pos": n_pos})

    rows = index.select(F.floor(F.col("lane") / size).alias("batch"), "lane", "camera", "rank", "is_left", "is_right", "role", "e")
    return rows.groupBy("batch").applyInPandas(losses, "lane long, batch long, loss double, n_pos long")


def log_sum_exp(s: np.ndarray) -> np.ndarray:
    """Of each row that has a finite number."""
    m = s.max(axis=1, keepdims=True)
    return m[:, 0] + np.log(np.exp(s - m).sum(axis=1))


def phase_weights(epoch: int, epochs: int, role_weight: float = 2.0) -> tuple[float, float]:
    """Weights of the contrastive and the role loss: roles first, then both, then matching."""
    share = epoch / max(epochs, 1)
    return (0.3, role_weight) if share < 0.3 else (1.0, 1.0) if share < 0.7 else (2.0, 0.5)


LOSS = "batch long, contrastive double, role double, total double, n_pos long, mean_pos double, mean_neg double"


def training_loss(index: DataFrame, epoch: int, epochs: int, size: int = 500, temperature: float = 0.07, config: LaneConfig = DEFAULT) -> DataFrame:
    """The loss of each batch (``lane div size``) and its parts (N8): a row a batch.

    ``index`` has logits pred_rank, pred_left, pred_right, pred_size, too. A lane's contrastive loss
    is the share of its positives in the sum of exponentials over all others; lanes without
    positives have none, and a batch without any has 0. A batch holds at most ``size`` lanes.
    """
    contrastive_weight, role_weight = phase_weights(epoch, epochs)

    def cross_entropy(logit: np.ndarray, target: np.ndarray, weight: float = 1.0) -> np.ndarray:
        return (1 - target) * logit + (1 + (weight - 1) * target) * (np.log1p(np.exp(-np.abs(logit))) + np.maximum(-logit, 0))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        e, pos = np.stack(t.e.to_numpy()), _positives(t, config)
        sim = e @ e.T
        other = ~np.eye(len(t), dtype=bool)
        s = np.where(other, sim / temperature, -np.inf)
        some = pos.any(axis=1)
        contrastive = 0.0
        if some.any():
            contrastive = float(np.mean(log_sum_exp(s[some]) - log_sum_exp(np.where(pos[some], s[some], -np.inf))))
        flags = [t[c].to_numpy(float) for c in ("is_left", "is_right")]
        edge = np.mean([cross_entropy(t[c].to_numpy(float), f, 3.0) for c, f in zip(("pred_left", "pred_right"), flags, strict=True)])
        role = float(cross_entropy(t.pred_rank.to_numpy(float), t["rank"].to_numpy(float)).mean() + edge + 0.5 * cross_entropy(t.pred_size.to_numpy(float), t.group_size.to_numpy(float)).mean())
        rest = other & ~pos
        means = [float(sim[at].mean()) if at.any() else 0.0 for at in (pos, rest)]
        return pd.DataFrame([(int(t.batch.iloc[0]), contrastive, role, contrastive_weight * contrastive + role_weight * role, int(pos.sum()) // 2, *means)], columns=[c.split()[0] for c in LOSS.split(", ")])

    rows = index.select(F.floor(F.col("lane") / size).alias("batch"), "lane", "camera", "rank", "is_left", "is_right", "group_size", "role", "e", "pred_rank", "pred_left", "pred_right", "pred_size")
    return rows.groupBy("batch").applyInPandas(run, LOSS)


def _positives(t: pd.DataFrame, config: LaneConfig) -> np.ndarray:
    """Which lanes of a batch are positives of each other, as in ``positive_pairs``."""
    role, rank = np.stack(t.role.to_numpy()), t["rank"].to_numpy()
    left, right, camera = t.is_left.to_numpy(), t.is_right.to_numpy(), t.camera.to_numpy()
    norm = np.sqrt((role * role).sum(1)) + 1e-8
    pos = (left[:, None] == left) & (right[:, None] == right) & (camera[:, None] != camera)
    return pos & (np.round(np.abs(rank[:, None] - rank), 9) <= config.rank_gap) & (np.round(role @ role.T / (norm[:, None] * norm), 9) >= config.role_cosine)


def rank_consistency(predictions: DataFrame) -> DataFrame:
    """Each group's squared distance of its sorted predicted ranks from equal spacing (N9): grp, loss."""
    p = predictions.withColumn("p", v.sigmoid(F.col("pred")))
    group = Window.partitionBy("grp")
    rows = p.withColumn("n", F.count("*").over(group)).where("n > 1").withColumn("t", (F.row_number().over(group.orderBy("p", "lane")) - 1) / (F.col("n") - 1))
    return rows.groupBy("grp").agg(F.avg((F.col("p") - F.col("t")) ** 2).alias("loss"))


def bce(logit: Column, target: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross entropy of a logit, stable for large ones."""
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1 - target) * logit + (1 + (pos_weight - 1) * target) * soft

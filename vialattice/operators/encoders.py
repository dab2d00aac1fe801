"""Lane encoders over tables: per lane, across a group's lanes, and over a lane's windows.

Forward passes in NumPy with weights given as arrays, on Arrow batches or on groups that are small by
definition (a group's lanes, a lane's windows). What is relational stays relational: trajectories are
encoded one by one, and their mean for a lane is an aggregate over rows that never meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking
from .models import Weights, _dense, dense, encode, encoder_weights, gelu, gru

HEADS = ("rank", "left", "right", "size")


def lane_weights(k: int = 16, d: int = 64, stats: int = 9, embed: int = 128, proj: int = 64, heads: int = 4, seed: int = 0) -> Weights:
    """Fixed random weights of a lane encoder; trained ones can take their place."""
    rng = np.random.default_rng(seed)
    out = {f"geometry_{n}": a for n, a in encoder_weights(k, d, seed + 1).items()} | {f"trajectory_{n}": a for n, a in encoder_weights(k, d, seed + 2).items()}
    shapes = {"stats_a": (stats, d), "stats_b": (d, d), "fuse_a": (3 * d, 2 * embed), "fuse_b": (2 * embed, embed), "proj_a": (embed, embed), "proj_b": (embed, proj), "rank_a": (embed, 32), "rank_b": (32, 1), "edge": (embed, 2), "size": (embed, 1), "q": (embed, embed), "key": (embed, embed), "value": (embed, embed), "out": (embed, embed), "relation": (3, heads)}
    out |= {n: _dense(rng, a, b) for n, (a, b) in shapes.items()}
    # normalisations in evaluation: a scale and a shift
    return out | {f"norm_{n}": np.stack([np.ones(width), np.zeros(width)]) for n, width in (("geometry", d), ("trajectory", d), ("stats", d), ("proj_a", embed), ("proj_b", proj), ("across", embed))}


def _part(w: Weights, name: str) -> Weights:
    return {n.removeprefix(name + "_"): a for n, a in w.items() if n in (f"{name}_a", f"{name}_b")}


def _scaled(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return x * norm[0] + norm[1]


def fuse(geometry: np.ndarray, trajectory: np.ndarray, stats: np.ndarray, w: Weights) -> np.ndarray:
    """A lane's embedding from its three parts."""
    s = dense(gelu(dense(stats, w["stats_a"])), w["stats_b"])
    parts = [_scaled(x, w[f"norm_{n}"]) for n, x in (("geometry", geometry), ("trajectory", trajectory), ("stats", s))]
    return dense(gelu(dense(np.hstack(parts), w["fuse_a"])), w["fuse_b"])


def project(e: np.ndarray, w: Weights) -> np.ndarray:
    """Projections to unit length."""
    h = np.maximum(_scaled(dense(e, w["proj_a"]), w["norm_proj_a"]), 0)
    p = _scaled(dense(h, w["proj_b"]), w["norm_proj_b"])
    return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)


def heads(e: np.ndarray, w: Weights) -> np.ndarray:
    """Predicted rank, edge logits and group size."""
    return np.hstack([dense(np.maximum(dense(e, w["rank_a"]), 0), w["rank_b"]), dense(e, w["edge"]), dense(e, w["size"])])


def relations(stats: np.ndarray) -> np.ndarray:
    """(L, L, 3): differences of lateral offset and speed, and the ratio of densities, of columns (speed, lateral, density)."""
    speed, lateral, density = stats.T
    ratio = np.clip(density[:, None] / (density[None, :] + 1e-6), -10, 10)
    return np.stack([lateral[:, None] - lateral, speed[:, None] - speed, ratio], axis=2)


def attend(e: np.ndarray, relation: np.ndarray, w: Weights) -> np.ndarray:
    """Attention among a group's lanes, biased by their relations."""
    n, width = e.shape
    count = w["relation"].shape[1]
    q, k, v = (dense(e, w[name]).reshape(n, count, -1).transpose(1, 0, 2) for name in ("q", "key", "value"))
    scores = q @ k.transpose(0, 2, 1) / math.sqrt(width // count) + dense(relation, w["relation"]).transpose(2, 0, 1)
    share = np.exp(scores - scores.max(axis=2, keepdims=True))
    share /= share.sum(axis=2, keepdims=True)
    x = e + dense((share @ v).transpose(1, 0, 2).reshape(n, width), w["out"])
    x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
    return _scaled(x, w["norm_across"])


def attend_groups(rows: DataFrame, keys: list[str], lane: str, w: Weights) -> DataFrame:
    """keys, lane, embedding after attention. ``rows`` has embedding, speed, lateral_offset, density, too."""
    kinds = dict(rows.dtypes)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(lane)
        out = attend(np.stack(t.embedding.to_numpy()), relations(t[["speed", "lateral_offset", "density"]].to_numpy(float)), w)
        return t[[*keys, lane]].assign(embedding=list(out))

    given = rows.select(*keys, lane, "embedding", "speed", "lateral_offset", "density")
    return given.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, lane]) + ", embedding array<double>")


def encode_lanes(lanes: DataFrame, trajectories: DataFrame, key: str, w: Weights, drop_geometry: bool = False, drop_trajectory: bool = False, drop_roles: bool = False) -> DataFrame:
    """Each lane's embedding, projection and heads (N3, N11): key, embedding, projection, rank, left, right, size.

    ``lanes``: key, line, stats (four statistics and five of the role). ``trajectories``: key, line.
    Dropped parts, and lanes without a trajectory, count as zeros.
    """
    d = w["stats_b"].shape[1]
    zeros = F.array_repeat(F.lit(0.0), d)
    geometry = encode(lanes.select(key, "line"), key, _part(w, "geometry")).select(key, F.col("embedding").alias("geometry"))
    each = encode(trajectories.select(key, "line"), key, _part(w, "trajectory"))
    pooled = ranking.pooled(each.withColumn("e", F.col("embedding")), [key], F.lit(True), "e").select(key, F.col("mean").alias("trajectory"))
    rows = lanes.select(key, "stats").join(geometry, key).join(pooled, key, "left")
    stats = F.transform("stats", lambda x, k: F.when(k >= 4, 0.0).otherwise(x)) if drop_roles else F.col("stats")
    rows = rows.select(key, (zeros if drop_geometry else F.col("geometry")).alias("geometry"), (zeros if drop_trajectory else F.coalesce("trajectory", zeros)).alias("trajectory"), stats.cast("array<double>").alias("stats"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            parts = [batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (1, 2, 3)]
            e = fuse(*parts, w)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (e, project(e, w))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *(pa.array(c) for c in heads(e, w).T)], names=[key, "embedding", "projection", *HEADS])

    kind = dict(lanes.dtypes)[key]
    return rows.mapInArrow(run, f"{key} {kind}, embedding array<double>, projection array<double>, " + ", ".join(f"{h} double" for h in HEADS))


def joint(windows: DataFrame, key: str, w: Weights, temporal: Weights) -> DataFrame:
    """Per lane, over its windows in order (N5): key, w, logit, and the lane's pooled projection and heads.

    ``windows``: key, w, valid, embedding (of ``encode_lanes`` by window). Windows that aren't valid
    take the last valid one's embedding; before the first they keep their own. ``temporal``: weights
    of a recurrent step over embeddings.
    """
    kinds = dict(windows.dtypes)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("w")
        e, valid = np.stack(t.embedding.to_numpy()), t.valid.to_numpy(bool)
        last = np.maximum.accumulate(np.where(valid, np.arange(len(t)), -1))
        e = e[np.where(last >= 0, last, np.arange(len(t)))]
        n = max(1, int(valid.sum()))
        mean, seen = (e * valid[:, None]).sum(0, keepdims=True) / n, (project(e, w) * valid[:, None]).sum(0, keepdims=True) / n
        seen = seen / max(float(np.linalg.norm(seen)), 1e-12)
        out = t[[key, "w"]].assign(logit=gru(e, temporal), projection=[seen[0]] * len(t))
        return out.assign(**dict(zip(HEADS, heads(mean, w)[0], strict=True)))

    given = windows.select(key, "w", "valid", "embedding")
    return given.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, w {kinds['w']}, logit double, projection array<double>, " + ", ".join(f"{h} double" for h in HEADS))

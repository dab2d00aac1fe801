"""Contrastive training of the lane encoder (N10): geometry, trajectories and statistics to embedding, projection and heads.

``lanes``: lane, batch, line, stats (four statistics and five of the role), camera, rank, is_left, is_right,
group_size, role. ``trajectories``: lane, batch, line. Batches have a bounded number of lanes, and a lane a bounded
number of trajectories (``ranking.sample``); a batch's pairs meet in its task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, LaneConfig
from ..tables import written
from . import encoders, learning, match
from .models import FREQUENCIES, Weights, dense, gelu

NAMES = ["total", "contrastive", "role", "n_pos"]
LANE = ["lane", "batch", "line", "stats", "camera", "rank", "is_left", "is_right", "group_size", "role"]


def gelu_back(x: np.ndarray) -> np.ndarray:
    share = np.where(x == 0, 0.5, gelu(x) / np.where(x == 0, 1, x))  # the normal distribution up to x
    return share + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def features(lines: np.ndarray) -> np.ndarray:
    """Fourier features of (n, k, 2) polylines, as the encoder takes them."""
    flat = lines.reshape(len(lines), -1)[:, :, None]
    return np.concatenate([flat, np.sin(flat * FREQUENCIES), np.cos(flat * FREQUENCIES)], axis=2).reshape(len(lines), -1)


class Pass:
    """One forward pass of a batch, and its way back."""

    def __init__(self, w: Weights, lines: np.ndarray, stats: np.ndarray, paths: np.ndarray, owner: np.ndarray):
        self.w, self.owner, n = w, owner, len(lines)
        self.count = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        self.seen: dict[str, np.ndarray] = {}
        geometry = self._two("geometry_a", "geometry_b", features(lines), "g")
        each = self._two("trajectory_a", "trajectory_b", features(paths), "t") if len(paths) else np.zeros((0, geometry.shape[1]))
        pooled = np.zeros_like(geometry)
        np.add.at(pooled, owner, each)
        self.parts = [geometry, pooled / self.count, self._two("stats_a", "stats_b", stats, "s")]
        fused = np.hstack([x * w[f"norm_{k}"][0] + w[f"norm_{k}"][1] for k, x in zip(("geometry", "trajectory", "stats"), self.parts, strict=True)])
        self.e = self._two("fuse_a", "fuse_b", fused, "f")
        self.pa = dense(self.e, w["proj_a"])
        self.h = np.maximum(self.pa * w["norm_proj_a"][0] + w["norm_proj_a"][1], 0)
        self.pb = dense(self.h, w["proj_b"])
        self.p = self.pb * w["norm_proj_b"][0] + w["norm_proj_b"][1]
        self.length = np.maximum(np.linalg.norm(self.p, axis=1, keepdims=True), 1e-12)
        self.u = self.p / self.length
        self.ra = dense(self.e, w["rank_a"])
        self.rank = dense(np.maximum(self.ra, 0), w["rank_b"])[:, 0]
        self.edge, self.size = dense(self.e, w["edge"]), dense(self.e, w["size"])[:, 0]

    def _two(self, a: str, b: str, x: np.ndarray, name: str) -> np.ndarray:
        """Two layers; what the way back needs is kept."""
        mid = dense(x, self.w[a])
        self.seen[name + "x"], self.seen[name] = x, mid
        return dense(gelu(mid), self.w[b])

    def _two_back(self, a: str, b: str, name: str, dy: np.ndarray, g: Weights) -> np.ndarray:
        d, g[b] = learning.dense_back(gelu(self.seen[name]), self.w[b], dy)
        d, g[a] = learning.dense_back(self.seen[name + "x"], self.w[a], d * gelu_back(self.seen[name]))
        return d

    def back(self, du: np.ndarray, drank: np.ndarray, dedge: np.ndarray, dsize: np.ndarray) -> Weights:
        """Gradients of all weights, from those of projections and logits."""
        w, g = self.w, {n: np.zeros_like(a) for n, a in self.w.items()}
        dp = (du - self.u * (du * self.u).sum(1, keepdims=True)) / self.length
        g["norm_proj_b"] = np.stack([(dp * self.pb).sum(0), dp.sum(0)])
        dh, g["proj_b"] = learning.dense_back(self.h, w["proj_b"], dp * w["norm_proj_b"][0])
        dh = dh * (self.h > 0)
        g["norm_proj_a"] = np.stack([(dh * self.pa).sum(0), dh.sum(0)])
        de, g["proj_a"] = learning.dense_back(self.e, w["proj_a"], dh * w["norm_proj_a"][0])
        dr, g["rank_b"] = learning.dense_back(np.maximum(self.ra, 0), w["rank_b"], drank[:, None])
        more, g["rank_a"] = learning.dense_back(self.e, w["rank_a"], dr * (self.ra > 0))
        de = de + more
        for name, dy in (("edge", dedge), ("size", dsize[:, None])):
            more, g[name] = learning.dense_back(self.e, w[name], dy)
            de = de + more
        three = self._two_back("fuse_a", "fuse_b", "f", de, g)
        width = np.cumsum([x.shape[1] for x in self.parts])[:-1]
        for k, d, x in zip(("geometry", "trajectory", "stats"), np.split(three, width, axis=1), self.parts, strict=True):
            g[f"norm_{k}"] = np.stack([(d * x).sum(0), d.sum(0)])
            d = d * w[f"norm_{k}"][0]
            if k == "geometry":
                self._two_back("geometry_a", "geometry_b", "g", d, g)
            elif k == "stats":
                self._two_back("stats_a", "stats_b", "s", d, g)
            elif len(self.owner):
                self._two_back("trajectory_a", "trajectory_b", "t", (d / self.count)[self.owner], g)
        return g


def loss_and_gradient(w: Weights, lines: np.ndarray, stats: np.ndarray, paths: np.ndarray, owner: np.ndarray, pos: np.ndarray, targets: np.ndarray, weights: tuple[float, float], temperature: float = 0.07) -> tuple[list[float], Weights]:
    """[total, contrastive, role, pairs] of a batch and the gradient of the total. ``targets``: rank, left, right, size."""
    one = Pass(w, lines, stats, paths, owner)
    n, some = len(lines), pos.any(axis=1)
    contrastive, du = 0.0, np.zeros_like(one.u)
    if some.any():
        s = one.u @ one.u.T / temperature
        np.fill_diagonal(s, -np.inf)
        among = np.where(pos, s, -np.inf)[some]
        every, own = match.log_sum_exp(s[some]), match.log_sum_exp(among)
        contrastive = float(np.mean(every - own))
        ds = np.zeros_like(s)
        ds[some] = (np.exp(s[some] - every[:, None]) - np.exp(among - own[:, None])) / some.sum()
        du = weights[0] * (ds + ds.T) @ one.u / temperature
    rank, drank = learning.bce_back(one.rank, targets[:, 0])
    edge, dedge = learning.bce_back(one.edge, targets[:, 1:3], 3.0)
    size, dsize = learning.bce_back(one.size, targets[:, 3])
    role = float(rank.mean() + edge.mean() + 0.5 * size.mean())
    g = one.back(du, weights[1] * drank / n, weights[1] * dedge / (2 * n), weights[1] * 0.5 * dsize / n)
    return [weights[0] * contrastive + weights[1] * role, contrastive, role, float(pos.sum() // 2)], g


def _lines(column: pd.Series) -> np.ndarray:
    return np.array([[(p["x"], p["y"]) for p in line] for line in column], float)


def gradients(lanes: DataFrame, trajectories: DataFrame, w: Weights, epoch: int, epochs: int, config: LaneConfig = DEFAULT) -> DataFrame:
    """``learning.PARTS`` of every batch."""
    weights = match.phase_weights(epoch, epochs)

    def run(t: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        if t.empty:
            return pd.DataFrame({"batch": [], "block": [], "g": [], "metrics": []})
        t, paths = t.sort_values("lane"), paths.sort_values(["lane", "track_id"])
        paths = paths[paths.lane.isin(t.lane)]
        owner = np.searchsorted(t.lane.to_numpy(), paths.lane.to_numpy())
        targets = t[["rank", "is_left", "is_right", "group_size"]].to_numpy(float)
        given = _lines(t.line), np.stack(t.stats.to_numpy()), _lines(paths.line) if len(paths) else np.zeros((0, 1, 2)), owner
        metrics, g = loss_and_gradient(w, *given, match._positives(t, config), targets, weights)
        return learning.parts(int(t.batch.iloc[0]), learning.flat(g), [1.0, *metrics])

    left = lanes.select(*LANE).groupBy("batch")
    return left.cogroup(trajectories.select("lane", "track_id", "batch", "line").groupBy("batch")).applyInPandas(run, learning.PARTS)


def train(lanes: DataFrame, trajectories: DataFrame, epochs: int = 100, rate: float = 3e-4, size: int = 256, start: Weights | None = None, folder: str | None = None, warmup: int = 5, decay: float = 1e-4, config: LaneConfig = DEFAULT) -> tuple[learning.State, DataFrame]:
    """Weights and history. A batch has the lanes of about ``size``, drawn by a hash, and all their trajectories.

    An epoch is one step by the mean of all batches' gradients.
    """
    given, _ = written(learning.dealt(lanes.select(*(c for c in LANE if c != "batch")), "lane", size), "lanes")
    paths, _ = written(trajectories.select("lane", "track_id", "line").join(given.select("lane", "batch"), "lane"), "paths")
    start = start if start is not None else encoders.lane_weights()
    return learning.fit(lanes.sparkSession, start, NAMES, lambda w, epoch: gradients(given, paths, w, epoch, epochs, config), epochs, rate, folder, warmup, decay)


def encode_and_match(lanes: DataFrame, trajectories: DataFrame, w: Weights, k: int = 3) -> DataFrame:
    """Each lane's k nearest lanes of other cameras by learned projections (N11): query, ref, sim, place."""
    coded = encoders.encode_lanes(lanes, trajectories, "lane", w).select("lane", F.col("projection").alias("e"))
    rows = coded.join(lanes.select("lane", "camera"), "lane")
    return match.nearest(rows, rows, k)

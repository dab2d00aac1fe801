"""A small model for each camera, and how it does on its own and on other cameras."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import match

HIDDEN = 16


def _forward(x: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(x @ w[0] + w[1], 0)
    return h, h @ w[2] + w[3]


def train(x: np.ndarray, y: np.ndarray, epochs: int = 200, rate: float = 0.01, seed: int = 42) -> list[np.ndarray]:
    """Weights of two layers that predict rank (squared error) and both edges (cross entropy), by Adam."""
    rng = np.random.default_rng(seed)
    w = [rng.uniform(-1, 1, (x.shape[1], HIDDEN)) / x.shape[1] ** 0.5, np.zeros(HIDDEN), rng.uniform(-1, 1, (HIDDEN, 3)) / HIDDEN**0.5, np.zeros(3)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, epochs + 1):
        h, out = _forward(x, w)
        d = np.column_stack([2 * (out[:, 0] - y[:, 0]), 1 / (1 + np.exp(-out[:, 1:])) - y[:, 1:]]) / len(x)
        back = (d @ w[2].T) * (h > 0)
        for k, g in enumerate((x.T @ back, back.sum(0), h.T @ d, d.sum(0))):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def per_camera(lanes: DataFrame, epochs: int = 200) -> DataFrame:
    """Errors of each camera's model on each camera: trained, camera, lat_rank_diff, edge_f1, n.

    ``lanes``: camera, lane, stats (array), rank, is_left, is_right. A camera of one lane trains none.
    A camera's lanes are few; models are a row a camera, and each meets each other camera's lanes.
    """

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("lane")
        if len(t) < 2:
            return pd.DataFrame({"trained": pd.Series(dtype=object), "w": pd.Series(dtype=object)})
        y = t[["rank", "is_left", "is_right"]].to_numpy(float)
        w = train(np.stack(t.stats.to_numpy()), y, epochs)
        return pd.DataFrame({"trained": [t.camera.iloc[0]], "w": [np.concatenate([a.ravel() for a in w])]})

    given = lanes.select("camera", "lane", "stats", "rank", "is_left", "is_right")
    models = given.groupBy("camera").applyInPandas(fit, "trained string, w array<double>")

    def predict(stream):
        for t in stream:
            out = []
            for x, w in zip(t.stats, t.w, strict=True):
                n = len(x)
                cut = np.cumsum([n * HIDDEN, HIDDEN, HIDDEN * 3])
                a, b, c, d = np.split(np.asarray(w), cut)
                out.append(_forward(np.asarray(x)[None], [a.reshape(n, HIDDEN), b, c.reshape(HIDDEN, 3), d])[1][0])
            out = np.reshape(out, (-1, 3))
            yield t[["trained", "camera", "rank", "is_left", "is_right"]].assign(p_rank=out[:, 0], p_left=out[:, 1] > 0, p_right=out[:, 2] > 0)

    rows = given.crossJoin(models)  # cameras by lanes
    scored = rows.mapInPandas(predict, "trained string, camera string, rank double, is_left boolean, is_right boolean, p_rank double, p_left boolean, p_right boolean")
    f1 = (match.f1(F.col("p_left"), F.col("is_left")) + match.f1(F.col("p_right"), F.col("is_right"))) / 2
    return scored.groupBy("trained", "camera").agg(F.avg(F.abs(F.col("p_rank") - F.col("rank"))).alias("lat_rank_diff"), f1.alias("edge_f1"), F.count("*").alias("n"))


def seen_and_unseen(errors: DataFrame) -> DataFrame:
    """Means over pairs of cameras: models on their own camera, and on others."""
    seen = F.when(F.col("trained") == F.col("camera"), "seen").otherwise("unseen")
    return errors.groupBy(seen.alias("part")).agg(F.avg("lat_rank_diff").alias("lat_rank_diff"), F.avg("edge_f1").alias("edge_f1"), F.count("*").alias("n"))

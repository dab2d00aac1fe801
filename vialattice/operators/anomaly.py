"""Learned anomaly baselines on window statistics (N13): a one-class machine and a recurrent network.

Both are trained by passes over a table in which tasks add up what the driver needs: gradients and a
curvature of the size of the model, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..tables import written
from . import learning, windows
from .models import Weights, dense

LANE = windows.LANE


@dataclass(frozen=True)
class OneClass:
    """Random Fourier features of a Gaussian kernel, and a half-space that leaves a share of rows outside."""

    omega: np.ndarray
    shift: np.ndarray
    w: np.ndarray
    rho: float

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.shift)) * np.cos(x @ self.omega + self.shift)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Below 0: outside."""
        return self.features(x) @ self.w - self.rho


def _hinge(t: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(0, t), rounded over ``width``; its slope and curvature."""
    inner = (t > 0) & (t < width)
    return np.where(inner, t * t / (2 * width), np.where(t >= width, t - width / 2, 0)), np.where(inner, t / width, (t >= width).astype(float)), inner / width


def fit_one_class(rows: DataFrame, x: Column, nu: float = 0.1, features: int = 128, seed: int = 42, widths: tuple[float, ...] = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001), steps: int = 8) -> OneClass:
    """The nu form: half |w|^2 - rho + mean of max(0, rho - w f(x)) / nu is least, over all rows.

    Newton's method on a hinge that is rounded less and less; a step is one pass that sums gradients and
    curvatures, with ``widths`` in shares of the mean score. ``x``: an array of numbers; the kernel's width comes from their variance over all rows, as
    sklearn's ``scale`` has it. At most a share ``nu`` of the rows is outside, but for the last rounding.
    """
    given, _ = written(rows.select(F.transform(x, lambda v: v.cast("double")).alias("x")), "one-class")
    each = given.select(F.size("x").alias("d"), F.explode("x").alias("v"))
    n, d, var = given.count(), *each.agg(F.max("d"), F.var_pop("v")).first()
    if not n:
        raise ValueError("no rows to fit")
    rng = np.random.default_rng(seed)
    gamma = 1 / (d * var) if var else 1.0
    omega, shift = rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features)

    def sums(model: OneClass, width: float) -> tuple[float, np.ndarray, np.ndarray]:
        def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, k = np.zeros(0), 0
            for t in stream:
                for k in range(0, len(t), 4096):
                    f = model.features(np.stack(t.x.iloc[k : k + 4096].to_numpy()))
                    value, slope, bend = _hinge(model.rho - f @ model.w, width)
                    z = np.column_stack([-f, np.ones(len(f))])
                    part = np.concatenate([[value.sum()], slope @ z, ((z * bend[:, None]).T @ z).ravel()])
                    total = part if not len(total) else total + part
            if len(total):
                yield learning.parts(TaskContext.get().partitionId(), total, [1.0])

        out, _ = learning.summed(given.mapInPandas(run, learning.PARTS), 1 + (features + 1) * (features + 2))
        out = out / (nu * n)
        g = out[1 : features + 2] + np.append(model.w, -1.0)
        h = out[features + 2 :].reshape(features + 1, -1) + np.diag(np.append(np.ones(features), 1e-9))
        return float(out[0] + model.w @ model.w / 2 - model.rho), g, h

    # from the mean feature, which is where nu = 1 ends, and the mean score
    _, g, _ = sums(OneClass(omega, shift, np.zeros(features), 1.0), 2.0)
    mean = -2 * nu * g[:-1]
    scale = float(mean @ mean)
    at = OneClass(omega, shift, mean, scale)
    for width in (share * scale for share in widths):
        value, g, h = sums(at, width)
        for _ in range(steps):
            step, size = np.linalg.solve(h, g), 1.0
            while True:
                new = OneClass(omega, shift, at.w - size * step[:-1], at.rho - size * step[-1])
                after = sums(new, width)
                if after[0] <= value + 1e-12 * scale or size < 1e-3:
                    break
                size /= 4
            gained = value - after[0]
            at, (value, g, h) = (new, after) if gained > 0 else (at, (value, g, h))
            if gained < 1e-7 * scale:
                break
    return at


def outside(rows: DataFrame, x: str, model: OneClass) -> DataFrame:
    """Rows with ``score`` and ``anomaly``."""

    def run(stream: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in stream:
            yield pd.Series(model.score(np.stack(t.to_numpy()).astype(float)) if len(t) else [], dtype=float)

    score = F.pandas_udf(run, "double")  # type: ignore[call-overload]
    return rows.withColumn("score", score(F.transform(x, lambda v: v.cast("double")))).withColumn("anomaly", F.col("score") < 0)


def recurrent_weights(inputs: int = 4, hidden: int = 32, head: int = 16, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda a, b, fan: rng.uniform(-1, 1, (a + 1, b)) / np.sqrt(fan)
    return {"step": draw(inputs + hidden, 4 * hidden, hidden), "head_a": draw(hidden, head, hidden), "head_b": draw(head, 1, head)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def recurrent(x: np.ndarray, w: Weights) -> tuple[np.ndarray, list]:
    """Logits of (n, windows, inputs), one after another with a memory for each lane; what the way back needs."""
    n, count, _ = x.shape
    size = w["head_a"].shape[0] - 1
    h, c, seen, out = np.zeros((n, size)), np.zeros((n, size)), [], np.zeros((n, count))
    for t in range(count):
        z = np.hstack([x[:, t], h])
        i, f, g, o = np.split(dense(z, w["step"]), 4, axis=1)
        i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
        before, c = c, f * c + i * g
        h = o * np.tanh(c)
        mid = dense(h, w["head_a"])
        out[:, t] = dense(np.maximum(mid, 0), w["head_b"])[:, 0]
        seen.append((z, i, f, g, o, before, c, h, mid))
    return out, seen


def recurrent_back(w: Weights, seen: list, d: np.ndarray) -> Weights:
    """Gradients through all windows, from those of the logits."""
    g = {n: np.zeros_like(a) for n, a in w.items()}
    size = w["head_a"].shape[0] - 1
    dh, dc = np.zeros((len(d), size)), np.zeros((len(d), size))
    for t in range(len(seen) - 1, -1, -1):
        z, i, f, m, o, before, c, h, mid = seen[t]
        dm, more = learning.dense_back(np.maximum(mid, 0), w["head_b"], d[:, t : t + 1])
        g["head_b"] += more
        back, more = learning.dense_back(h, w["head_a"], dm * (mid > 0))
        g["head_a"] += more
        dh = dh + back
        dc = dc + dh * o * (1 - np.tanh(c) ** 2)
        dz = np.hstack([dc * m * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - m * m), dh * np.tanh(c) * o * (1 - o)])
        back, more = learning.dense_back(z, w["step"], dz)
        g["step"] += more
        dh, dc = back[:, -size:], dc * f
    return g


def _sequences(t: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by lane and window, and their statistics and validity as arrays of (lanes, windows)."""
    t = t.sort_values([*LANE, "w"])
    count = t.w.nunique()
    return t, t[list(windows.STATS)].to_numpy(float).reshape(-1, count, len(windows.STATS)), t.valid.to_numpy(bool).reshape(-1, count)


def recurrent_gradients(rows: DataFrame, w: Weights) -> DataFrame:
    """``learning.PARTS`` of every batch: the mean cross entropy of labels over valid windows."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t, x, valid = _sequences(t)
        logits, seen = recurrent(x, w)
        loss, d = learning.bce_back(logits, t.label.to_numpy(float).reshape(valid.shape))
        n = max(1, int(valid.sum()))
        g = recurrent_back(w, seen, d * valid / n)
        right = ((logits > 0) == t.label.to_numpy(bool).reshape(valid.shape))[valid].sum() / n
        return learning.parts(int(t.batch.iloc[0]), learning.flat(g), [1.0, float((loss * valid).sum() / n), float(right)])

    return rows.groupBy("batch").applyInPandas(run, learning.PARTS)


def train_recurrent(clean: DataFrame, lane_no: Column, epochs: int = 50, rate: float = 1e-3, size: int = 16, start: Weights | None = None, folder: str | None = None) -> tuple[learning.State, DataFrame]:
    """Weights, and loss and accuracy by epoch. ``clean``: every window of every lane (``windows.window_stats``).

    Each epoch has other anomalies put in, by a hash of lane, window and epoch. A batch has about ``size`` lanes.
    """
    clean, _ = written(learning.dealt(clean.withColumn("_lane", F.concat_ws("|", *LANE)).withColumn("_no", lane_no.cast("long")), "_lane", size), "clean")

    def gradients(w: Weights, epoch: int) -> DataFrame:
        return recurrent_gradients(windows.inject(clean, F.col("_no") + epoch * 15485863), w)

    return learning.fit(clean.sparkSession, start or recurrent_weights(), ["loss", "accuracy"], gradients, epochs, rate, folder)


def recurrent_scores(rows: DataFrame, w: Weights) -> DataFrame:
    """Lane, w, logit, anomaly of every window; a lane's windows meet in a task."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t, x, _ = _sequences(t)
        logits = recurrent(x, w)[0].ravel()
        return t[[*LANE, "w"]].assign(logit=logits, anomaly=logits > 0)

    kinds = dict(rows.dtypes)
    return rows.select(*LANE, "w", "valid", *windows.STATS).groupBy(*LANE).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*LANE, "w"]) + ", logit double, anomaly boolean")


def accuracy(scored: DataFrame, labelled: DataFrame) -> DataFrame:
    """n and the share of valid windows whose ``anomaly`` is their label; windows that weren't scored count as none."""
    both = labelled.where("valid").join(scored.select(*LANE, "w", "anomaly"), [*LANE, "w"], "left")
    right = (F.coalesce("anomaly", F.lit(False)) == F.col("label")).cast("double")
    return both.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def compare(clean: DataFrame, lane_no: Column, nu: float = 0.1, epochs: int = 50, rate: float = 1e-3) -> DataFrame:
    """method, n, accuracy of the baselines on one set of injected anomalies: scores, one-class, recurrent."""
    labelled, _ = written(windows.inject(clean, lane_no), "labelled")
    stats = windows.vector()
    model = fit_one_class(clean.where("valid"), stats, nu)
    state, _ = train_recurrent(clean, lane_no + 1, epochs, rate)
    scored = {
        "z-score": windows.zscore_anomalies(labelled),
        "one-class": outside(labelled.where("valid").withColumn("_x", stats), "_x", model),
        "recurrent": recurrent_scores(labelled, state.weights),
    }
    out = None
    for name, rows in scored.items():
        one = accuracy(rows, labelled).select(F.lit(name).alias("method"), "n", "accuracy")
        out = one if out is None else out.unionByName(one)
    return out

"""Training of the small networks on tables: gradients by batch, their sums by Spark, weights as tables.

A batch's loss and gradient come from one task, in NumPy. Gradients leave it in blocks, and each block is
summed over the batches in a task of its own, in the order of the batches, so that a run gives the
same bits again. The driver holds weights and one gradient: the size of the model, at any number of
rows. After every epoch the weights, the optimizer's moments, the epoch and the best loss are written to
a folder, whole or not at all; a run that finds such a folder goes on from its last epoch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import _at
from .models import Weights

#: Numbers of a gradient in a block.
BLOCK = 8192
PARTS = "batch long, block int, g array<double>, metrics array<double>"


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in sorted(w)])


def shaped(x: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for n in sorted(like):
        out[n] = x[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def parts(batch: int, gradient: np.ndarray, metrics: list[float]) -> pd.DataFrame:
    """A batch's gradient in blocks, for ``summed``; its metrics go with the first."""
    blocks = np.split(gradient, range(BLOCK, len(gradient), BLOCK))
    return pd.DataFrame({"batch": batch, "block": range(len(blocks)), "g": blocks, "metrics": [metrics, *([[]] * (len(blocks) - 1))]})


def summed(found: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and of metrics over all batches (``PARTS``); each block in the order of the batches."""

    def add(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("batch")
        metrics = [m for m in t.metrics if len(m)]
        return pd.DataFrame({"block": [t.block.iloc[0]], "g": [np.add.reduce(np.stack(t.g.to_numpy()))], "metrics": [np.add.reduce(np.stack(metrics)) if metrics else []]})

    rows = found.groupBy("block").applyInPandas(add, "block int, g array<double>, metrics array<double>").collect()  # the model's size
    rows.sort(key=lambda r: r["block"])
    if not rows:
        return np.zeros(size), np.zeros(0)
    return np.concatenate([r["g"] for r in rows]), np.array(rows[0]["metrics"])


@dataclass
class State:
    """Weights, Adam's moments, the epochs done, and the least loss with its epoch."""

    weights: Weights
    m: np.ndarray = field(default=None)  # type: ignore[assignment]
    v: np.ndarray = field(default=None)  # type: ignore[assignment]
    epoch: int = 0
    best: float = float("inf")
    best_epoch: int = 0

    def __post_init__(self):
        n = sum(a.size for a in self.weights.values())
        self.m, self.v = (np.zeros(n) if x is None else x for x in (self.m, self.v))

    def step(self, gradient: np.ndarray, rate: float, decay: float = 0.0) -> None:
        """Adam with decoupled weight decay."""
        t = self.epoch + 1
        self.m, self.v = 0.9 * self.m + 0.1 * gradient, 0.999 * self.v + 0.001 * gradient**2
        x = flat(self.weights)
        x = x - rate * (self.m / (1 - 0.9**t) / (np.sqrt(self.v / (1 - 0.999**t)) + 1e-8) + decay * x)
        self.weights = shaped(x, self.weights)


CHECKPOINT = "name string, part string, shape array<int>, numbers array<double>"


def save(spark: SparkSession, state: State, folder: str) -> str:
    """Write a checkpoint; it counts once Spark has committed it whole."""
    rows = [(n, "weight", list(a.shape), a.ravel().tolist()) for n, a in state.weights.items()]
    rows += [("m", "moment", [len(state.m)], state.m.tolist()), ("v", "moment", [len(state.v)], state.v.tolist())]
    rows += [("epoch", "scalar", [], [float(state.epoch)]), ("best", "scalar", [], [state.best]), ("best_epoch", "scalar", [], [float(state.best_epoch)])]
    path = f"{folder}/epoch-{state.epoch:06d}"
    spark.createDataFrame(rows, CHECKPOINT).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def read(spark: SparkSession, path: str) -> State:
    """The state of one checkpoint."""
    rows = {(r["part"], r["name"]): r for r in spark.read.schema(CHECKPOINT).parquet(path).collect()}
    scalar = lambda n: rows["scalar", n]["numbers"][0]
    weights = {n: np.array(r["numbers"]).reshape(r["shape"]) for (part, n), r in rows.items() if part == "weight"}
    return State(weights, np.array(rows["moment", "m"]["numbers"]), np.array(rows["moment", "v"]["numbers"]), int(scalar("epoch")), scalar("best"), int(scalar("best_epoch")))


def last(spark: SparkSession, folder: str) -> State | None:
    """The state of a folder's last whole checkpoint; what a stopped write left behind is passed over."""
    at, store = _at(spark, folder)
    if not store.exists(at):
        return None
    found = sorted(f.getPath().toString() for f in store.listStatus(at) if f.getPath().getName().startswith("epoch-"))
    whole = [p for p in found if store.exists(_at(spark, f"{p}/_SUCCESS")[0])]
    return read(spark, whole[-1]) if whole else None


HISTORY = "epoch int, metric string, value double"


def fit(spark: SparkSession, start: Weights, names: list[str], gradients: Callable[[Weights, int], DataFrame], epochs: int, rate: float, folder: str | None = None, warmup: int = 0, decay: float = 0.0) -> tuple[State, DataFrame]:
    """Train to so many epochs, from the folder's last checkpoint if it has one; the history of this run.

    ``gradients`` gives ``PARTS`` of every batch at the given weights and epoch (from 0); metrics are one
    count of what they are means over, then sums named by ``names``, the loss first. Its gradients are sums, too.
    """
    state = (last(spark, folder) if folder else None) or State(start)
    history = []
    while state.epoch < epochs:
        size = sum(a.size for a in state.weights.values())
        g, m = summed(gradients(state.weights, state.epoch), size)
        if not len(m) or not m[0]:
            break
        values = m[1:] / m[0]
        if values[0] < state.best:
            state.best, state.best_epoch = float(values[0]), state.epoch
        state.step(g / m[0], rate * min(1.0, (state.epoch + 1) / warmup) if warmup else rate, decay)
        history += [(state.epoch, n, float(x)) for n, x in zip(names, values, strict=True)]
        state.epoch += 1
        if folder:
            save(spark, state, folder)
    return state, spark.createDataFrame(history, HISTORY)


def dense_back(x: np.ndarray, w: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a dense layer by its input and its weights."""
    return dy @ w[:-1].T, np.vstack([x.T @ dy, dy.sum(0, keepdims=True)])


def bce_back(logit: np.ndarray, target: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Binary cross entropy of logits and its derivative."""
    more = 1 + (weight - 1) * target
    loss = (1 - target) * logit + more * (np.log1p(np.exp(-np.abs(logit))) + np.maximum(-logit, 0))
    return loss, (1 - target) - more / (1 + np.exp(np.clip(logit, -700, 700)))


def dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with a batch of about ``size`` keys, by the key's hash."""
    n = rows.select(key).distinct().count()
    return rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // size)))))

"""Forward passes of the small networks, in NumPy on Arrow batches.

Weights are plain arrays, a few hundred kilobytes, that travel with the function. None are shipped;
the makers below give fixed random ones, and trained ones can be loaded in their place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Weights = dict[str, np.ndarray]
FREQUENCIES = 2.0 ** np.arange(8) * math.pi


def gelu(x: np.ndarray) -> np.ndarray:
    """Exact to the error of an approximated error function below 2e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
    return 0.5 * x * (1 + np.sign(x) * erf)


def _dense(rng: np.random.Generator, n_in: int, n_out: int) -> np.ndarray:
    return rng.uniform(-1, 1, (n_in + 1, n_out)) / math.sqrt(n_in)  # the last row is the bias


def dense(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def encoder_weights(k: int = 16, d: int = 64, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    width = k * 2 * (1 + 2 * len(FREQUENCIES))
    return {"a": _dense(rng, width, 2 * d), "b": _dense(rng, 2 * d, d)}


def encode_lines(lines: np.ndarray, w: Weights) -> np.ndarray:
    """Fourier features and two layers over (n, k, 2) polylines."""
    flat = lines.reshape(len(lines), -1)[:, :, None]
    waves = flat * FREQUENCIES
    x = np.concatenate([flat, np.sin(waves), np.cos(waves)], axis=2).reshape(len(lines), -1)
    return dense(gelu(dense(x, w["a"])), w["b"])


def transformer_weights(d: int = 64, layers: int = 2, heads: int = 4, seed: int = 0) -> Weights:
    """Of an encoder of points as tokens; ``heads`` is kept as the length of a marker."""
    rng = np.random.default_rng(seed)
    out: Weights = {"points": _dense(rng, 2, d), "heads": np.zeros(heads)}
    for k in range(layers):
        out |= {f"{n}{k}": _dense(rng, d, d) for n in ("q", "k", "v", "o")}
        out |= {f"up{k}": _dense(rng, d, 4 * d), f"down{k}": _dense(rng, 4 * d, d)}
        out |= {f"{n}{k}": np.stack([np.ones(d), np.zeros(d)]) for n in ("first", "second")}
    return out


def _normal(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5) * norm[0] + norm[1]


def encode_points(lines: np.ndarray, w: Weights) -> np.ndarray:
    """Attention among a polyline's points, and their mean, over (n, k, 2) polylines."""
    n, k, _ = lines.shape
    d, heads = w["points"].shape[1], len(w["heads"])
    angle = np.arange(k)[:, None] * np.exp(-math.log(10000.0) * np.arange(0, d, 2) / d)
    x = dense(lines, w["points"]) + np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(k, d)
    for layer in range(sum(name.startswith("up") for name in w)):
        q, key, v = (dense(x, w[f"{name}{layer}"]).reshape(n, k, heads, -1).transpose(0, 2, 1, 3) for name in "qkv")
        scores = q @ key.transpose(0, 1, 3, 2) / math.sqrt(d // heads)
        share = np.exp(scores - scores.max(axis=-1, keepdims=True))
        mixed = (share / share.sum(axis=-1, keepdims=True)) @ v
        x = _normal(x + dense(mixed.transpose(0, 2, 1, 3).reshape(n, k, d), w[f"o{layer}"]), w[f"first{layer}"])
        x = _normal(x + dense(gelu(dense(x, w[f"up{layer}"])), w[f"down{layer}"]), w[f"second{layer}"])
    return x.mean(axis=1)


def encode(rows: DataFrame, key: str, w: Weights) -> DataFrame:
    """key and embedding of each polyline; all have the length that the weights are for.

    The weights tell the encoder: attention among points, or Fourier features.
    """
    forward, width = (encode_points, w["points"].shape[1]) if "points" in w else (encode_lines, w["b"].shape[1])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            flat = batch.column(1).flatten()
            xy = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            out = forward(xy.reshape(batch.num_rows, -1, 2), w) if batch.num_rows else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=[key, "embedding"])

    return rows.select(key, "line").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>")


def gru_weights(n_in: int = 4, d: int = 16, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    return {"x": _dense(rng, n_in, 3 * d), "h": _dense(rng, d, 3 * d), "out": _dense(rng, d, 1)}


def gru(x: np.ndarray, w: Weights) -> np.ndarray:
    """Logit after each step of a sequence."""
    d = w["out"].shape[0] - 1
    h, out = np.zeros(d), []
    for step in x:
        a, b = dense(step, w["x"]), dense(h, w["h"])
        r, z = (1 / (1 + np.exp(-(a[k * d : (k + 1) * d] + b[k * d : (k + 1) * d]))) for k in (0, 1))
        n = np.tanh(a[2 * d :] + r * b[2 * d :])
        h = (1 - z) * n + z * h
        out.append(float(dense(h, w["out"])[0]))
    return np.array(out)


def anomaly_logits(windows: DataFrame, keys: list[str], w: Weights, names: tuple[str, ...] = ("speed", "curvature", "lateral_offset", "density")) -> DataFrame:
    """A logit for each window, from its lane's windows so far; a lane has few windows."""
    kinds = dict(windows.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("w")
        return rows[[*keys, "w"]].assign(logit=gru(rows[list(names)].to_numpy(float), w))

    return windows.select(*keys, "w", *names).groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "w"]) + ", logit double")


def schedule(spark: SparkSession, steps: int = 100, start: float = 1e-4, end: float = 0.1) -> DataFrame:
    """Noise of each diffusion step and the running product of what remains."""
    beta = F.lit(start) + F.lit(end - start) * F.col("id") / F.lit(max(steps - 1, 1))
    rows = spark.range(steps).select(F.col("id").alias("t"), beta.alias("beta"))
    return rows.withColumn("alpha_bar", F.exp(F.sum(F.log(1 - F.col("beta"))).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))))


def denoiser_weights(geom: int = 32, t_dim: int = 64, cond: int = 128, hidden: int = 256, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    out: Weights = {}
    for name, (a, b) in {"1": (geom + t_dim, hidden), "2": (hidden, hidden), "3": (hidden, hidden // 2)}.items():
        out |= {f"l{name}": _dense(rng, a, b), f"s{name}": _dense(rng, cond, b), f"b{name}": _dense(rng, cond, b)}
    return out | {"out": _dense(rng, hidden // 2, geom)}


def denoise(x: np.ndarray, t: int, cond: np.ndarray, w: Weights, t_dim: int = 64) -> np.ndarray:
    """Predicted noise of noisy lines, each layer scaled and shifted by the condition."""
    half = t_dim // 2
    angle = t * np.exp(-math.log(10000.0) * np.arange(half) / half)
    h = np.hstack([x, np.tile(np.r_[np.cos(angle), np.sin(angle)], (len(x), 1))])
    for name in "123":
        h = dense(h, w[f"l{name}"])
        h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
        h = gelu(h * (1 + dense(cond, w[f"s{name}"])) + dense(cond, w[f"b{name}"]))
    return dense(h, w["out"])


def sample(conditions: DataFrame, key: str, w: Weights, candidates: int = 4, steps: int = 100, seed: int = 0) -> DataFrame:
    """Candidate lines for each condition vector: key, candidate, values; the same on every run."""
    betas = np.linspace(1e-4, 0.1, steps)
    bars = np.cumprod(1 - betas)
    geom = w["out"].shape[1]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, rows = [], []
            for name, cond in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng([seed, int.from_bytes(str(name).encode()[-8:], "big")])
                c = np.tile(np.asarray(cond, float), (candidates, 1))
                x = rng.standard_normal((candidates, geom))
                for t in range(steps - 1, -1, -1):
                    noise = denoise(x, t, c, w)
                    x = (x - betas[t] / math.sqrt(1 - bars[t]) * noise) / math.sqrt(1 - betas[t])
                    if t:
                        x = x + math.sqrt(betas[t]) * rng.standard_normal(x.shape)
                ids += [name] * candidates
                rows += list(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array([k % candidates for k in range(len(ids))], pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=[key, "candidate", "values"])

    return conditions.select(key, "e").mapInArrow(run, f"{key} {dict(conditions.dtypes)[key]}, candidate int, values array<double>")


def save_weights(w: Weights, path: str) -> None:
    """Weights as one NPZ file."""
    np.savez(path, **w)


def load_weights(path: str) -> Weights:
    """Weights of an NPZ file (S12); arrays of objects are refused, they can run code."""
    with np.load(path, allow_pickle=False) as held:
        return {n: held[n] for n in held.files}


def relation_weights(geom: int = 32, d: int = 64, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    return {"a": _dense(rng, geom + 3, d), "b": _dense(rng, d, d)}


def relate(neighbour: np.ndarray, merge_point: np.ndarray, offset: np.ndarray, related: np.ndarray, w: Weights) -> np.ndarray:
    """What a lane's neighbour, merge point and offset say, as a vector."""
    h = np.column_stack([neighbour, merge_point, offset, related])
    for name in "ab":
        h = dense(h, w[name])
        h = gelu((h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5))
    return h


def relational_conditions(rows: DataFrame, key: str, w: Weights) -> DataFrame:
    """key and e: behaviour and relation side by side, a condition for ``sample``.

    ``rows``: key, e, neighbour_line, merge_point, offset; a null neighbour is no relation.
    """
    width = w["a"].shape[0] - 4

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lines = [np.ravel([(p["x"], p["y"]) for p in x]) if x is not None else np.zeros(width) for x in batch.column(2).to_pylist()]
            related = batch.column(2).is_valid().to_numpy(zero_copy_only=False).astype(float)
            merge, offset = (batch.column(k).fill_null(0.0).to_numpy(zero_copy_only=False) * related for k in (3, 4))
            r = relate(np.reshape(lines, (-1, width)), merge, offset, related, w)
            e = [np.r_[a, b] for a, b in zip(batch.column(1).to_pylist(), r, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e, pa.list_(pa.float64()))], names=[key, "e"])

    given = rows.select(key, F.col("e").cast("array<double>").alias("e"), "neighbour_line", F.col("merge_point").cast("double").alias("merge_point"), F.col("offset").cast("double").alias("offset"))
    return given.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, e array<double>")

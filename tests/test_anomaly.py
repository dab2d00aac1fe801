"""The one-class machine against its dual, and the recurrent network against finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialattice.operators import anomaly, learning


def dual(k, nu, steps=20000):
    """Half a' K a is least over 0 <= a <= 1 / (nu n), sum a = 1: pairs of coordinates, one pair at a time."""
    n = len(k)
    top = 1 / (nu * n)
    a = np.zeros(n)
    a[: int(nu * n)] = top
    a[int(nu * n)] += 1 - a.sum()
    g = k @ a
    for _ in range(steps):
        up, down = np.where(a < top - 1e-12, g, np.inf).argmin(), np.where(a > 1e-12, g, -np.inf).argmax()
        if g[down] - g[up] < 1e-9:
            break
        move = min((g[down] - g[up]) / max(k[up, up] + k[down, down] - 2 * k[up, down], 1e-12), top - a[up], a[down])
        a[up] += move
        a[down] -= move
        g += move * (k[:, up] - k[:, down])
    inner = (a > 1e-9) & (a < top - 1e-9)
    return a, g, g[inner].mean() if inner.any() else np.sort(g)[int(nu * n)]


@pytest.mark.parametrize("nu", [0.1, 0.3])
def test_one_class_equals_its_dual(spark, nu):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(180, 4)), rng.normal(size=(20, 4)) * 4])
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "k long, x array<double>").repartition(5)
    model = anomaly.fit_one_class(df, F.col("x"), nu, features=64)
    f = model.features(x)
    a, g, rho = dual(f @ f.T, nu)
    assert np.abs(f @ model.w - g).max() < 0.02 * g.max() and abs(model.rho - rho) < 0.02 * rho
    out = {r["k"]: r for r in anomaly.outside(df, "x", model).collect()}
    # rows on the border are on either side of it by rounding; those clearly outside are at most a share of nu
    score = model.score(x)
    assert np.mean(score < -0.03 * rho) <= nu <= np.mean(score < 0.03 * rho)
    assert np.allclose([out[k]["score"] for k in range(200)], model.score(x))
    # far rows are out more often
    assert np.mean([out[k]["anomaly"] for k in range(180, 200)]) > 2 * np.mean([out[k]["anomaly"] for k in range(180)])


def test_features_are_the_kernel_s():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    model = anomaly.OneClass(rng.normal(0, np.sqrt(2 * 0.25), (4, 20000)), rng.uniform(0, 2 * np.pi, 20000), np.zeros(20000), 0.0)
    f = model.features(x)
    assert np.abs(f @ f.T - np.exp(-0.25 * ((x[:, None] - x) ** 2).sum(2))).max() < 0.05


def test_recurrent_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    w = anomaly.recurrent_weights(hidden=5, head=4, seed=1)
    x, label, valid = rng.normal(size=(6, 7, 4)), rng.integers(0, 2, (6, 7)).astype(float), rng.uniform(size=(6, 7)) < 0.7

    def loss(w):
        return (learning.bce_back(anomaly.recurrent(x, w)[0], label)[0] * valid).sum() / valid.sum()

    logits, seen = anomaly.recurrent(x, w)
    g = learning.flat(anomaly.recurrent_back(w, seen, learning.bce_back(logits, label)[1] * valid / valid.sum()))
    at = learning.flat(w)
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-5
        slope = (loss(learning.shaped(at + step, w)) - loss(learning.shaped(at - step, w))) / 2e-5
        assert abs(slope - g[k]) < 1e-7 + 1e-5 * abs(slope)


def window_table(spark, lanes=40, count=11):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(lanes):
        for w in range(count):
            n = int(rng.integers(3, 9))
            rows.append((f"c{k % 4}", k // 4, 0, w, 1 + 0.05 * float(rng.normal()), 0.1, 0.02 * float(rng.normal()), n / 9, n, w != k % count))
    return spark.createDataFrame(rows, "camera string, group_id int, cls_id int, w int, speed double, curvature double, lateral_offset double, density double, n_traj long, valid boolean")


def test_baselines_on_injected_windows(spark, tmp_path):
    clean = window_table(spark).repartition(3)
    no = F.col("group_id") * 4 + F.substring("camera", 2, 1).cast("int")
    state, history = anomaly.train_recurrent(clean, no, epochs=12, rate=0.02, size=10, folder=f"file://{tmp_path}/r")
    loss = {r["epoch"]: r["value"] for r in history.where("metric = 'loss'").collect()}
    assert loss[11] < 0.85 * loss[0] and learning.last(spark, f"file://{tmp_path}/r").epoch == 12
    got = {r["method"]: r for r in anomaly.compare(clean, no, epochs=2).collect()}
    assert set(got) == {"z-score", "one-class", "recurrent"} and {r["n"] for r in got.values()} == {400}
    assert got["one-class"]["accuracy"] > 0.7 and all(0 <= r["accuracy"] <= 1 for r in got.values())

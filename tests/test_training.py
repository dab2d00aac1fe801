"""Gradients against finite differences, falling losses, and runs that go on after a stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialattice.operators import encoders, learning, match, training

SMALL = dict(k=4, d=6, embed=8, proj=5, heads=2)


def batch(n=9, paths=14, seed=0):
    rng = np.random.default_rng(seed)
    pos = np.zeros((n, n), bool)
    for i, j in ((0, 1), (0, 2), (3, 4), (5, 8)):
        pos[i, j] = pos[j, i] = True
    return rng.normal(size=(n, 4, 2)) * 0.2, rng.normal(size=(n, 9)), rng.normal(size=(paths, 4, 2)) * 0.2, rng.integers(0, n - 2, paths), pos, rng.uniform(size=(n, 4)).round()


@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.3, 2.0), (0.0, 1.0), (1.0, 0.0)])
def test_gradient_equals_finite_differences(weights):
    w = encoders.lane_weights(**SMALL, seed=3)
    rng = np.random.default_rng(1)
    w = {n: a + 0.1 * rng.normal(size=a.shape) for n, a in w.items()}
    given = batch()
    (total, contrastive, role, pairs), g = training.loss_and_gradient(w, *given, weights)
    assert pairs == 4 and contrastive > 0 and abs(total - weights[0] * contrastive - weights[1] * role) < 1e-12
    x, dx, h = learning.flat(w), learning.flat(g), 1e-5
    for k in rng.choice(len(x), 300, replace=False):
        step = np.zeros(len(x))
        step[k] = h
        up, down = (training.loss_and_gradient(learning.shaped(x + s, w), *given, weights)[0][0] for s in (step, -step))
        # the error function is approximate, and so is its slope
        assert abs((up - down) / (2 * h) - dx[k]) < 1e-4 * max(1.0, abs(dx[k])), k


def test_forward_pass_is_the_encoder_s():
    w = encoders.lane_weights(**SMALL)
    lines, stats, paths, owner, _, _ = batch()
    one = training.Pass(w, lines, stats, paths, owner)
    assert np.allclose(one.u, encoders.project(one.e, w)) and np.allclose(np.column_stack([one.rank, one.edge, one.size]), encoders.heads(one.e, w))


def lanes_and_paths(spark, n=60):
    rng = np.random.default_rng(4)
    lanes, paths = [], []
    for k in range(n):
        rank = (k % 5) / 4
        line = [(float(x), float(0.2 + 0.5 * rank + 0.02 * rng.normal())) for x in np.linspace(0, 1, 4)]
        role = [rank, float(k % 5 == 0), float(k % 5 == 4), 0.0, 5 / 6]
        lanes.append((k, f"c{k // 10}", line, [0.1, 0.0, 0.1, 1.0, *role], rank, k % 5 == 0, k % 5 == 4, 5 / 6, role))
        paths += [(k, t, [(x, y + 0.01 * float(rng.normal())) for x, y in line]) for t in range(k % 4)]
    point = "array<struct<x: double, y: double>>"
    return (
        spark.createDataFrame(lanes, f"lane long, camera string, line {point}, stats array<double>, rank double, is_left boolean, is_right boolean, group_size double, role array<double>").repartition(3),
        spark.createDataFrame(paths, f"lane long, track_id long, line {point}").repartition(4),
    )


def test_training_learns_and_goes_on_after_a_stop(spark, tmp_path):
    lanes, paths = lanes_and_paths(spark)
    start = encoders.lane_weights(**SMALL, seed=1)
    run = lambda epochs, folder: training.train(lanes, paths, epochs=epochs, rate=0.02, size=25, start=start, folder=folder, warmup=2)
    whole, history = run(12, f"file://{tmp_path}/a")
    loss = {(r["epoch"], r["metric"]): r["value"] for r in history.collect()}
    assert loss[11, "role"] < 0.8 * loss[0, "role"] and loss[11, "contrastive"] < loss[0, "contrastive"] and loss[0, "n_pos"] > 10
    assert whole.epoch == 12 and learning.last(spark, f"file://{tmp_path}/a").epoch == 12 and whole.best <= loss[11, "total"]
    # a run that stopped after a few epochs, and within a write, goes on to the same bits
    for epoch in (1, 2, 3, 4):
        state = learning.read(spark, f"file://{tmp_path}/a/epoch-{epoch:06d}")
        assert state.epoch == epoch
        learning.save(spark, state, f"file://{tmp_path}/b")
    (tmp_path / "b" / "epoch-000009").mkdir()
    (tmp_path / "b" / "epoch-000009" / "part-0.parquet").write_bytes(b"cut")
    # weights depend on the schedule, which depends on the epochs in all
    again, rest = run(12, f"file://{tmp_path}/b")
    assert rest.agg(F.min("epoch")).first()[0] == 4
    assert all((again.weights[n] == whole.weights[n]).all() for n in start)
    # learned projections match lanes of other cameras by their role better than random ones
    index = lanes.select("lane", "camera", "rank")
    error = {}
    for name, w in (("random", start), ("learned", whole.weights)):
        found = training.encode_and_match(lanes, paths, w, 1)
        both = found.join(index.select(F.col("lane").alias("query"), F.col("rank").alias("a")), "query").join(index.select(F.col("lane").alias("ref"), F.col("rank").alias("b")), "ref")
        error[name] = both.agg(F.avg(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert error["learned"] <= error["random"]


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(b, k, rng.normal(size=5).tolist(), [1.0, float(b)] if k == 0 else []) for b in range(40) for k in range(3)]
    df = spark.createDataFrame(rows, learning.PARTS)
    first = learning.summed(df.repartition(7), 15)
    second = learning.summed(df.repartition(2, "batch"), 15)
    assert (first[0] == second[0]).all() and (first[1] == second[1]).all() and first[1].tolist() == [40.0, sum(range(40))]
    assert learning.summed(df.limit(0), 15)[0].tolist() == [0.0] * 15
    assert match.phase_weights(0, 10) == (0.3, 2.0)

"""Forward passes on small inputs."""

import numpy as np
import pytest

from vialattice.operators import models


def test_gelu():
    assert models.gelu(np.array([0.0, 1.0, -1.0])) == pytest.approx([0.0, 0.841345, -0.158655], abs=1e-5)


def test_encoder_rows_are_independent(spark):
    w = models.encoder_weights(k=2, d=4)
    lines = np.random.default_rng(1).normal(size=(5, 2, 2))
    df = spark.createDataFrame([(k, [tuple(map(float, p)) for p in line]) for k, line in enumerate(lines)], "id long, line array<struct<x: double, y: double>>")
    got = {r["id"]: r["embedding"] for r in models.encode(df.repartition(3), "id", w).collect()}
    for k in range(5):
        assert got[k] == pytest.approx(models.encode_lines(lines[k : k + 1], w)[0])


def test_gru_sees_only_the_past(spark):
    w = models.gru_weights()
    rows = [("a", k, 0.1 * k, 0.2, 0.3, 0.4) for k in range(6)]
    df = spark.createDataFrame(rows, "lane string, w int, speed double, curvature double, lateral_offset double, density double")
    full = {r["w"]: r["logit"] for r in models.anomaly_logits(df, ["lane"], w).collect()}
    part = {r["w"]: r["logit"] for r in models.anomaly_logits(df.where("w < 3"), ["lane"], w).collect()}
    assert all(part[k] == pytest.approx(full[k]) for k in range(3))


def test_sampler_repeats(spark):
    w = models.denoiser_weights(geom=4, cond=3, hidden=8)
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, [1.0, 0.0, 0.0])], "id long, e array<double>")
    a, b = ({(r["id"], r["candidate"]): r["values"] for r in models.sample(d, "id", w, 2, 10).collect()} for d in (df, df.repartition(2)))
    assert len(a) == 4 and all(np.allclose(a[k], b[k]) for k in a)

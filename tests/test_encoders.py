"""Encoders over tables against plain loops over lanes."""

import numpy as np
import pytest

from vialattice.operators import encoders as enc
from vialattice.operators import models

W = enc.lane_weights(k=4, d=8, embed=16, proj=8, seed=3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    lanes = [(k, rng.random((4, 2)), rng.random(9)) for k in range(12)]
    trajs = [(k, rng.random((4, 2))) for k in range(11) for _ in range(1 + k % 3)]  # the last lane has none
    return lanes, trajs


def line(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def plain(lanes, trajs, geometry=True, trajectory=True, roles=True):
    out = {}
    for k, points, stats in lanes:
        a = models.encode_lines(points[None], enc._part(W, "geometry"))[0] if geometry else np.zeros(8)
        own = [models.encode_lines(t[None], enc._part(W, "trajectory"))[0] for j, t in trajs if j == k]
        b = np.mean(own, axis=0) if own and trajectory else np.zeros(8)
        s = np.r_[stats[:4], stats[4:] if roles else np.zeros(5)]
        out[k] = enc.fuse(a[None], b[None], s[None], W)[0]
    return out


def tables(spark, data):
    lanes, trajs = data
    shape = "array<struct<x: double, y: double>>"
    return spark.createDataFrame([(k, line(p), [float(x) for x in s]) for k, p, s in lanes], f"lane long, line {shape}, stats array<double>"), spark.createDataFrame([(k, line(t)) for k, t in trajs], f"lane long, line {shape}")


@pytest.mark.parametrize("dropped", [{}, {"drop_geometry": True}, {"drop_trajectory": True}, {"drop_roles": True}])
def test_encode_lanes(spark, data, dropped):
    want = plain(*data, **{n.removeprefix("drop_"): False for n in dropped})
    got = enc.encode_lanes(*tables(spark, data), "lane", W, **dropped).collect()
    assert len(got) == len(want)
    for r in got:
        e = want[r["lane"]]
        assert np.allclose(r["embedding"], e) and np.allclose(r["projection"], enc.project(e[None], W)[0]) and np.isclose(np.linalg.norm(r["projection"]), 1)
        assert np.allclose([r[h] for h in enc.HEADS], enc.heads(e[None], W)[0])


def test_attention(spark, data):
    want = plain(*data)
    rng = np.random.default_rng(2)
    stats = rng.random((12, 3))
    rows = [(k // 5, k, [float(x) for x in want[k]], *map(float, stats[k])) for k in range(12)]
    got = enc.attend_groups(spark.createDataFrame(rows, "grp long, lane long, embedding array<double>, speed double, lateral_offset double, density double"), ["grp"], "lane", W).collect()
    assert len(got) == 12
    for r in got:
        group = [k for k in range(12) if k // 5 == r["grp"]]
        scores = np.zeros((4, len(group)))
        q = models.dense(want[r["lane"]], W["q"]).reshape(4, 4)
        for j, other in enumerate(group):
            a, b = stats[r["lane"]], stats[other]
            rel = np.array([a[1] - b[1], a[0] - b[0], np.clip(a[2] / (b[2] + 1e-6), -10, 10)])
            scores[:, j] = (q * models.dense(want[other], W["key"]).reshape(4, 4)).sum(1) / 2 + models.dense(rel, W["relation"])
        share = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        mixed = sum(share[:, [j]] * models.dense(want[o], W["value"]).reshape(4, 4) for j, o in enumerate(group)).ravel()
        x = want[r["lane"]] + models.dense(mixed, W["out"])
        assert np.allclose(r["embedding"], (x - x.mean()) / np.sqrt(x.var() + 1e-5))


def test_joint(spark):
    rng = np.random.default_rng(4)
    temporal = models.gru_weights(16, 6)
    valid = {0: [False, True, False, True], 1: [True] * 4, 2: [False] * 4}
    e = {k: rng.random((4, 16)) for k in valid}
    rows = [(k, t, v[t], [float(x) for x in e[k][t]]) for k, v in valid.items() for t in range(4)]
    got = enc.joint(spark.createDataFrame(rows, "lane long, w int, valid boolean, embedding array<double>").repartition(3), "lane", W, temporal).collect()
    filled = {0: [0, 1, 1, 3], 1: [0, 1, 2, 3], 2: [0, 1, 2, 3]}
    for r in got:
        k = r["lane"]
        seq = e[k][filled[k]]
        assert np.isclose(r["logit"], models.gru(seq, temporal)[r["w"]])
        use = [t for t in range(4) if valid[k][t]]
        mean = seq[use].mean(0) if use else np.zeros(16)
        assert np.allclose([r[h] for h in enc.HEADS], enc.heads(mean[None], W)[0])
        p = enc.project(seq, W)[use].mean(0) if use else np.zeros(8)
        assert np.allclose(r["projection"], p / max(np.linalg.norm(p), 1e-12))
    assert len(got) == 12


def test_relational_conditions(spark, tmp_path):
    rng = np.random.default_rng(5)
    w = models.relation_weights(8, 6, seed=2)
    models.save_weights(w, tmp_path / "w.npz")
    w = models.load_weights(tmp_path / "w.npz")
    rows = [(k, [float(x) for x in rng.random(5)], line(rng.random((4, 2))) if k else None, 0.5, 0.1) for k in range(4)]
    df = spark.createDataFrame(rows, "lane long, e array<double>, neighbour_line array<struct<x: double, y: double>>, merge_point double, offset double")
    got = {r["lane"]: r["e"] for r in models.relational_conditions(df, "lane", w).collect()}
    for k, e, near, merge, offset in rows:
        x = np.r_[np.ravel([(p["x"], p["y"]) for p in near]), merge, offset, 1.0] if near else np.zeros(11)
        for name in "ab":
            x = models.dense(x, w[name])
            x = models.gelu((x - x.mean()) / np.sqrt(x.var() + 1e-5))
        assert np.allclose(got[k], np.r_[e, x])
    sampled = models.sample(models.relational_conditions(df, "lane", w), "lane", models.denoiser_weights(geom=8, cond=11, hidden=8), candidates=2, steps=5)
    first = sorted((r["lane"], r["candidate"], r["values"]) for r in sampled.collect())
    assert len(first) == 8 and first == sorted((r["lane"], r["candidate"], r["values"]) for r in sampled.collect())


def test_points_encoder(spark, data):
    w = models.transformer_weights(8, 2, 2, seed=1)
    lanes, _ = data
    df = tables(spark, data)[0]
    got = {r["lane"]: r["embedding"] for r in models.encode(df.select("lane", "line"), "lane", w).collect()}
    for k, points, _ in lanes:
        x = models.dense(points, w["points"])
        for pos in range(4):
            for j in range(4):
                angle = pos * np.exp(-np.log(10000.0) * 2 * j / 8)
                x[pos, 2 * j] += np.sin(angle)
                x[pos, 2 * j + 1] += np.cos(angle)
        for layer in range(2):
            out = np.zeros_like(x)
            for head in range(2):
                part = slice(4 * head, 4 * head + 4)
                q, key, v = (models.dense(x, w[f"{n}{layer}"])[:, part] for n in "qkv")
                for a in range(4):
                    share = np.exp([q[a] @ key[b] / 2 for b in range(4)])
                    out[a, part] = (share / share.sum()) @ v
            x = x + models.dense(out, w[f"o{layer}"])
            x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
            x = x + models.dense(models.gelu(models.dense(x, w[f"up{layer}"])), w[f"down{layer}"])
            x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
        assert np.allclose(got[k], x.mean(0))


def test_per_camera_models(spark):
    from vialattice.operators import baselines

    rng = np.random.default_rng(7)
    rows = []
    for c in range(3):
        for k in range(5):  # statistics tell the rank, by another rule on each camera
            rows.append((f"c{c}", 10 * c + k, [float(x) for x in (k / 4 * (c + 1), 1 - k / 4, rng.random() / 100, 0.5)], k / 4, k == 0, k == 4))
    rows.append(("alone", 99, [0.1, 0.2, 0.3, 0.4], 0.5, True, True))
    df = spark.createDataFrame(rows, "camera string, lane long, stats array<double>, rank double, is_left boolean, is_right boolean")
    errors = baselines.per_camera(df).collect()
    assert {(r["trained"], r["camera"]) for r in errors} == {(f"c{a}", b) for a in range(3) for b in ("c0", "c1", "c2", "alone")}
    for r in errors:
        own = [x for x in rows if x[0] == r["trained"]]
        w = baselines.train(np.array([x[2] for x in own]), np.array([x[3:] for x in own], float))
        there = [x for x in rows if x[0] == r["camera"]]
        out = baselines._forward(np.array([x[2] for x in there]), w)[1]
        assert np.isclose(r["lat_rank_diff"], np.mean(np.abs(out[:, 0] - [x[3] for x in there]))) and r["n"] == len(there)
    told = {r["part"]: r for r in baselines.seen_and_unseen(spark.createDataFrame(errors)).collect()}
    assert told["seen"]["n"] == 3 and told["seen"]["lat_rank_diff"] < 0.15 and told["seen"]["lat_rank_diff"] < told["unseen"]["lat_rank_diff"]

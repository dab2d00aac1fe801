"""Geometry expressions against hand-computed values and plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialattice.functions import geometry as g

LINE = "array<struct<x: double, y: double>>"


def frame(spark, *lines):
    return spark.createDataFrame([(k, [tuple(map(float, p)) for p in line]) for k, line in enumerate(lines)], f"id int, line {LINE}")


def value(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def as_array(line):
    return np.array([(p["x"], p["y"]) for p in line])


def test_resample_corner(spark):
    got = as_array(value(frame(spark, [(0, 0), (3, 0), (3, 4)]), g.resample(F.col("line"), 8))[0])
    assert np.allclose(got, [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (3, 3), (3, 4)])


def test_resample_degenerate(spark):
    one, same = value(frame(spark, [(5, 5)], [(2, 1), (2, 1)]), g.resample(F.col("line"), 3))
    assert np.allclose(as_array(one), 0) and np.allclose(as_array(same), [(2, 1)] * 3)


def test_resample_against_numpy(spark):
    rng = np.random.default_rng(3)
    lines = [np.cumsum(rng.normal(size=(n, 2)), axis=0) for n in (2, 3, 7, 12)]
    for line, got in zip(lines, value(frame(spark, *lines), g.resample(F.col("line"), 9)), strict=True):
        cum = np.r_[0, np.cumsum(np.linalg.norm(np.diff(line, axis=0), axis=1))]
        want = np.c_[[np.interp(np.linspace(0, cum[-1], 9), cum, line[:, k]) for k in (0, 1)]].T
        assert np.allclose(as_array(got), want)


def test_canonical(spark):
    f = value(frame(spark, [(0, 0), (0, 2)]), g.to_canonical(F.col("line")))[0]
    assert (f["centroid"]["x"], f["centroid"]["y"], f["scale"]) == (0, 1, 2)
    assert f["angle"] == pytest.approx(math.pi / 2)
    assert np.allclose(as_array(f["canon"]), [(-0.5, 0), (0.5, 0)])


def test_smooth_and_distances(spark):
    df = frame(spark, [(0, 0), (1, 3), (2, 0)])
    assert np.allclose(as_array(value(df, g.smooth(F.col("line"), 1))[0]), [(0, 0), (1, 1), (2, 0)])
    d = g.polyline_distance(F.lit(1.0), F.lit(5.0), g.segments(F.col("line")))
    assert value(df, d)[0] == pytest.approx(2.0)
    assert value(frame(spark, [(0, 0), (0, 0)]), g.polyline_distance(F.lit(1.0), F.lit(1.0), g.segments(F.col("line"))))[0] == math.inf


def test_segments_cross(spark):
    df = frame(spark, [(0, 0), (1, 1), (0, 1), (1, 0)], [(0, 0), (1, 1), (1, 1), (2, 0)])
    col = F.col("line")
    assert value(df, g.segments_intersect(col[0], col[1], col[2], col[3])) == [True, False]


def test_signed_distance_sides(spark):
    df = frame(spark, [(0, 0), (10, 0)])
    col = g.segments(F.col("line"))
    assert value(df, g.signed_distance(F.lit(5.0), F.lit(2.0), col))[0] == 2.0
    assert value(df, g.signed_distance(F.lit(5.0), F.lit(-2.0), col))[0] == -2.0

"""Roles, statistics, windows, pairs and metrics on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from vialattice.operators import generate, lanes, match, metrics, spec, windows

LINE = "array<struct<x: double, y: double>>"


def group(spark, rows):
    return spark.createDataFrame([("c", 0, k, k, [tuple(map(float, p)) for p in line]) for k, line in enumerate(rows)], f"camera string, group_id int, cls_id int, lane_ord int, waypoints {LINE}")


def ranks(spark, rows):
    return {r["cls_id"]: (r["lateral_rank"], r["is_leftmost"], r["is_rightmost"]) for r in lanes.roles(group(spark, rows)).collect()}


def test_roles(spark):
    level = [[(0, y), (1, y)] for y in (0.2, 0.4, 0.6)]
    want = {0: (0.0, True, False), 1: (0.5, False, False), 2: (1.0, False, True)}
    assert ranks(spark, level) == want
    assert ranks(spark, [line[::-1] for line in level]) == want  # drawn the other way
    assert ranks(spark, level[:1]) == {0: (0.5, True, True)}


def test_means_of_means(spark):
    rows = [(1, k, float(k), 0.1 * k, 0.1) for k in range(5)] + [(2, 9, 0.0, 0.0, 0.0), (2, 10, 1.0, 0.0, 0.3), (2, 11, 2.0, 0.3, 0.3)]
    points = spark.createDataFrame([("c", *r) for r in rows], "camera string, track_id long, event_id long, time double, x double, y double")
    lane = group(spark, [[(0, 0), (1, 0)]])
    held = spark.createDataFrame([("c", 0, 0, 1), ("c", 0, 0, 2)], "camera string, group_id int, cls_id int, track_id long")
    got = lanes.traj_stats(lanes.trajectories(points, held, lane), lane).first()
    assert (got["speed"], got["curvature"], got["lateral_offset"], got["density"]) == pytest.approx((0.2, math.pi / 4, 0.15, 1.0))


def test_window_membership(spark):
    times = {1: 0.0, 2: 4.9, 3: 5.0, 4: 9.99, 5: 10.0, 6: 59.0, 7: 60.0}
    rows = spark.createDataFrame([("c", 0, 0, k, t, 0.0) for k, t in times.items()], "camera string, group_id int, cls_id int, track_id long, mean_time double, first_time double")
    got: dict = {}
    for r in windows.assign_windows(rows, 10, 5, 60).collect():
        got.setdefault(r["track_id"], set()).add(r["w"])
    assert got == {1: {0}, 2: {0}, 3: {0, 1}, 4: {0, 1}, 5: {1, 2}, 6: {10}}


def test_forward_fill_keeps_leading_invalid(spark):
    rows = spark.createDataFrame([("c", 0, 0, w, float(w), 0.0, 0.0, 0.0, w in (1, 3)) for w in range(5)], "camera string, group_id int, cls_id int, w int, speed double, curvature double, lateral_offset double, density double, valid boolean")
    got = [r["filled"][0] for r in windows.forward_fill(rows).orderBy("w").collect()]
    assert got == [0.0, 1.0, 1.0, 3.0, 3.0]


def test_nearest_takes_lower_of_equal(spark):
    rows = [(1, "a", [1.0, 0.0]), (7, "b", [0.6, 0.8]), (3, "b", [0.6, 0.8]), (2, "a", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "lane long, camera string, e array<double>")
    got = {r["query"]: r["ref"] for r in match.nearest(df, df, 1, block=2).collect()}
    assert got == {1: 3, 2: 3, 7: 1, 3: 1}


def test_role_pair_and_interpolation(spark):
    rows = [(1, "a", 0.0, True, False, [0.0, 1.0, 0.0, 0.0, 0.5]), (2, "b", 0.0, True, False, [0.0, 1.0, 0.0, 0.0, 1.0]), (3, "b", 0.0, False, True, [0.0, 0.0, 1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "lane long, camera string, rank double, is_left boolean, is_right boolean, role array<double>")
    assert [(r["i"], r["j"]) for r in match.positive_pairs(df).collect()] == [(1, 2)]
    found = spark.createDataFrame([(1, 10, -0.2), (1, 11, 0.6), (2, 10, -1.0), (2, 11, -0.5)], "query long, ref long, sim double")
    shape = spark.createDataFrame([(10, 0, 0.0, 0.0), (11, 0, 1.0, 1.0)], "ref long, k int, x double, y double")
    assert {r["query"]: r["x"] for r in match.interpolate(found, shape).collect()} == {1: 1.0, 2: 0.5}


def test_roc(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.1, False)], "score double, truth boolean")
    got = metrics.auc(metrics.roc(rows)).first()
    assert got["auc"] == pytest.approx(0.75) and got["youden"] == 0.9
    none = metrics.confusion(rows, F.col("score") > 0.9, F.col("truth")).first()
    assert (none["tp"], none["f1"]) == (0, 0.0)


def test_merge_point_and_unknown_spec(spark):
    df = spark.createDataFrame([([(0.0, 1.0), (1.0, 0.5), (2.0, 0.0)], [(2.0, 0.0), (3.0, 0.0)])], f"a {LINE}, b {LINE}")
    assert df.select(generate.merge_point(F.col("a"), F.col("b"))).first()[0] == 1.0
    with pytest.raises(ValueError):
        generate.new_lane(spark.createDataFrame([], "n_lanes int"), "middle")


def test_spoken_spec(spark):
    df = spark.createDataFrame([("Rightmost slow lane, left of nothing",), ("a left exit",)], "t string")
    a, b = [r["s"] for r in df.select(spec.parse(F.col("t")).alias("s")).collect()]
    assert (a["is_rightmost"], a["is_leftmost"], a["speed"]) == (True, False, 0.2)
    assert (b["is_leftmost"], b["has_successor"], b["curvature"]) == (True, True, None)

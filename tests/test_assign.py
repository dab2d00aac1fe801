"""Hand-computed cases of assignment and its summary."""

import pytest

from vialattice.config import DEFAULT
from vialattice.operators import assign as op

LANES = [("c", 0, 0, [(0.0, 100.0), (1920.0, 100.0)]), ("c", 0, 1, [(0.0, 400.0), (1920.0, 400.0)])]


def lanes(spark):
    return spark.createDataFrame(LANES, "camera string, group_id int, cls_id int, waypoints array<struct<x: double, y: double>>")


def points(spark, tracks):
    rows = [("c", t, k, float(k), 100.0 * k, float(y)) for t, ys in tracks.items() for k, y in enumerate(ys)]
    return spark.createDataFrame(rows, "camera string, track_id long, event_id long, time double, x double, y double")


@pytest.fixture(scope="module")
def assigned(spark):
    tracks = {1: [110] * 5, 2: [200] * 5, 3: [160] * 5, 4: [110] * 4, 5: [100, 100, 100, 100, 170]}
    return {r["track_id"]: r for r in op.assign_global(points(spark, tracks), lanes(spark)).collect()}


def test_accept_reject_boundary_short(assigned):
    assert (assigned[1]["lane_id"], assigned[1]["lane_score"], assigned[1]["lane_change"]) == (0, 10.0, False)
    assert (assigned[2]["lane_id"], assigned[2]["group_id"], assigned[2]["lane_score"]) == (-1, -1, 100.0)
    assert assigned[3]["lane_id"] == 0 and assigned[3]["lane_score"] == 60.0
    assert 4 not in assigned


def test_lane_change_uses_sample_deviation(assigned):
    assert assigned[5]["lane_change"]


def test_per_group_boundary_is_strict(spark):
    wide = points(spark, {1: [110] * 5, 3: [160] * 5})
    square = type(DEFAULT)(width=2048.0, height=2048.0)  # exact in binary
    kept = {r["track_id"] for r in op.assign_per_group(wide, lanes(spark), square).collect()}
    assert kept == {1}


def test_empty_and_summary(spark):
    out = op.assign_global(points(spark, {4: [110] * 4}), lanes(spark))
    assert out.count() == 0 and out.columns == ["camera", "track_id", "lane_id", "lane_score", "group_id", "lane_change"]
    total = op.summary(op.assign_global(points(spark, {1: [110] * 5, 2: [200] * 5}), lanes(spark))).first()
    assert (total["total_tracks"], total["assigned_tracks"], total["rejected_tracks"], total["rejection_rate"]) == (2, 1, 1, 0.5)


def test_detections_and_stats(spark):
    rows = spark.createDataFrame([("c", 1, 1, 2, 0.3), ("c", 1, 2, 3, 0.9), ("c", 2, 2, 7, 0.2)], "camera string, track_id long, frame_num long, class int, conf double")
    assert op.detections(rows).count() == 1
    stats = op.extraction_stats(rows).first()
    assert (stats["n_frames"], stats["n_points"], stats["n_vehicles"]) == (2, 3, 2)

"""Sinks, and readers of what others write, by round trips."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialattice.config import DEFAULT
from vialattice.sources import files


def test_points_and_assignments(spark, tmp_path):
    points = spark.createDataFrame([("a", 1, 0.5, 2, 3.0, 4.0), ("b", 2, 1.5, 7, 5.0, 6.0)], "camera string, track_id long, time double, class int, x double, y double")
    files.write_points(points, f"{tmp_path}/points")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/points")
    assert {(r["camera"], r["track_id"], r["x"]) for r in back.collect()} == {("a", 1, 3.0), ("b", 2, 5.0)}
    files.write_dumps(points, f"{tmp_path}/dumps")
    assert spark.read.parquet(f"{tmp_path}/dumps/cars_class").where("camera = 'b'").first()["class"] == 7
    assert "class" not in spark.read.parquet(f"{tmp_path}/dumps/cars").columns
    rows = spark.createDataFrame([("a", 1, 0.5, 3.0, 4.0, 0, 9.5, 1, True)], "camera string, track_id long, time double, x double, y double, lane_id long, lane_score double, group_id long, lane_change boolean")
    files.write_assignments(rows, f"{tmp_path}/p")
    files.write_assignments(rows, f"{tmp_path}/c", "csv")
    assert spark.read.parquet(f"{tmp_path}/p").where("camera = 'a'").first()["lane_score"] == 9.5
    got = files.assignments(spark, f"{tmp_path}/c/camera=a").first()
    assert (got["track_id"], got["lane_id"], got["lane_score"], got["lane_change"]) == (1, 0, 9.5, True)


def test_tables(spark, tmp_path):
    summary = spark.createDataFrame([("a", 3, 2, 1, 1 / 3, 0)], "camera string, total_tracks long, assigned_tracks long, rejected_tracks long, rejection_rate double, lane_change_tracks long")
    files.write_summary(summary, f"{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").columns == ["camera", "total_tracks", "assigned_tracks", "rejected_tracks", "rejection_rate"]
    with pytest.raises(ValueError):
        files.write_summary(summary.drop("camera"), f"{tmp_path}/x")
    assigned = spark.createDataFrame([("a_0_1", "a", 2)], "lane_key string, camera string, cluster int")
    stats = spark.createDataFrame([(2, 1, 0.1, 0.2, 0.5, 0.0, "Free-flow")], "cluster int, n_lanes long, mean_speed double, mean_density double, mean_lat_rank double, edge_ratio double, inferred_type string")
    files.write_clusters(assigned, stats, f"{tmp_path}/k")
    assert spark.read.option("header", True).csv(f"{tmp_path}/k/stats").first()["inferred_type"] == "Free-flow"
    methods = spark.createDataFrame([("m", "none", 0.98765, None, 0.5, 0.25, "YES")], "method string, supervision string, match_sim double, lat_diff double, edge_acc double, anomaly double, generalizes string")
    files.write_comparison(methods, f"{tmp_path}/m")
    told = spark.read.option("header", True).csv(f"{tmp_path}/m/csv").first()
    assert (told["match_sim"], told["lat_diff"]) == ("0.988", "—") and spark.read.json(f"{tmp_path}/m/json").first()["match_sim"] == 0.98765


def test_runs(spark, tmp_path):
    loco = spark.createDataFrame([("m", "a", 0.5, 3), ("m", "b", 0.25, 4)], "method string, camera string, sim double, n long")
    files.write_loco(loco, f"{tmp_path}/loco")
    assert json.loads(spark.read.text(f"{tmp_path}/loco").first()["value"]) == {"a": {"sim": 0.5, "n": 3}, "b": {"sim": 0.25, "n": 4}}
    history = spark.createDataFrame([("v", "loss", 2, 0.25), ("v", "loss", 1, 0.5)], "variant string, metric string, epoch long, value double")
    files.write_run(history, {"epochs": 2}, f"{tmp_path}/run")
    back = files.histories(spark, f"{tmp_path}/run/history/*/*.txt").orderBy("epoch").collect()
    assert [(r["metric"], r["epoch"], r["value"]) for r in back] == [("loss", 1, 0.5), ("loss", 2, 0.25)]
    assert spark.read.json(f"{tmp_path}/run/params").first()["value"] == "2"
    files.write_sweep(history, f"{tmp_path}/sweep")
    assert spark.read.parquet(f"{tmp_path}/sweep").schema == history.schema


def test_lane_files(spark, tmp_path):
    lanes = np.arange(24, dtype=np.float32).reshape(3, 4, 2)
    np.savez(tmp_path / "x.npz", canonicals=lanes)
    got = files.canonical_lanes(spark, f"{tmp_path}/*.npz").orderBy("lane").collect()
    assert [[[p["x"], p["y"]] for p in r["line"]] for r in got] == lanes.tolist()
    np.savez(tmp_path / "bad.npz", canonicals=np.array([{}], object))
    with pytest.raises(Exception, match="allow_pickle"):
        files.canonical_lanes(spark, f"{tmp_path}/bad.npz").collect()
    frames = spark.createDataFrame([([([[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]],), ([[6.0, 7.0, 8.0]],)],)], "lane_segment array<struct<centerline: array<array<double>>>>")
    frames.write.parquet(f"{tmp_path}/root/data_dict_subset_A_train.parquet")
    rows = files.centerlines(spark, f"{tmp_path}/root").collect()
    assert sorted(len(r["line"]) for r in rows) == [1, 2] and {r["line"][0]["z"] for r in rows} == {2.0, 8.0}
    with pytest.raises(FileNotFoundError):
        files.centerlines(spark, f"{tmp_path}/root", "val")


def test_configuration(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("assignment:\n  lateral_threshold_px: 55\n  min_tracklet_points: 4\ntemporal:\n  window_size_sec: 60\nmodel:\n  dropout: 0.1\n")
    got = files.configuration(spark, f"{tmp_path}/c.yaml")
    assert (got.reject_px, got.min_points, got.window_size, got.width) == (55.0, 4, 60.0, 1920.0)
    (tmp_path / "e.yaml").write_text("")
    assert files.configuration(spark, f"{tmp_path}/e.yaml") == DEFAULT and (DEFAULT.window_size, DEFAULT.window_stride, DEFAULT.window_total) == (300.0, 150.0, 1800.0)


def test_lane_counts(spark):
    """Pseudo-lanes: an empty lane leaves no gap; batches keep groups whole."""
    from vialattice.operators import pseudo, ranking

    def line(y):
        return [{"x": 0.0, "y": float(y)}, {"x": 1920.0, "y": float(y)}]

    lanes = spark.createDataFrame([("a", 0, k, k, line(100 + 200 * k)) for k in range(3)] + [("b", 0, 0, 0, line(500))], "camera string, group_id int, cls_id int, lane_ord int, waypoints array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(cam, t, k, float(k), 100.0 * k, y) for cam, t, y in (("a", 1, 100.0), ("a", 2, 500.0), ("b", 3, 500.0)) for k in range(6)], "camera string, track_id long, event_id long, time double, x double, y double")
    found = pseudo.pseudo_lanes(points, lanes)
    assert {(r["lane_key"], r["cls_id"], r["n_lanes"]) for r in found.collect()} == {("a_0_0", 0, 2), ("a_0_1", 2, 2), ("b_0_0", 0, 1)}
    told = {r["lane_key"]: r for r in pseudo.properties(found).collect()}
    assert told["b_0_0"]["lateral_rank"] == 0.5 and told["b_0_0"]["is_leftmost"] and told["b_0_0"]["is_rightmost"] and told["a_0_1"]["lateral_rank"] == 1.0
    rows = spark.range(1000).select((F.col("id") / 7).cast("long").alias("grp"), F.col("id").alias("lane"))
    batches = ranking.group_batches(rows, ["grp"], 20, shard_groups=50)
    sizes = rows.join(batches, "grp").groupBy("shard", "batch").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("g")).collect()
    assert batches.count() == 143 and all(r["n"] <= 20 for r in sizes) and sum(r["n"] for r in sizes) == 1000 and sum(r["g"] for r in sizes) == 143

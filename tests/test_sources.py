"""Readers on small files, and streaming windows against their batch twin."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialattice.operators import lanes
from vialattice.sources import files
from vialattice.streaming import windows


def annotation(**more):
    return {"camera": "cam", "lane_groups": [{"group_id": 1, "lanes": [{"cls_id": 0, "waypoints": [{"x": 0.0, "y": 0.0}, {"x": 1920.0, "y": 540.0}]}, {"cls_id": 1, "waypoints": [{"x": 1.0, "y": 1.0}]}], "relationships": [{"type": "successor", "from_lane": 0, "to_lane": 1}]}]} | more


def test_annotation(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(annotation()))
    docs = files.annotations(spark, str(tmp_path / "a.json"))
    got = lanes.unnest_lanes(docs).collect()
    assert len(got) == 1 and got[0]["waypoints"][1]["y"] == 0.5
    assert lanes.unnest_relationships(docs).first()["from_cls"] == 0


def test_annotation_without_groups_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"camera": "cam"}))
    with pytest.raises(Exception, match="lane_groups"):
        files.annotations(spark, str(tmp_path / "a.json")).collect()


def test_camera_folders(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / name).mkdir()
        if name != "c":
            (tmp_path / name / "annotation.json").write_text("{}")
    (tmp_path / "a" / "trajectory.csv").write_text("id,time,frame_num,class,conf,x,y,w,h\n1,0.5,1,2,0.9,3,4,5,6\n")
    np.save(tmp_path / "a" / "last_frame.npy", np.zeros((7, 9, 3)))
    (tmp_path / "list.txt").write_text(" a \n\nb\n")
    assert [r[0] for r in files.annotated_cameras(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert [r[0] for r in files.discover(spark, str(tmp_path), (f"{tmp_path}/*/trajectory.csv",)).collect()] == ["a"]
    assert {r[0] for r in files.cameras(spark, str(tmp_path / "list.txt")).collect()} == {"a", "b"}
    row = files.trajectories(spark, f"{tmp_path}/*/trajectory.csv").first()
    assert (row["camera"], row["track_id"], row["x"]) == ("a", 1, 3.0)
    size = files.frame_sizes(spark, f"{tmp_path}/*/last_frame.npy").first()
    assert (size["width"], size["height"]) == (9, 7)


def test_aliases(spark):
    df = files.resolve(spark.createDataFrame([(1, 2.0)], "track_id long, timestamp double"))
    assert df.first()["time"] == 2.0
    with pytest.raises(ValueError):
        files.resolve(spark.createDataFrame([(1,)], "x int"))


def test_restrict_falls_back(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "camera string, group_id int")
    assert {(r[0], r[1]) for r in files.restrict_group(df, 1).collect()} == {("a", 1), ("b", 2)}


def test_videos(spark):
    paths = spark.createDataFrame([("file:/v/x_camA_1.mp4",), ("file:/v/camA.mp4",), ("file:/v/camB/video.mp4",)], "path string")
    cams = spark.createDataFrame([("camA",), ("camB",)], "camera string")
    got = {r["camera"]: r["path"] for r in files.find_videos(paths, cams).collect()}
    assert got == {"camA": "file:/v/camA.mp4", "camB": "file:/v/camB/video.mp4"}


def test_histories(spark, tmp_path):
    (tmp_path / "scratch").mkdir()
    (tmp_path / "scratch" / "history.json").write_text('{"loss": [0.5, 0.25]}')
    rows = files.histories(spark, f"{tmp_path}/*/history.json").orderBy("epoch").collect()
    assert [(r["variant"], r["metric"], r["epoch"], r["value"]) for r in rows] == [("scratch", "loss", 1, 0.5), ("scratch", "loss", 2, 0.25)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"2024-01-{1 + k // 2:02d} 00:00:0{k % 2}", k % 5, "a", float(k), "{}") for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.windowed(windows.read_events(spark, str(tmp_path / "in")))
    windows.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    got = {(str(r["start"]), r["camera"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(str(r["start"]), r["camera"]): r["n"] for r in windows.windowed(df.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got and all(batch[k] == n for k, n in got.items())  # windows still open at the end aren't written


def test_stream_forward_fill(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, "2024-01-01 00:00:00", 7, "a", None, "{}"), (2, "2024-01-01 00:00:01", 7, "a", 5.0, "{}"), (3, "2024-01-01 00:00:02", 7, "a", None, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    windows.run_available(windows.forward_fill(windows.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["event_id"]: r["filled"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[2] == 5.0 and got[3] == 5.0 and got[1] is None or got[1] != got[1]

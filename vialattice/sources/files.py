"""Readers and writers of annotations, trajectories, camera lists, frames and histories."""

from __future__ import annotations

import ast
import io
import struct
from dataclasses import fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, LaneConfig
from ..schemas import ANNOTATION, POINTS

IDS, TIMES = ("id", "track_id"), ("time", "timestamp", "frame", "t")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation documents; one without camera or lane groups fails, naming what it lacks."""
    rows = spark.read.schema(ANNOTATION).option("multiLine", True).json(path)
    missing = F.array_compact(F.array(F.when(F.col("camera").isNull(), F.lit("camera")), F.when(F.col("lane_groups").isNull(), F.lit("lane_groups")), F.when(F.exists("lane_groups", lambda g: g["group_id"].isNull()), F.lit("group_id")), F.when(F.exists("lane_groups", lambda g: g["lanes"].isNull()), F.lit("lanes"))))
    checked = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("annotation without "), F.array_join(missing, ", ")))).otherwise(F.col("lane_groups"))
    return rows.withColumn("lane_groups", checked)


def _path_camera() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def trajectories(spark: SparkSession, path: str, schema: str | None = POINTS) -> DataFrame:
    """Trajectory CSVs; the camera is the folder's name (S2). Without a schema, names are resolved."""
    if schema is not None:
        return spark.read.schema(schema).option("header", True).csv(path).withColumn("camera", _path_camera()).withColumnRenamed("id", "track_id")
    return resolve(spark.read.option("header", True).option("inferSchema", True).csv(path).withColumn("camera", _path_camera()))


def resolve(rows: DataFrame) -> DataFrame:
    """track_id and time from the aliases that a table has; without a time, the row's order in its file."""
    found = {c.lower(): c for c in rows.columns}
    track = next((found[n] for n in IDS if n in found), None)
    if track is None:
        raise ValueError("no track id column: id or track_id")
    out = rows.withColumnRenamed(track, "track_id")
    time = next((found[n] for n in TIMES if n in found), None)
    return out.withColumn("time", F.col(time).cast("double") if time else F.monotonically_increasing_id().cast("double"))


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """Assignment CSVs (S3)."""
    from ..schemas import ASSIGNMENTS

    return spark.read.schema(ASSIGNMENTS).option("header", True).csv(path)


def cameras(spark: SparkSession, list_path: str) -> DataFrame:
    """Camera names of a list file, blank lines dropped."""
    return spark.read.text(list_path).select(F.trim("value").alias("camera")).where("camera <> ''")


def _listing(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path")


def annotated_cameras(spark: SparkSession, root: str) -> DataFrame:
    """Folders under a root that hold an annotation (S4's fallback)."""
    return _listing(spark, f"{root}/*/annotation.json").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("camera")).distinct().orderBy("camera")


def discover(spark: SparkSession, root: str, trajectory_patterns: tuple[str, ...]) -> DataFrame:
    """Cameras with an annotation and a trajectory in any of the places."""
    found = None
    for pattern in trajectory_patterns:
        part = _listing(spark, pattern).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("camera"))
        found = part if found is None else found.unionByName(part)
    return annotated_cameras(spark, root).join(found.distinct(), "camera", "left_semi")


def npy_shape(content: bytes) -> tuple[int, ...] | None:
    """The shape that a .npy header states, without reading its data."""
    if content is None or content[:6] != b"\x93NUMPY":
        return None
    wide = content[6] > 1
    size = struct.unpack_from("<I" if wide else "<H", content, 8)[0]
    start = 12 if wide else 10
    return tuple(ast.literal_eval(content[start : start + size].decode("latin1"))["shape"])


def frame_sizes(spark: SparkSession, pattern: str, width: int = 1920, height: int = 1080) -> DataFrame:
    """Frame size by camera from .npy headers, else the default."""

    @F.pandas_udf("struct<h: int, w: int>")
    def shape(content: pd.Series) -> pd.DataFrame:
        got = [npy_shape(bytes(c)) if c is not None else None for c in content]
        return pd.DataFrame({"h": [s[0] if s and len(s) >= 2 else None for s in got], "w": [s[1] if s and len(s) >= 2 else None for s in got]}, dtype="Int32")

    rows = spark.read.format("binaryFile").load(pattern)
    head = rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("camera"), shape(F.substring(F.col("content"), 1, 4096)).alias("s"))
    return head.select("camera", F.coalesce("s.w", F.lit(width)).alias("width"), F.coalesce("s.h", F.lit(height)).alias("height"))


def find_videos(files: DataFrame, cameras_: DataFrame, patterns: tuple[str, ...] = ("{c}.mp4", "{c}.avi", "{c}/video.mp4", "{c}/*.mp4", "*{c}*")) -> DataFrame:
    """The first matching file of each camera, by the order of patterns and then by name."""
    rows = files.crossJoin(cameras_)  # by patterns, no key to join on; Spark broadcasts the cameras if they are few
    rank = F.lit(None).cast("int")
    for k, p in reversed(list(enumerate(patterns))):
        pieces = p.split("{c}")
        like = F.concat(F.lit("%/" if not pieces[0].startswith("*") else "%"), F.lit(pieces[0].replace("*", "%")), F.col("camera"), F.lit(pieces[1].replace("*", "%")))
        rank = F.when(F.call_function("like", F.col("path"), like), k).otherwise(rank)
    return rows.withColumn("rank", rank).where("rank is not null").groupBy("camera").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))


#: Names of a split's centre lines, in the order in which they are looked for.
CENTERLINES = ("data_dict_subset_A_{split}_lanesegnet.parquet", "data_dict_subset_A_{split}.parquet", "data_dict_sample_ls.parquet")


def centerlines(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """A split's road centre lines, a row each (S9): segment, line of struct(x, y, z).

    The first of the known names that is there is read, as Parquet with a column ``lane_segment`` of
    frames or with a row a line; pickles are never read, they can run code.
    """
    found = {r["name"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root).select(F.explode(F.split("path", "/")).alias("name")).distinct().collect()}
    name = next((n for c in CENTERLINES if (n := c.format(split=split)) in found), None)
    if name is None:
        raise FileNotFoundError(f"no centre lines in {root}: " + ", ".join(c.format(split=split) for c in CENTERLINES))
    rows = spark.read.parquet(f"{root}/{name}")
    if "lane_segment" in rows.columns:
        rows = rows.select(F.explode("lane_segment").alias("s")).select(F.col("s.centerline").alias("centerline"))
    line = F.transform("centerline", lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"), p[2].cast("double").alias("z")))
    return rows.select(F.monotonically_increasing_id().alias("segment"), line.alias("line"))


def canonical_lanes(spark: SparkSession, pattern: str, name: str = "canonicals") -> DataFrame:
    """Lanes of NPZ files (S10): path, lane, line. Arrays of objects are refused, they can run code."""
    schema = "path string, lane int, line array<struct<x: double, y: double>>"

    def run(stream):
        for batch in stream:
            for path, content in zip(batch.path, batch.content, strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    lines = held[name].astype(float).reshape(len(held[name]), -1, 2)
                yield pd.DataFrame({"path": path, "lane": np.arange(len(lines), dtype=np.int32), "line": [[{"x": x, "y": y} for x, y in one] for one in lines.tolist()]})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, schema)


def configuration(spark: SparkSession, path: str) -> LaneConfig:
    """Parameters of a YAML file over the defaults (S11): sections data, assignment, model, temporal and training."""
    import yaml

    given = yaml.safe_load("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())) or {}  # one small file
    found = {field: given[part][key] for (part, key), field in SETTINGS.items() if given.get(part) and key in given[part]}
    kinds = {f.name: type(f.default) for f in fields(LaneConfig)}
    return replace(DEFAULT, **{n: kinds[n](x) for n, x in found.items()})


#: Where a file states each parameter.
SETTINGS = {
    ("data", "image_width"): "width", ("data", "image_height"): "height", ("assignment", "lateral_threshold_px"): "reject_px", ("assignment", "lane_change_std_px"): "change_std_px",
    ("assignment", "min_tracklet_points"): "min_points", ("model", "polyline_k"): "polyline_points", ("contrastive_training", "role_similarity_threshold"): "role_cosine", ("contrastive_training", "max_traj_per_lane"): "max_trajectories",
    ("temporal", "window_size_sec"): "window_size", ("temporal", "window_stride_sec"): "window_stride", ("temporal", "total_time_sec"): "window_total", ("temporal", "min_traj_per_window"): "min_window_trajectories",
}


def histories(spark: SparkSession, path: str) -> DataFrame:
    """variant, metric, epoch (from 1), value of JSON histories, a metric being a list by epoch."""
    rows = spark.read.option("wholetext", True).text(path).withColumn("variant", _path_camera())
    metrics = rows.select("variant", F.explode(F.from_json("value", "map<string, array<double>>")).alias("metric", "values"))
    return metrics.select("variant", "metric", F.posexplode("values").alias("k", "value")).select("variant", "metric", (F.col("k") + 1).cast("long").alias("epoch"), "value")


def restrict_group(lanes: DataFrame, group_id: int) -> DataFrame:
    """One group's lanes; all of a camera's if it has no such group."""
    found = F.max((F.col("group_id") == group_id).cast("int")).over(Window.partitionBy("camera"))
    return lanes.withColumn("found", found).where((F.col("found") == 0) | (F.col("group_id") == group_id)).drop("found")


def write_points(points: DataFrame, path: str) -> None:
    """Points as CSV, a folder for each camera (K1)."""
    points.write.partitionBy("camera").option("header", True).csv(path)


def write_assignments(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Assignments by camera (K2); Parquet lets later readers skip cameras."""
    writer = rows.write.partitionBy("camera")
    writer.parquet(path) if fmt == "parquet" else writer.option("header", True).csv(path)


def _one_file(rows: DataFrame, columns: tuple[str, ...], path: str, fmt: str) -> None:
    """One CSV or JSON file of exactly these columns, for tables by camera, cluster, variant or method."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"nothing to write as {', '.join(missing)}")
    one = rows.select(*columns).coalesce(1).write
    one.option("header", True).csv(path) if fmt == "csv" else one.json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """Tracks by camera (K3)."""
    _one_file(rows, ("camera", "total_tracks", "assigned_tracks", "rejected_tracks", "rejection_rate"), path, "csv")


def write_clusters(assigned: DataFrame, stats: DataFrame, path: str) -> None:
    """Each lane's cluster, and the clusters' table (K4)."""
    _one_file(assigned, ("lane_key", "camera", "cluster"), f"{path}/assignments", "csv")
    _one_file(stats, ("cluster", "n_lanes", "mean_speed", "mean_density", "mean_lat_rank", "edge_ratio", "inferred_type"), f"{path}/stats", "csv")


def write_comparison(rows: DataFrame, path: str) -> None:
    """Methods side by side, for people and for programs (K5); numbers that a method lacks are a dash in the CSV."""
    names = ("method", "supervision", "match_sim", "lat_diff", "edge_acc", "anomaly", "generalizes")
    _one_file(rows, names, f"{path}/json", "json")
    told = rows.select(*(F.when(F.col(n).isNull(), F.lit("\u2014")).otherwise(F.format_string("%.3f", F.col(n))).alias(n) if dict(rows.dtypes)[n] in ("double", "float") else F.col(n) for n in names))
    _one_file(told, names, f"{path}/csv", "csv")


def write_loco(metrics: DataFrame, path: str) -> None:
    """A method's metrics of each camera, as one JSON map (K6)."""
    values = F.struct(*(c for c in metrics.columns if c not in ("method", "camera")))
    rows = metrics.groupBy("method").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("camera"), values.alias("value")))))).alias("value"))
    rows.select("method", "value").write.partitionBy("method").text(path)


def write_sweep(rows: DataFrame, path: str) -> None:
    """Metrics by window size, kept by name and type (K7)."""
    rows.coalesce(1).write.parquet(path)


def write_run(history: DataFrame, params: dict[str, object], path: str) -> None:
    """A run's history (metric to its values by epoch) and parameters (K8)."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("epoch", "value"))), lambda z: z["value"])
    lists = history.groupBy("variant", "metric").agg(values.alias("values"))
    maps = lists.groupBy("variant").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "values")))).alias("value"))
    maps.write.partitionBy("variant").text(f"{path}/history")
    spark = history.sparkSession
    spark.createDataFrame([(n, str(x)) for n, x in sorted(params.items())], "name string, value string").coalesce(1).write.json(f"{path}/params")


def write_dumps(points: DataFrame, path: str) -> None:
    """Vehicle points of each camera, without and with their class (K9)."""
    for with_class in (False, True):
        car_points(points, with_class).write.partitionBy("camera").parquet(f"{path}/{'cars_class' if with_class else 'cars'}")


def car_points(points: DataFrame, with_class: bool = False) -> DataFrame:
    """The columns that point dumps hold."""
    return points.select("camera", "time", "track_id", *(["class"] if with_class else []), "x", "y")


def frame_seconds(points: DataFrame, fps: float) -> DataFrame:
    """Seconds from the start of a video, by frame number."""
    return points.withColumn("time", F.col("frame_num") / F.lit(float(fps)))

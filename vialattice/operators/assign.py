"""Nearest-lane assignment of tracks.

``points``: camera, track_id, time, x, y. ``lanes``: camera, group_id, cls_id, waypoints in pixels. The join
of both is on the camera, so a camera's points meet only its own few lanes; distances are expressions
on each joined row, and the one shuffle is by track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, LaneConfig
from ..functions import geometry as g


def valid_points(points: DataFrame, min_points: int = DEFAULT.min_points) -> DataFrame:
    """Points of tracks with enough points."""
    track = Window.partitionBy("camera", "track_id")
    return points.withColumn("n_points", F.count("*").over(track)).where(F.col("n_points") >= min_points).drop("n_points")


def lane_segments(lanes: DataFrame) -> DataFrame:
    return lanes.withColumn("segs", g.segments(F.col("waypoints")))


#: Segments up to which a lane's distances are written out, one expression each.
UNROLLED = 32


def _with_distance(points: DataFrame, lanes: DataFrame, drop_empty: bool) -> tuple[DataFrame, Column]:
    """Points joined with their camera's lanes, and the distance of each row's point to its lane.

    The most segments that a lane has are asked for first (lanes are annotations, few to a camera),
    so that the distance is plain arithmetic that Spark compiles; longer lanes take a function over
    their array of segments.
    """
    keys = ["camera", "group_id", "cls_id"]
    most = (lanes.agg(F.max(F.size("waypoints"))).first()[0] or 1) - 1
    if not 0 < most <= UNROLLED:
        joined = points.join(lane_segments(lanes).select(*keys, "segs"), "camera")
        return joined, g.polyline_distance(F.col("x"), F.col("y"), F.col("segs"), drop_empty)
    a, b = (lambda k: F.get("waypoints", F.lit(k))), (lambda k: F.get("waypoints", F.lit(k + 1)))
    given = lanes.select(*keys, *(F.when((a(k)["x"] != b(k)["x"]) | (a(k)["y"] != b(k)["y"]) | F.lit(not drop_empty), F.struct(a(k).alias("a"), b(k).alias("b"))).alias(f"s{k}") for k in range(most)))
    each = [g.segment_distance(F.col("x"), F.col("y"), F.col(f"s{k}.a"), F.col(f"s{k}.b")) for k in range(most)]
    least = each[0] if most == 1 else F.least(*each)  # lanes of fewer segments have nulls, which are passed over
    return points.join(given, "camera"), F.coalesce(least, F.lit(float("inf")))


def lane_distances(points: DataFrame, lanes: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Mean and sample deviation of the distance of each track to each lane of its camera."""
    joined, d = _with_distance(points, lanes, drop_empty)
    return joined.select("camera", "track_id", "group_id", "cls_id", d.alias("d")).groupBy("camera", "track_id", "group_id", "cls_id").agg(F.avg("d").alias("score"), F.stddev_samp("d").alias("std"), F.count("*").alias("n_points"))


def assign_global(points: DataFrame, lanes: DataFrame, config: LaneConfig = DEFAULT) -> DataFrame:
    """One lane for each track: the nearest on average, or -1 beyond the threshold."""
    scored = lane_distances(points, lanes).where(F.col("n_points") >= config.min_points)
    best = scored.groupBy("camera", "track_id").agg(F.min(F.struct("score", "group_id", "cls_id", "std")).alias("b"))
    rejected = F.col("b.score") > config.reject_px
    return best.select(
        "camera",
        "track_id",
        F.when(rejected, -1).otherwise(F.col("b.cls_id")).cast("long").alias("lane_id"),
        F.col("b.score").alias("lane_score"),
        F.when(rejected, -1).otherwise(F.col("b.group_id")).cast("long").alias("group_id"),
        (~rejected & (F.coalesce(F.col("b.std"), F.lit(0.0)) > config.change_std_px)).alias("lane_change"),
    )


def assign_points(points: DataFrame, lanes: DataFrame, config: LaneConfig = DEFAULT) -> DataFrame:
    """The assignment on each point of a valid track."""
    return points.select("camera", "track_id", "time", "x", "y").join(assign_global(points, lanes, config), ["camera", "track_id"]).select("camera", "track_id", "time", "x", "y", "lane_id", "lane_score", "group_id", "lane_change")


def assign_per_group(points: DataFrame, lanes: DataFrame, config: LaneConfig = DEFAULT) -> DataFrame:
    """In normalised space, a lane of each group that a track is near enough to (J7): points in 0..1."""
    w, h = F.lit(config.width), F.lit(config.height)
    scaled = points.withColumn("x", F.col("x") / w).withColumn("y", F.col("y") / h)
    normal = lanes.withColumn("waypoints", F.transform("waypoints", lambda p: g.point(p["x"] / w, p["y"] / h)))
    scored = lane_distances(scaled, normal, drop_empty=False).where(F.col("n_points") >= config.min_points)
    best = scored.groupBy("camera", "group_id", "track_id").agg(F.min(F.struct("score", "cls_id")).alias("b"))
    return best.where(F.col("b.score") < config.reject_px / config.width).select("camera", "group_id", "track_id", F.col("b.cls_id").alias("cls_id"), F.col("b.score").alias("score"))


def summary(assigned: DataFrame) -> DataFrame:
    """Tracks, assigned and rejected by camera."""
    kept = F.count_distinct(F.when(F.col("lane_id") >= 0, F.col("track_id")))
    total = F.count_distinct("track_id")
    return assigned.groupBy("camera").agg(total.alias("total_tracks"), kept.alias("assigned_tracks"), (total - kept).alias("rejected_tracks"), ((total - kept) / F.greatest(total, F.lit(1))).alias("rejection_rate"), F.count_distinct(F.when(F.col("lane_change"), F.col("track_id"))).alias("lane_change_tracks"))


def signed_lateral(points: DataFrame, lanes: DataFrame) -> DataFrame:
    """Signed distance of each point to each lane of its camera."""
    joined = points.join(lane_segments(lanes).select("camera", "group_id", "cls_id", "segs"), "camera")
    return joined.withColumn("signed", g.signed_distance(F.col("x"), F.col("y"), F.col("segs"))).drop("segs")


def detections(points: DataFrame, classes: tuple[int, ...] = (2, 5, 7), confidence: float = 0.25) -> DataFrame:
    """Detections of the wanted classes and confidence."""
    return points.where(F.col("class").isin(*classes) & (F.col("conf") >= confidence))


def extraction_stats(points: DataFrame) -> DataFrame:
    """Frames, points and vehicles by camera (A5)."""
    return points.groupBy("camera").agg(F.count_distinct("frame_num").alias("n_frames"), F.count("*").alias("n_points"), F.count_distinct("track_id").alias("n_vehicles"))


def trails(points: DataFrame, last: int | None = None) -> DataFrame:
    """Each track's points in order of time (W16), or the trailing buffer at each point."""
    item = F.struct("time", "event_id", "x", "y")
    if last is None:
        return points.groupBy("camera", "track_id").agg(F.array_sort(F.collect_list(item)).alias("trail"))
    rows = Window.partitionBy("camera", "track_id").orderBy("time", "event_id").rowsBetween(1 - last, 0)
    return points.withColumn("trail", F.collect_list(item).over(rows))


def colour_slot(group_id, lane_id, max_lanes: int = 4, colours: int = 12):
    """Slot of a lane in the palette."""
    return F.pmod(group_id * max_lanes + lane_id, F.lit(colours))

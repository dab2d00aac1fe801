"""Lanes known by their trajectories alone, and what their positions tell.

``points``: camera, track_id, event_id, time, x, y in pixels. ``lanes``: camera, group_id, cls_id,
lane_ord, waypoints in pixels. All joins are on the camera, the track or the lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, LaneConfig
from ..functions import geometry as g
from . import assign
from . import lanes as lane_op

GROUP = ["camera", "group_id"]
LANE = lane_op.LANE


def pseudo_lanes(points: DataFrame, lanes: DataFrame, config: LaneConfig = DEFAULT) -> DataFrame:
    """Lanes that hold a track, ordered across their group.

    Returns the lane, its place from the left (lane_idx) and key, the group's heading, the lateral
    centre and the statistics. Counts are relative to the group's fullest lane, and lanes without
    tracks leave no gap in the order. Groups whose lanes all have no length have none.
    """
    normal = lanes.withColumn("waypoints", F.transform("waypoints", lambda p: g.point(p["x"] / config.width, p["y"] / config.height)))
    scaled = lane_op.normalized(points, config)
    trajs = lane_op.trajectories(scaled, assign.assign_per_group(points, lanes, config), normal)
    stats = lane_op.traj_stats(trajs, normal).where("n_traj > 0")
    heading = lane_op.group_axes(normal, fold=False).where("tx is not null").select(*LANE, F.atan2("ty", "tx").alias("heading"))
    centre = lane_op.group_axes(normal).select(*LANE, "lane_ord", F.col("lateral_offset").alias("lateral_center"))
    group = Window.partitionBy(*GROUP)
    place = F.row_number().over(group.orderBy(F.round("lateral_center", 9), "lane_ord")) - 1
    rows = stats.join(heading, LANE).join(centre, LANE).withColumn("lane_idx", place).withColumn("n_lanes", F.count("*").over(group))
    return rows.withColumn("lane_key", lane_op.lane_key("camera", "group_id", "lane_idx"))


def rescaled(rows: DataFrame, value: str, keys: list[str] = GROUP) -> DataFrame:
    """``value`` stretched to 0..1 within each group (A27): one half for a row alone, as it is where all are equal."""
    group = Window.partitionBy(*keys)
    low, high = F.min(value).over(group), F.max(value).over(group)
    out = F.when(F.count("*").over(group) == 1, 0.5).when(high - low < 1e-6, F.col(value)).otherwise((F.col(value) - low) / (high - low))
    return rows.withColumn(f"{value}_rescaled", out)


def confident(geometric: Column, encoded: Column, n_traj: Column, least: int = 50) -> Column:
    """The encoder's value for lanes with enough tracks, else the geometric one."""
    return F.when((n_traj >= least) & encoded.isNotNull(), encoded).otherwise(geometric)


def properties(pseudo: DataFrame, encoded: DataFrame | None = None) -> DataFrame:
    """Rank, edges and heading of pseudo-lanes by position, and an encoder's where it can be trusted.

    ``encoded``: the lane, predicted_rank, predicted_left, predicted_right.
    """
    rank = F.when(F.col("n_lanes") > 1, F.col("lane_idx") / F.greatest(F.col("n_lanes") - 1, F.lit(1))).otherwise(0.5)
    rows = pseudo.select(*LANE, "lane_key", "lane_idx", F.degrees("heading").alias("heading_deg"), "n_traj", "lateral_center", rank.alias("lateral_rank"), (F.col("lane_idx") == 0).alias("is_leftmost"), (F.col("lane_idx") == F.col("n_lanes") - 1).alias("is_rightmost"), "n_lanes")
    if encoded is None:
        return rows
    rows = rescaled(rows.join(encoded, LANE, "left"), "predicted_rank")
    return rows.select(
        *rows.columns[:-4],
        confident(F.col("lateral_rank"), F.col("predicted_rank_rescaled"), F.col("n_traj")).alias("encoder_rank"),
        confident(F.col("is_leftmost"), F.col("predicted_left"), F.col("n_traj")).alias("encoder_left"),
        confident(F.col("is_rightmost"), F.col("predicted_right"), F.col("n_traj")).alias("encoder_right"),
        F.when(F.col("n_traj") >= 50, "high").otherwise("low").alias("confidence"),
    )

"""Lane tables, structural roles and behaviour statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, LaneConfig
from ..functions import geometry as g

LANE = ["camera", "group_id", "cls_id"]


def unnest_lanes(documents: DataFrame, config: LaneConfig = DEFAULT) -> DataFrame:
    """One row per lane with two waypoints or more, normalised by the frame."""
    groups = documents.select("camera", F.explode("lane_groups").alias("g"))
    rows = groups.select("camera", "g.group_id", F.posexplode("g.lanes").alias("lane_ord", "l")).where(F.size("l.waypoints") >= 2)
    return rows.select("camera", "group_id", "l.cls_id", "lane_ord", F.transform("l.waypoints", lambda p: g.point(p["x"] / config.width, p["y"] / config.height)).alias("waypoints"))


def lane_map(documents: DataFrame, config: LaneConfig = DEFAULT) -> DataFrame:
    """annot_<group>_<lane> to geometry, by camera."""
    rows = unnest_lanes(documents, config)
    key = F.concat_ws("_", F.lit("annot"), "group_id", "cls_id")
    return rows.groupBy("camera").agg(F.map_from_entries(F.collect_list(F.struct(key, "waypoints"))).alias("geometry"))


def unnest_relationships(documents: DataFrame) -> DataFrame:
    """One row per relationship; either naming of its ends is read."""
    groups = documents.select("camera", F.explode("lane_groups").alias("g"))
    names = groups.schema["g"].dataType["relationships"].dataType.elementType.names
    rows = groups.select("camera", "g.group_id", F.explode("g.relationships").alias("r"))

    def end(name: str) -> Column:
        return F.coalesce(*(F.col(f"r.{n}") for n in (f"{name}_cls", f"{name}_lane") if n in names)).alias(f"{name}_cls")

    return rows.select("camera", "group_id", F.col("r.type").alias("type"), end("from"), end("to"))


def successors(lanes: DataFrame, relationships: DataFrame) -> DataFrame:
    """Whether each lane is where a successor relationship starts."""
    starts = relationships.where("type = 'successor'").select("camera", "group_id", F.col("from_cls").alias("cls_id")).distinct().withColumn("found", F.lit(True))
    return lanes.join(starts, LANE, "left").withColumn("has_successor", F.coalesce("found", F.lit(False))).drop("found")


def lane_key(*parts: str) -> Column:
    return F.concat_ws("_", *parts)


def key_camera(key: Column) -> Column:
    """The camera of a lane key."""
    return F.regexp_extract(key, r"^(.*)_[^_]*_[^_]*$", 1)


def group_axes(lanes: DataFrame, fold: bool = True) -> DataFrame:
    """Each lane with its group's mean tangent and its own centroid's lateral_offset offset."""
    first, last = F.element_at("waypoints", 1), F.element_at("waypoints", -1)
    dx, dy = last["x"] - first["x"], last["y"] - first["y"]
    length = F.sqrt(dx * dx + dy * dy)
    group = Window.partitionBy("camera", "group_id")
    rows = lanes.withColumn("ux", F.when(length > 1e-8, dx / length)).withColumn("uy", F.when(length > 1e-8, dy / length)).withColumn("c", g.centroid(F.col("waypoints")))
    rows = rows.withColumn("tx", F.avg("ux").over(group)).withColumn("ty", F.avg("uy").over(group))
    size = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty")) + 1e-8
    flip = F.when((F.col("ty") < 0) | ((F.col("ty") == 0) & (F.col("tx") < 0)), -1.0).otherwise(1.0) if fold else F.lit(1.0)
    rows = rows.withColumn("k", flip / size).withColumn("tx", F.col("tx") * F.col("k")).withColumn("ty", F.col("ty") * F.col("k"))
    return rows.withColumn("lateral_offset", -F.col("c.x") * F.col("ty") + F.col("c.y") * F.col("tx")).drop("ux", "uy", "k", "c")


def roles(lanes: DataFrame, fold: bool = True, order: str = "lane_ord") -> DataFrame:
    """Rank across the group, edge flags and relative size."""
    rows = group_axes(lanes, fold)
    group = Window.partitionBy("camera", "group_id")
    n, rn = F.count("*").over(group), F.row_number().over(group.orderBy(F.round("lateral_offset", 9), order))
    rows = rows.withColumn("n", n).withColumn("rn", rn)
    largest = lanes.groupBy("camera", "group_id").agg(F.count("*").alias("m")).agg(F.max("m").alias("largest"))
    rows = rows.crossJoin(F.broadcast(largest))  # one row
    return rows.select(
        *lanes.columns,
        "lateral_offset",
        F.when(F.col("n") > 1, (F.col("rn") - 1) / (F.col("n") - 1)).otherwise(0.5).alias("lateral_rank"),
        (F.col("rn") == 1).alias("is_leftmost"),
        (F.col("rn") == F.col("n")).alias("is_rightmost"),
        (F.col("n") / F.greatest("largest", F.lit(1))).alias("group_size"),
    )


def motion(points: DataFrame) -> DataFrame:
    """Each track's mean step, mean wrapped turn, times and length."""
    order = Window.partitionBy("camera", "track_id").orderBy("time", "event_id")
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    steps = points.select("camera", "track_id", "event_id", "time", "x", "y", dx.alias("dx"), dy.alias("dy"))
    steps = steps.withColumn("angle", F.when(F.col("dx").isNotNull(), F.atan2("dy", "dx")))
    steps = steps.withColumn("turn", g.wrap(F.col("angle") - F.lag("angle").over(order)))
    return steps.groupBy("camera", "track_id").agg(F.avg(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("speed"), F.avg("turn").alias("curvature"), F.avg("time").alias("mean_time"), F.min("time").alias("first_time"), F.count("*").alias("n_points"))


def normalized(points: DataFrame, config: LaneConfig = DEFAULT) -> DataFrame:
    return points.withColumn("x", F.col("x") / config.width).withColumn("y", F.col("y") / config.height)


def pixels(points: DataFrame, config: LaneConfig = DEFAULT) -> DataFrame:
    """Normalised points back in the frame (P5)."""
    return points.withColumn("x", F.col("x") * config.width).withColumn("y", F.col("y") * config.height)


def trajectories(points: DataFrame, assigned: DataFrame, lanes: DataFrame) -> DataFrame:
    """Speed, curvature and lateral_offset offset of each track on each lane that holds it; all normalised."""
    first, last = F.element_at("waypoints", 1), F.element_at("waypoints", -1)
    dx, dy = last["x"] - first["x"], last["y"] - first["y"]
    length = F.sqrt(dx * dx + dy * dy)
    unit = F.when(length > 1e-8, length).otherwise(1.0)
    axes = lanes.select(*LANE, (-dy / unit).alias("px"), (dx / unit).alias("py"), g.centroid(F.col("waypoints")).alias("c"))
    at = points.select("camera", "track_id", "x", "y").join(assigned.select(*LANE, "track_id"), ["camera", "track_id"]).join(axes, LANE)
    off = F.abs((F.col("x") - F.col("c.x")) * F.col("px") + (F.col("y") - F.col("c.y")) * F.col("py"))
    lateral_offset = at.groupBy(*LANE, "track_id").agg(F.avg(off).alias("lateral_offset"))
    return lateral_offset.join(motion(points), ["camera", "track_id"])


def traj_stats(trajs: DataFrame, lanes: DataFrame) -> DataFrame:
    """Means over a lane's trajectories of their own means, and its share of its group's largest count."""
    stats = trajs.groupBy(*LANE).agg(F.avg("speed").alias("speed"), F.avg("curvature").alias("curvature"), F.avg("lateral_offset").alias("lateral_offset"), F.count("*").alias("n_traj"))
    rows = lanes.select(*LANE).join(stats, LANE, "left").fillna(0.0, ["speed", "curvature", "lateral_offset"]).fillna(0, ["n_traj"])
    most = F.max("n_traj").over(Window.partitionBy("camera", "group_id"))
    return rows.withColumn("density", F.col("n_traj") / F.greatest(most, F.lit(1)))


def group_relative(stats: DataFrame, names: tuple[str, ...] = ("speed", "curvature", "lateral_offset", "density")) -> DataFrame:
    """z-scores within the group, 0 for a lane alone."""
    group = Window.partitionBy("camera", "group_id")
    z = {f"z_{n}": F.when(F.count("*").over(group) > 1, (F.col(n) - F.avg(n).over(group)) / (F.stddev_pop(n).over(group) + 1e-6)).otherwise(0.0) for n in names}
    return stats.withColumns(z)


def baseline_features(points: DataFrame, trajs: DataFrame, lanes: DataFrame) -> DataFrame:
    """Five features of a lane, to unit length."""
    from ..functions import vectors as v

    xs = points.select("camera", "track_id", "x").join(trajs.select(*LANE, "track_id"), ["camera", "track_id"]).groupBy(*LANE).agg(F.stddev_pop("x").alias("spread"))
    per = trajs.groupBy(*LANE).agg(F.avg("speed").alias("m"), F.stddev_pop("speed").alias("s"), F.count("*").alias("n"), F.avg("n_points").alias("len"))
    rows = lanes.select(*LANE).join(per.join(xs, LANE), LANE, "left")
    feats = F.array(*(F.coalesce(c, F.lit(0.0)) for c in (F.col("m"), F.col("s"), F.col("spread"), F.col("n") / F.greatest(F.lit(50), F.col("n")), F.col("len"))))
    rows = rows.select(*LANE, feats.alias("f"))
    return rows.select(*LANE, F.transform("f", lambda x: x / (v.norm(F.col("f")) + 1e-8)).alias("features"))


def edge_label(rank: Column, left: Column, right: Column, successor: Column) -> Column:
    """Readable role of a lane."""
    return (
        F.when(successor & right, "Merge (rightmost)")
        .when(successor, "Merge")
        .when(left, "Leftmost")
        .when(right, "Rightmost")
        .when((rank >= 0.35) & (rank <= 0.65), "Middle")
        .when(rank < 0.35, "Inner")
        .otherwise("Outer")
    )

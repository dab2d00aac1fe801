"""Sliding time windows anchored at each lane's first point, and what is computed on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, LaneConfig

LANE = ["camera", "group_id", "cls_id"]
STATS = ("speed", "curvature", "lateral_offset", "density")


def n_windows(size: float, stride: float, total: float) -> int:
    return int((total - size) / stride) + 1


def assign_windows(trajs: DataFrame, size: float, stride: float, total: float) -> DataFrame:
    """Each trajectory in every window that holds its mean time."""
    t = F.col("mean_time") - F.col("start")
    held = F.filter(F.sequence(F.lit(0), F.lit(n_windows(size, stride, total) - 1)), lambda w: (w * stride <= F.col("t")) & (F.col("t") < w * stride + size))
    return _started(trajs).withColumn("t", t).withColumn("w", F.explode(held)).drop("t", "start")


def _started(trajs: DataFrame) -> DataFrame:
    """With each lane's first time; trajectories of a lane needn't meet in one task for it."""
    return trajs.join(trajs.groupBy(*LANE).agg(F.min("first_time").alias("start")), LANE)


def _all(lanes: DataFrame, count: int) -> DataFrame:
    return lanes.select(*LANE).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def window_stats(trajs: DataFrame, lanes: DataFrame, config: LaneConfig = DEFAULT) -> DataFrame:
    """Statistics of every window of every lane; counts are relative to the lane's fullest window."""
    size, stride, total = config.window_size, config.window_stride, config.window_total
    got = assign_windows(trajs, size, stride, total).groupBy(*LANE, "w").agg(F.avg("speed").alias("speed"), F.avg("curvature").alias("curvature"), F.avg("lateral_offset").alias("lateral_offset"), F.count("*").alias("n_traj"))
    rows = _all(lanes, n_windows(size, stride, total)).join(got, [*LANE, "w"], "left").fillna(0.0, ["speed", "curvature", "lateral_offset"]).fillna(0, ["n_traj"])
    most = F.max("n_traj").over(Window.partitionBy(*LANE))
    return rows.withColumn("density", F.col("n_traj") / F.greatest(most, F.lit(1))).withColumn("valid", F.col("n_traj") >= config.min_window_trajectories)


def sweep(trajs: DataFrame, sizes: tuple[float, ...], total: float) -> DataFrame:
    """Trajectories by window for several sizes at half overlap, in one plan."""
    rows = _started(trajs).withColumn("t", F.col("mean_time") - F.col("start")).withColumn("size", F.explode(F.array(*(F.lit(float(s)) for s in sizes))))
    last = F.floor((F.lit(float(total)) - F.col("size")) / (F.col("size") / 2)).cast("int")
    held = F.filter(F.sequence(F.lit(0), last), lambda w: (w * F.col("size") / 2 <= F.col("t")) & (F.col("t") < w * F.col("size") / 2 + F.col("size")))
    return rows.withColumn("w", F.explode(held)).groupBy(*LANE, "size", "w").agg(F.count("*").alias("n_traj"))


def vector(names: tuple[str, ...] = STATS) -> Column:
    return F.array(*(F.col(n).cast("double") for n in names))


def forward_fill(windows: DataFrame) -> DataFrame:
    """The last valid vector up to each window; leading invalid ones stay as they are."""
    order = Window.partitionBy(*LANE).orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    rows = windows.withColumn("e", vector())
    return rows.withColumn("filled", F.coalesce(F.last(F.when(F.col("valid"), F.col("e")), ignorenulls=True).over(order), F.col("e")))


def delta(windows: DataFrame) -> DataFrame:
    """Length of the change from the window before; 0 unless both are valid."""
    order = Window.partitionBy(*LANE).orderBy("w")
    rows = windows.withColumn("e", vector()).withColumn("p", F.lag("e").over(order)).withColumn("pv", F.lag("valid").over(order))
    change = F.sqrt(F.aggregate(F.zip_with("e", "p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return rows.withColumn("delta", F.when(F.col("valid") & F.coalesce("pv", F.lit(False)), change).otherwise(0.0)).drop("p", "pv")


def zscore_anomalies(windows: DataFrame, limit: float = DEFAULT.z_limit, least: int = 3) -> DataFrame:
    """Valid windows of lanes with enough of them, and whether any statistic is far from the lane's mean."""
    lane = Window.partitionBy(*LANE)
    rows = windows.where("valid").withColumn("n_valid", F.count("*").over(lane)).where(F.col("n_valid") >= least)
    z = [F.abs((F.col(n) - F.avg(n).over(lane)) / (F.stddev_pop(n).over(lane) + 1e-8)) for n in STATS]
    return rows.withColumn("z", F.greatest(*z)).withColumn("anomaly", F.col("z") > limit)


def inject(windows: DataFrame, lane_no: Column, ratio: float = 0.3, most: int = 3) -> DataFrame:
    """Anomalies in a fixed choice of each lane's valid windows (R1, on statistics).

    The choice and the kind come from an arithmetic hash of lane and window: slowed, thinned, or
    shifted sideways.
    """
    h = F.pmod(lane_no * 7919 + F.col("w") * 104729, F.lit(1_000_003))
    lane = Window.partitionBy(*LANE)
    rows = windows.withColumn("h", h).withColumn("n_valid", F.sum(F.col("valid").cast("int")).over(lane))
    rank = F.row_number().over(Window.partitionBy(*LANE, "valid").orderBy("h", "w"))
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("n_valid") * ratio)))
    rows = rows.withColumn("label", F.col("valid") & (rank <= n)).withColumn("kind", F.when(F.col("label"), F.pmod("h", F.lit(3))))
    shift = (F.pmod("h", F.lit(1000)) / 1000.0) * 0.04
    return (
        rows.withColumn("speed", F.when(F.col("kind") == 0, F.col("speed") * 0.2).otherwise(F.col("speed")))
        .withColumn("density", F.when((F.col("kind") == 1) & (F.col("n_traj") > 1), F.col("density") * 0.1).otherwise(F.col("density")))
        .withColumn("lateral_offset", F.when(F.col("kind") == 2, F.col("lateral_offset") + shift).otherwise(F.col("lateral_offset")))
    )


def inject_trajectories(points: DataFrame, injected: DataFrame) -> DataFrame:
    """The anomalies of ``inject`` put into the trajectories that the statistics are of.

    ``points``: camera, group_id, cls_id, w, track_id, x, y, a row a point; ``injected``: what ``inject`` gives. Slowed
    windows shrink to a fifth around the mean of their points; of thinned ones a tenth of the tracks
    stays, one at least, the first by an arithmetic hash; shifted ones move by a vector whose
    components add up, in size, to what their lateral offset grew by. Other windows stay as they are.
    """
    key = [*LANE, "w"]
    rows = points.join(injected.select(*key, "kind", "h"), key)
    centre = rows.where("kind = 0").groupBy(*key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    tracks = rows.where("kind = 1").select(*key, "track_id").distinct()
    n = tracks.groupBy(*key).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*key).orderBy(F.pmod(F.col("track_id") * 7919 + F.col("w") * 104729, F.lit(1_000_003)), "track_id")
    kept = tracks.join(n, key).withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.greatest(F.floor(F.col("n") / 10), F.lit(1))).select(*key, "track_id", F.lit(True).alias("kept"))
    rows = rows.join(centre, key, "left").join(kept, [*key, "track_id"], "left").where("kind is null or kind <> 1 or kept")
    shift, part = (F.pmod("h", F.lit(1000)) / 1000.0) * 0.04, F.pmod(F.floor(F.col("h") / 1000), F.lit(1000)) / 1000.0
    sign = lambda bit: 1 - 2 * F.pmod(F.floor(F.col("h") / bit), F.lit(2))

    def moved(at: str, centre: str, by: Column) -> Column:
        return F.when(F.col("kind") == 0, F.col(centre) + 0.2 * (F.col(at) - F.col(centre))).when(F.col("kind") == 2, F.col(at) + by).otherwise(F.col(at)).alias(at)

    return rows.select(*(c for c in points.columns if c not in ("x", "y")), moved("x", "cx", sign(1) * shift * part), moved("y", "cy", sign(2) * shift * (1 - part)))

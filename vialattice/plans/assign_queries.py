"""Queries of the assignment family, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assign as op
from .fixtures import ANNOTATED_SQL, POINTS_SQL, SEGS_SQL, annotations, distances_sql, lanes, points, r6

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


BEST = f"""
with {POINTS_SQL}, {SEGS_SQL}, {distances_sql()},
scored as (select track_id, group_id, cls_id, avg(d) as score, stddev_samp(d) as std from dist group by all having count(*) >= 5),
best as (select track_id, min({{'score': score, 'group_id': group_id, 'cls_id': cls_id, 'std': std}}) as b from scored group by track_id),
assigned as (select track_id, case when b.score > 60 then -1 else b.cls_id end::bigint as lane_id, b.score as lane_score,
  case when b.score > 60 then -1 else b.group_id end::bigint as group_id, b.score <= 60 and coalesce(b.std, 0) > 30 as lane_change from best)"""


def _five(spark, sf_dir):
    """Tracks of five cameras, a user's all on one, and the lanes of each."""
    return points(spark, sf_dir, 5), lanes(spark, 5)


@query(BEST + " select track_id, lane_id, round(lane_score, 6) as lane_score, group_id, lane_change from assigned")
def assign_global(spark, sf_dir):
    return op.assign_global(*_five(spark, sf_dir)).select("track_id", "lane_id", *r6("lane_score"), "group_id", "lane_change")


@query(BEST + " select track_id, round(time, 3) as time, round(x, 6) as x, round(y, 6) as y, lane_id, round(lane_score, 6) as lane_score, group_id, lane_change from points join assigned using (track_id)")
def assign_points(spark, sf_dir):
    return op.assign_points(*_five(spark, sf_dir)).select("track_id", F.round("time", 3).alias("time"), *r6("x", "y"), "lane_id", *r6("lane_score"), "group_id", "lane_change")


@query(BEST + """ select 'cam' || (track_id // 1000 % 5) as camera, count(distinct track_id) as total_tracks, count(distinct case when lane_id >= 0 then track_id end) as assigned_tracks,
  count(distinct track_id) - count(distinct case when lane_id >= 0 then track_id end) as rejected_tracks,
  round((count(distinct track_id) - count(distinct case when lane_id >= 0 then track_id end)) / greatest(count(distinct track_id), 1)::double, 6) as rejection_rate,
  count(distinct case when lane_change then track_id end) as lane_change_tracks from assigned group by 1""")
def assign_summary(spark, sf_dir):
    out = op.summary(op.assign_global(*_five(spark, sf_dir)))
    return out.select("camera", "total_tracks", "assigned_tracks", "rejected_tracks", *r6("rejection_rate"), "lane_change_tracks")


NORMAL = f"""
with {POINTS_SQL}, {SEGS_SQL},
np as (select event_id, track_id, x / 1920::double as x, y / 1080::double as y from points),
ns as (select group_id, cls_id, seg, ax / 1920 as ax, ay / 1080 as ay, bx / 1920 as bx, by2 / 1080 as by2 from segs),
{distances_sql("np", "ns")},
scored as (select track_id, group_id, cls_id, avg(d) as score from dist group by all having count(*) >= 5),
best as (select track_id, group_id, min({{'score': score, 'cls_id': cls_id}}) as b from scored group by all),
per_group as (select group_id, track_id, b.cls_id as cls_id, b.score as score from best where b.score < 60 / 1920::double)"""


@query(NORMAL + " select group_id::bigint as group_id, track_id, cls_id::bigint as cls_id, round(score, 6) as score from per_group")
def assign_per_group(spark, sf_dir):
    return op.assign_per_group(*_five(spark, sf_dir)).select(F.col("group_id").cast("long"), "track_id", F.col("cls_id").cast("long"), *r6("score"))


@query(f"with {POINTS_SQL} select track_id, event_id, n_points from (select track_id, event_id, count(*) over (partition by track_id) as n_points from points) where n_points >= 5")
def short_track_filter(spark, sf_dir):
    kept = op.valid_points(points(spark, sf_dir))
    from pyspark.sql.window import Window

    return kept.select("track_id", "event_id", F.count("*").over(Window.partitionBy("track_id")).alias("n_points"))


@query(f"""with {POINTS_SQL}, {SEGS_SQL},
foot as (select p.event_id, p.x, p.y, s.*, least(greatest(((p.x - ax) * (bx - ax) + (p.y - ay) * (by2 - ay)) / ((bx - ax) ** 2 + (by2 - ay) ** 2), 0), 1) as t from points p cross join segs s),
near as (select event_id, group_id, cls_id, min({{'d': sqrt((x - (ax + t * (bx - ax))) ** 2 + (y - (ay + t * (by2 - ay))) ** 2), 'seg': seg, 's': case when (bx - ax) * (y - ay) - (by2 - ay) * (x - ax) < 0 then -1 else 1 end}}) as n from foot group by all)
select event_id, group_id::bigint as group_id, cls_id::bigint as cls_id, round(n.d * n.s, 6) as signed from near""")
def signed_lateral(spark, sf_dir):
    return op.signed_lateral(*_five(spark, sf_dir)).select("event_id", F.col("group_id").cast("long"), F.col("cls_id").cast("long"), *r6("signed"))


@query(f"with {POINTS_SQL} select event_id, class::bigint as class, round(conf, 6) as conf from points where class in (2, 5, 7) and conf >= 0.25::double")
def detection_filter(spark, sf_dir):
    return op.detections(points(spark, sf_dir)).select("event_id", F.col("class").cast("long"), *r6("conf"))


@query(f"with {POINTS_SQL} select camera5 as camera, count(distinct floor(time)::bigint) as n_frames, count(*) as n_points, count(distinct track_id) as n_vehicles from points group by 1")
def extraction_stats(spark, sf_dir):
    return op.extraction_stats(points(spark, sf_dir, 5))


@query(f"with {POINTS_SQL} select track_id, count(*) as n_points, round(arg_min(x, struct_pack(t := time, e := event_id)), 6) as first_x, round(arg_max(y, struct_pack(t := time, e := event_id)), 6) as last_y from points group by track_id")
def track_trails(spark, sf_dir):
    t = op.trails(points(spark, sf_dir)).withColumn("first_x", F.element_at("trail", 1)["x"]).withColumn("last_y", F.element_at("trail", -1)["y"])
    return t.select("track_id", F.size("trail").cast("long").alias("n_points"), *r6("first_x", "last_y"))


@query(f"with {POINTS_SQL} select event_id, count(*) over w as n, round(avg(x) over w, 6) as mean_x from points window w as (partition by track_id order by time, event_id rows between 29 preceding and current row)")
def trailing_buffer(spark, sf_dir):
    t = op.trails(points(spark, sf_dir), 30)
    mean = F.aggregate("trail", F.lit(0.0), lambda s, p: s + p["x"]) / F.size("trail")
    return t.select("event_id", F.size("trail").cast("long").alias("n"), F.round(mean, 6).alias("mean_x"))


@query(BEST + " select track_id, ((group_id * 4 + lane_id) % 12 + 12) % 12 as slot from assigned")
def colour_slots(spark, sf_dir):
    a = op.assign_global(*_five(spark, sf_dir))
    return a.select("track_id", op.colour_slot(F.col("group_id"), F.col("lane_id")).alias("slot"))


@query(f"""with {ANNOTATED_SQL}, steps as (select *, sqrt((wx - lag(wx) over w) ** 2 + (wy - lag(wy) over w) ** 2) as step from annotated window w as (partition by vec_id order by k))
select group_id, cls_id, floor(sum(step) / 5) + 1 as n from steps group by group_id, cls_id""")
def densified_lanes(spark, sf_dir):
    groups = annotations(spark, sf_dir).select(F.explode("lane_groups").alias("g"))
    # few bytes, but hundreds of points to make for each lane: as many tasks as a cluster can use, not as bytes ask for
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    each = groups.select("g.group_id", F.explode("g.lanes").alias("l")).repartition(tasks, "group_id", "l.cls_id")
    dense = each.withColumn("dense", g.densify(F.col("l.waypoints"), 5.0))
    return dense.select(F.col("group_id").cast("long"), F.col("l.cls_id").cast("long").alias("cls_id"), F.size("dense").cast("double").alias("n"))

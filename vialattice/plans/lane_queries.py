"""Queries of lane tables, roles, statistics and windows, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import assign, windows
from ..operators import lanes as op
from .assign_queries import NORMAL
from .fixtures import ANNOTATED_SQL, SHAPE_POINTS_SQL, annotations, documents, lanes, points, r6, shapes

#: The driver's events span thirty days: windows of days instead of minutes, as many as by default.
FIXTURE = replace(DEFAULT, window_size=432_000.0, window_stride=216_000.0, window_total=2_592_000.0)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def longs(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@query(f"with {ANNOTATED_SQL} select camera, group_id, cls_id, k::bigint as k, round(wx / 1920, 6) as x, round(wy / 1080, 6) as y from annotated")
def lane_unnest(spark, sf_dir):
    rows = op.unnest_lanes(annotations(spark, sf_dir)).select("camera", *longs("group_id", "cls_id"), F.posexplode("waypoints").alias("k", "p"))
    return rows.select("camera", "group_id", "cls_id", *longs("k"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"with {ANNOTATED_SQL} select distinct camera, group_id, cls_id, exists (select 1 from related r where r.camera = a.camera and r.group_id = a.group_id and r.from_cls = a.cls_id and type = 'successor') as has_successor from annotated a")
def lane_successor(spark, sf_dir):
    docs = annotations(spark, sf_dir)
    return op.successors(op.unnest_lanes(docs), op.unnest_relationships(docs)).select("camera", *longs("group_id", "cls_id"), "has_successor")


@query(f"with {ANNOTATED_SQL} select camera, group_id, type, from_cls, to_cls from related")
def lane_relationships(spark, sf_dir):
    return op.unnest_relationships(annotations(spark, sf_dir)).select("camera", *longs("group_id"), "type", *longs("from_cls", "to_cls"))


@query(f"with {ANNOTATED_SQL} select camera, 'annot_' || group_id || '_' || cls_id as key, count(*) as n_points from annotated group by camera, group_id, cls_id")
def lane_geometry_map(spark, sf_dir):
    return op.lane_map(annotations(spark, sf_dir)).select("camera", F.explode("geometry").alias("key", "line")).select("camera", "key", F.size("line").cast("long").alias("n_points"))


@query("select vec_id, 'cam' || (vec_id // 50) || '_' || (vec_id // 5) || '_' || (vec_id % 5) as key, 'cam' || (vec_id // 50) as camera from embeddings")
def lane_keys(spark, sf_dir):
    from .fixtures import index

    rows = index(spark, sf_dir).select(F.col("lane").alias("vec_id"), op.lane_key("camera", "grp", "ordinal").alias("key"))
    return rows.withColumn("camera", op.key_camera(F.col("key")))


def _shape_lanes(spark, sf_dir):
    n = F.col("vec_id")
    return shapes(spark, sf_dir).select(F.lit("cam0").alias("camera"), F.floor(n / 5).alias("group_id"), (n % 5).alias("cls_id"), (n % 5).alias("lane_ord"), F.col("line").alias("waypoints"))


@query(f"""with {SHAPE_POINTS_SQL},
l as (select vec_id, vec_id // 5 as grp, vec_id % 5 as lane, avg(px) as cx, avg(py) as cy, max_by(px, k) - min_by(px, k) as dx, max_by(py, k) - min_by(py, k) as dy from pts group by vec_id),
t as (select *, avg(dx / sqrt(dx * dx + dy * dy)) over g as tx, avg(dy / sqrt(dx * dx + dy * dy)) over g as ty, count(*) over g as n from l window g as (partition by grp)),
f as (select *, case when ty < 0 or (ty = 0 and tx < 0) then -1 else 1 end / (sqrt(tx * tx + ty * ty) + 1e-8) as s from t),
r as (select *, row_number() over (partition by grp order by round(-cx * ty * s + cy * tx * s, 9), lane) as rn, max(n) over () as largest from f)
select grp as group_id, lane as cls_id, round(case when n > 1 then (rn - 1) / (n - 1)::double else 0.5 end, 6) as lateral_rank, rn = 1 as is_leftmost, rn = n as is_rightmost, round(n / largest::double, 6) as group_size from r""")
def lane_roles(spark, sf_dir):
    return op.roles(_shape_lanes(spark, sf_dir)).select("group_id", "cls_id", *r6("lateral_rank"), "is_leftmost", "is_rightmost", *r6("group_size"))


def _trajectories(spark, sf_dir):
    given = points(spark, sf_dir)
    normal = op.unnest_lanes(documents(spark))
    held = assign.assign_per_group(given, lanes(spark))
    return op.normalized(given), normal, op.trajectories(op.normalized(given), held, normal)


TRAJ = NORMAL + """,
steps as (select np.track_id, event_id, time, np.x, np.y, np.x - lag(np.x) over o as dx, np.y - lag(np.y) over o as dy
  from np join points using (event_id) window o as (partition by np.track_id order by time, event_id)),
angles as (select *, case when dx is not null then atan2(dy, dx) end as angle from steps),
turns as (select *, abs(angle - lag(angle) over (partition by track_id order by time, event_id)) as turn from angles),
motion as (select track_id, avg(sqrt(dx * dx + dy * dy)) as speed, avg(least(turn, 2 * pi() - turn)) as curvature, avg(time) as mean_time, min(time) as first_time, count(*) as n_points from turns group by track_id),
side as (select group_id, cls_id, track_id, avg(abs(y - (135 + 270 * (2 * group_id + cls_id)) / 1080::double)) as lateral_offset from per_group join np using (track_id) group by all),
traj as (select * from side join motion using (track_id)),
lane as (select distinct group_id, cls_id from segs)"""

STATS = TRAJ + """,
stats as (select group_id, cls_id, coalesce(avg(speed), 0) as speed, coalesce(avg(curvature), 0) as curvature, coalesce(avg(lateral_offset), 0) as lateral_offset, count(track_id) as n_traj
  from lane left join traj using (group_id, cls_id) group by all),
dense as (select *, n_traj / greatest(max(n_traj) over (partition by group_id), 1)::double as density from stats)"""


@query(STATS + " select group_id::bigint as group_id, cls_id::bigint as cls_id, round(speed, 6) as speed, round(curvature, 6) as curvature, round(lateral_offset, 6) as lateral_offset, n_traj, round(density, 6) as density from dense")
def traj_stats(spark, sf_dir):
    _, normal, trajs = _trajectories(spark, sf_dir)
    return op.traj_stats(trajs, normal).select(*longs("group_id", "cls_id"), *r6("speed", "curvature", "lateral_offset"), "n_traj", *r6("density"))


@query(STATS + """ select group_id::bigint as group_id, cls_id::bigint as cls_id, """ + ", ".join(f"round(({n} - avg({n}) over g) / (stddev_pop({n}) over g + 1e-6), 4) as z_{n}" for n in ("speed", "curvature", "lateral_offset", "density")) + " from dense window g as (partition by group_id)")
def group_relative(spark, sf_dir):
    _, normal, trajs = _trajectories(spark, sf_dir)
    z = op.group_relative(op.traj_stats(trajs, normal))
    return z.select(*longs("group_id", "cls_id"), *(F.round(f"z_{n}", 4).alias(f"z_{n}") for n in ("speed", "curvature", "lateral_offset", "density")))


@query(TRAJ + """,
per as (select group_id, cls_id, avg(speed) as m, stddev_pop(speed) as s, count(*) as n, avg(n_points) as len from traj group by all),
xs as (select group_id, cls_id, stddev_pop(x) as spread from traj join np using (track_id) group by all),
f as (select group_id, cls_id, m, s, spread, n / greatest(50, n)::double as d, len, sqrt(m * m + s * s + spread * spread + (n / greatest(50, n)::double) ** 2 + len * len) + 1e-8 as norm from per join xs using (group_id, cls_id))
select group_id::bigint as group_id, cls_id::bigint as cls_id, round(m / norm, 6) as f0, round(s / norm, 6) as f1, round(spread / norm, 6) as f2, round(d / norm, 6) as f3, round(len / norm, 6) as f4 from f""")
def baseline_features(spark, sf_dir):
    given, normal, trajs = _trajectories(spark, sf_dir)
    rows = op.baseline_features(given, trajs, normal)
    return rows.select(*longs("group_id", "cls_id"), *(F.round(F.col("features")[k], 6).alias(f"f{k}") for k in range(5)))


WINDOWS = TRAJ + """,
timed as (select *, mean_time - min(first_time) over (partition by group_id, cls_id) as t from traj),
ws as (select unnest(range(11)) as w),
held as (select * from timed join ws on w * 216000 <= t and t < w * 216000 + 432000),
win as (select group_id, cls_id, w, coalesce(avg(speed), 0) as speed, coalesce(avg(curvature), 0) as curvature, coalesce(avg(lateral_offset), 0) as lateral_offset, count(track_id) as n_traj
  from (lane cross join ws) left join held using (group_id, cls_id, w) group by all),
wd as (select *, n_traj / greatest(max(n_traj) over (partition by group_id, cls_id), 1)::double as density, n_traj >= 2 as valid from win)"""
HEAD = "group_id::bigint as group_id, cls_id::bigint as cls_id, w::bigint as w"


def _windows(spark, sf_dir):
    _, normal, trajs = _trajectories(spark, sf_dir)
    return windows.window_stats(trajs, normal, FIXTURE)


@query(WINDOWS + f" select {HEAD}, n_traj, valid from wd")
def window_bins(spark, sf_dir):
    return _windows(spark, sf_dir).select(*longs("group_id", "cls_id", "w"), "n_traj", "valid")


@query(WINDOWS + f" select {HEAD}, round(speed, 6) as speed, round(curvature, 6) as curvature, round(lateral_offset, 6) as lateral_offset, round(density, 6) as density from wd")
def window_stats(spark, sf_dir):
    return _windows(spark, sf_dir).select(*longs("group_id", "cls_id", "w"), *r6(*windows.STATS))


@query(TRAJ + """,
timed as (select *, mean_time - min(first_time) over (partition by group_id, cls_id) as t from traj),
sizes as (select unnest([86400, 172800, 432000, 864000, 1296000])::double as size),
ws as (select size, unnest(range(((2592000 - size) / (size / 2))::bigint + 1)) as w from sizes)
select group_id::bigint as group_id, cls_id::bigint as cls_id, size, w::bigint as w, count(*) as n_traj from timed join ws on w * size / 2 <= t and t < w * size / 2 + size group by all""")
def window_sweep(spark, sf_dir):
    _, _, trajs = _trajectories(spark, sf_dir)
    rows = windows.sweep(trajs, (86400, 172800, 432000, 864000, 1296000), FIXTURE.window_total)
    return rows.select(*longs("group_id", "cls_id"), "size", *longs("w"), "n_traj")


@query(WINDOWS + f""", e as (select *, last_value(case when valid then speed end ignore nulls) over o as fs, last_value(case when valid then density end ignore nulls) over o as fd from wd window o as (partition by group_id, cls_id order by w rows unbounded preceding))
select {HEAD}, round(coalesce(fs, speed), 6) as speed, round(coalesce(fd, density), 6) as density from e""")
def window_ffill(spark, sf_dir):
    rows = windows.forward_fill(_windows(spark, sf_dir))
    return rows.select(*longs("group_id", "cls_id", "w"), F.round(F.col("filled")[0], 6).alias("speed"), F.round(F.col("filled")[3], 6).alias("density"))


@query(WINDOWS + f""", d as (select *, lag(valid) over o as pv, sqrt((speed - lag(speed) over o) ** 2 + (curvature - lag(curvature) over o) ** 2 + (lateral_offset - lag(lateral_offset) over o) ** 2 + (density - lag(density) over o) ** 2) as change from wd window o as (partition by group_id, cls_id order by w))
select {HEAD}, round(case when valid and coalesce(pv, false) then change else 0 end, 6) as delta from d""")
def embedding_delta(spark, sf_dir):
    return windows.delta(_windows(spark, sf_dir)).select(*longs("group_id", "cls_id", "w"), *r6("delta"))


@query(WINDOWS + f""", v as (select * from (select *, count(*) over (partition by group_id, cls_id) as n_valid from wd where valid) where n_valid >= 3),
z as (select *, greatest({", ".join(f"abs(({n} - avg({n}) over g) / (stddev_pop({n}) over g + 1e-8))" for n in windows.STATS)}) as z from v window g as (partition by group_id, cls_id))
select {HEAD}, round(z, 4) as z, z > 2 as anomaly from z""")
def window_zscore_anomaly(spark, sf_dir):
    rows = windows.zscore_anomalies(_windows(spark, sf_dir))
    return rows.select(*longs("group_id", "cls_id", "w"), F.round("z", 4).alias("z"), "anomaly")


@query(WINDOWS + f""", h as (select *, ((group_id * 2 + cls_id) * 7919 + w * 104729) % 1000003 as h, sum(valid::int) over (partition by group_id, cls_id) as n_valid from wd),
r as (select *, valid and row_number() over (partition by group_id, cls_id, valid order by h, w) <= least(3, greatest(1, floor(n_valid * 0.3::double))) as label from h),
k as (select *, case when label then h % 3 end as kind from r)
select {HEAD}, label, kind::bigint as kind, round(case when kind = 0 then speed * 0.2::double else speed end, 6) as speed,
  round(case when kind = 1 and n_traj > 1 then density * 0.1::double else density end, 6) as density,
  round(case when kind = 2 then lateral_offset + (h % 1000) / 1000::double * 0.04::double else lateral_offset end, 6) as lateral_offset from k""")
def inject_anomalies(spark, sf_dir):
    rows = windows.inject(_windows(spark, sf_dir), F.col("group_id") * 2 + F.col("cls_id"))
    return rows.select(*longs("group_id", "cls_id", "w"), "label", *longs("kind"), *r6("speed", "density", "lateral_offset"))


@query(WINDOWS + f""", h as (select *, ((group_id * 2 + cls_id) * 7919 + w * 104729) % 1000003 as h, sum(valid::int) over (partition by group_id, cls_id) as n_valid from wd),
r as (select *, valid and row_number() over (partition by group_id, cls_id, valid order by h, w) <= least(3, greatest(1, floor(n_valid * 0.3::double))) as label from h),
k as (select *, case when label then h % 3 end as kind from r),
pt as (select k.group_id, k.cls_id, k.w, np.track_id, event_id, x, y, kind, h from held join k using (group_id, cls_id, w) join np using (track_id)),
c as (select group_id, cls_id, w, avg(x) as cx, avg(y) as cy from pt where kind = 0 group by all),
t as (select *, row_number() over (partition by group_id, cls_id, w order by (track_id * 7919 + w * 104729) % 1000003, track_id) as place, count(*) over (partition by group_id, cls_id, w) as n from (select distinct group_id, cls_id, w, track_id from pt where kind = 1)),
s as (select pt.*, cx, cy, (h % 1000) / 1000::double * 0.04::double as shift, (h // 1000 % 1000) / 1000::double as part from pt left join c using (group_id, cls_id, w)
  where kind is null or kind <> 1 or exists (select 1 from t where t.group_id = pt.group_id and t.cls_id = pt.cls_id and t.w = pt.w and t.track_id = pt.track_id and place <= greatest(n // 10, 1)))
select {HEAD}, track_id, event_id,
  round(case when kind = 0 then cx + 0.2::double * (x - cx) when kind = 2 then x + (1 - 2 * (h % 2)) * shift * part else x end, 6) as x,
  round(case when kind = 0 then cy + 0.2::double * (y - cy) when kind = 2 then y + (1 - 2 * (h // 2 % 2)) * shift * (1 - part) else y end, 6) as y from s""")
def inject_trajectories(spark, sf_dir):
    given, normal, trajs = _trajectories(spark, sf_dir)
    injected = windows.inject(windows.window_stats(trajs, normal, FIXTURE), F.col("group_id") * 2 + F.col("cls_id"))
    held = windows.assign_windows(trajs, FIXTURE.window_size, FIXTURE.window_stride, FIXTURE.window_total).select(*windows.LANE, "w", "track_id")
    at = held.join(given.select("camera", "track_id", "event_id", "x", "y"), ["camera", "track_id"])
    return windows.inject_trajectories(at, injected).select(*longs("group_id", "cls_id", "w"), "track_id", "event_id", *r6("x", "y"))


@query("select vec_id, case when s and r then 'Merge (rightmost)' when s then 'Merge' when l then 'Leftmost' when r then 'Rightmost' when k between 0.35::double and 0.65::double then 'Middle' when k < 0.35::double then 'Inner' else 'Outer' end as role from (select vec_id, (vec_id % 5) / 4::double as k, vec_id % 5 = 0 as l, vec_id % 5 = 4 as r, vec_id % 7 = 0 as s from embeddings)")
def role_label(spark, sf_dir):
    from .fixtures import index

    return index(spark, sf_dir).select(F.col("lane").alias("vec_id"), op.edge_label(F.col("rank"), F.col("is_left"), F.col("is_right"), F.col("has_successor")).alias("role"))



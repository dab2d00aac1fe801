"""Queries of pseudo-lanes, orders, samples, batches and specifications, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..operators import assign, directed, match, metrics, pseudo, ranking, spec, windows
from ..operators import generate as gen
from ..operators import lanes as lane_op
from .fixtures import INDEX_SQL, WAYPOINTS_SQL, documents, index, lanes, points, r6, table
from .generate_queries import CONTEXT, FRAME, SP, flat, resample_sql, right_context, scaled, smooth_sql
from .lane_queries import FIXTURE, STATS, TRAJ, longs
from .match_queries import KNN

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CAMERAS = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def draw_sql(*keys: str, seed: int = 42) -> str:
    return f"(({seed * ranking.FACTORS[2]} + " + " + ".join(f"(({k}) % {ranking.MODULUS}) * {ranking.FACTORS[n % 3]}" for n, k in enumerate(keys)) + f") % {ranking.MODULUS})"


BY_CAMERA = f"{TRAJ}, {WAYPOINTS_SQL}, ct as (select *, 'cam' || ((track_id // 1000) % {CAMERAS}) as camera from traj)"
PSEUDO = BY_CAMERA + """,
st as (select camera, group_id, cls_id, avg(speed) as speed, avg(curvature) as curvature, avg(lateral_offset) as lateral_offset, count(*) as n_traj from ct group by all),
dn as (select *, n_traj / greatest(max(n_traj) over (partition by camera, group_id), 1)::double as density from st),
wl as (select group_id, cls_id, avg(wy) / 1080 as lateral_center from waypoints group by all),
ps as (select dn.*, lateral_center, row_number() over (partition by camera, group_id order by round(lateral_center, 9), cls_id) - 1 as lane_idx, count(*) over (partition by camera, group_id) as n_lanes from dn join wl using (group_id, cls_id))"""
KEYS = "camera, group_id::bigint as group_id, cls_id::bigint as cls_id"


def _lanes(spark):
    return lanes(spark, CAMERAS).withColumn("lane_ord", F.col("cls_id"))


def _pseudo(spark, sf_dir):
    return pseudo.pseudo_lanes(points(spark, sf_dir, CAMERAS), _lanes(spark))


@query(PSEUDO + f" select {KEYS}, lane_idx, camera || '_' || group_id || '_' || lane_idx as lane_key, 0::double as heading, round(lateral_center, 6) as lateral_center, round(speed, 6) as speed, round(curvature, 6) as curvature, round(lateral_offset, 6) as lateral_offset, round(density, 6) as density, n_traj, n_lanes from ps")
def pseudo_lanes(spark, sf_dir):
    return _pseudo(spark, sf_dir).select("camera", *longs("group_id", "cls_id", "lane_idx"), "lane_key", *r6("heading", "lateral_center", "speed", "curvature", "lateral_offset", "density"), "n_traj", "n_lanes")


@query(PSEUDO + f""",
g as (select *, case when n_lanes > 1 then lane_idx / (n_lanes - 1)::double else 0.5 end as rank, lane_idx = 0 as l, lane_idx = n_lanes - 1 as r, 0.05::double + 0.013::double * cls_id * (group_id + 1) as p from ps),
m as (select *, min(p) over c as low, max(p) over c as high from g window c as (partition by camera, group_id))
select {KEYS}, n_traj, round(rank, 6) as lateral_rank, l as is_leftmost, r as is_rightmost, n_lanes,
  round(case when n_traj < 50 then rank when n_lanes = 1 then 0.5 when high - low < 1e-6 then p else (p - low) / (high - low) end, 6) as encoder_rank,
  case when n_traj < 50 then l else cls_id = 1 end as encoder_left, case when n_traj < 50 then r else cls_id = 0 end as encoder_right, case when n_traj < 50 then 'low' else 'high' end as confidence from m""")
def lane_properties(spark, sf_dir):
    said = lanes(spark, CAMERAS).select(*lane_op.LANE, (F.lit(0.05) + F.lit(0.013) * F.col("cls_id") * (F.col("group_id") + 1)).alias("predicted_rank"), (F.col("cls_id") == 1).alias("predicted_left"), (F.col("cls_id") == 0).alias("predicted_right"))
    out = pseudo.properties(_pseudo(spark, sf_dir), said)
    return out.select("camera", *longs("group_id", "cls_id"), "n_traj", *r6("lateral_rank"), "is_leftmost", "is_rightmost", "n_lanes", *r6("encoder_rank"), "encoder_left", "encoder_right", "confidence")


@query(f"with {INDEX_SQL}, m as (select lane, e[1] as x, min(e[1]) over (partition by grp) as low, max(e[1]) over (partition by grp) as high, count(*) over (partition by grp) as n from idx) select lane, round(case when n = 1 then 0.5 when high - low < 1e-6 then x else (x - low) / (high - low) end, 6) as rank from m")
def group_rescale(spark, sf_dir):
    rows = index(spark, sf_dir).select("lane", "grp", F.col("e")[0].alias("x"))
    return pseudo.rescaled(rows, "x", ["grp"]).select("lane", F.round("x_rescaled", 6).alias("rank"))


@query(f"with {SP}, {resample_sql('sp', 'rs', 32)}, mn as (select id // 5 as id, k, avg(px) as px, avg(py) as py from rs group by all), {smooth_sql('mn', 'sm')} select id as group_id, k, round(px, 6) as x, round(py, 6) as y from sm")
def centerlines(spark, sf_dir):
    return flat(gen.centerlines(scaled(spark, sf_dir), ["group_id"]), "group_id")


@query(TRAJ + f", r as (select group_id, cls_id, track_id, row_number() over (partition by group_id, cls_id order by {draw_sql('track_id')}, track_id) as n from traj) select group_id::bigint as group_id, cls_id::bigint as cls_id, track_id from r where n <= 50")
def trajectory_sample(spark, sf_dir):
    held = assign.assign_per_group(points(spark, sf_dir), lanes(spark))
    return ranking.sampled(held, lane_op.LANE, "track_id", FIXTURE.max_trajectories).select(*longs("group_id", "cls_id"), "track_id")


WINDOWS = BY_CAMERA + f""",
lane5 as (select * from lane cross join (select 'cam' || unnest(range({CAMERAS})) as camera)),
timed as (select *, mean_time - min(first_time) over (partition by camera, group_id, cls_id) as t from ct),
ws as (select unnest(range(11)) as w),
held as (select * from timed join ws on w * 216000 <= t and t < w * 216000 + 432000),
win as (select camera, group_id, cls_id, w, coalesce(avg(speed), 0) as speed, coalesce(avg(curvature), 0) as curvature, coalesce(avg(lateral_offset), 0) as lateral_offset, count(track_id) as n_traj
  from (lane5 cross join ws) left join held using (camera, group_id, cls_id, w) group by all),
wd as (select *, n_traj / greatest(max(n_traj) over (partition by camera, group_id, cls_id), 1)::double as density, n_traj >= 2 as valid from win)"""


def _windows(spark, sf_dir):
    given, all_lanes = points(spark, sf_dir, CAMERAS), lanes(spark, CAMERAS)
    normal = lane_op.unnest_lanes(documents(spark, CAMERAS))
    trajs = lane_op.trajectories(lane_op.normalized(given), assign.assign_per_group(given, all_lanes), normal)
    return windows.window_stats(trajs, normal, FIXTURE)


@query(WINDOWS + f""",
d as (select *, lag(valid) over o as pv, sqrt((speed - lag(speed) over o) ** 2 + (curvature - lag(curvature) over o) ** 2 + (lateral_offset - lag(lateral_offset) over o) ** 2 + (density - lag(density) over o) ** 2) as change from wd window o as (partition by camera, group_id, cls_id order by w)),
m as (select camera, group_id, cls_id, avg(case when valid and coalesce(pv, false) then change else 0 end) as mean_delta, case when group_id = 1 and cls_id = 1 then 'Merge (rightmost)' when cls_id = 0 then 'Leftmost' else 'Rightmost' end as label from d group by all),
t as (select * from m order by round(mean_delta, 9) desc, camera, group_id, cls_id limit 30)
select {KEYS}, round(mean_delta, 6) as mean_delta, label || ' #' || row_number() over (partition by label order by round(mean_delta, 9) desc, camera, group_id, cls_id) as display from t""")
def unstable_lanes(spark, sf_dir):
    mean = windows.delta(_windows(spark, sf_dir)).groupBy(*lane_op.LANE).agg(F.avg("delta").alias("mean_delta"))
    label = lane_op.edge_label(F.col("cls_id").cast("double"), F.col("cls_id") == 0, F.col("cls_id") == 1, (F.col("group_id") == 1) & (F.col("cls_id") == 1))
    best = ranking.top(mean.withColumn("label", label), "mean_delta", lane_op.LANE)
    out = ranking.numbered_labels(best, "label", [F.round("mean_delta", 9).desc(), *lane_op.LANE])
    return out.select("camera", *longs("group_id", "cls_id"), *r6("mean_delta"), "display")


@query(WINDOWS + f" select {KEYS}, sum(valid::int)::bigint as n_valid, " + ", ".join(f"round(coalesce(avg({n}) filter (where valid), 0), 6) as {n}" for n in windows.STATS) + " from wd group by all")
def pooled_windows(spark, sf_dir):
    rows = _windows(spark, sf_dir).withColumn("e", windows.vector())
    out = ranking.pooled(rows, lane_op.LANE, F.col("valid"), "e")
    return out.select("camera", *longs("group_id", "cls_id", "n_valid"), *(F.round(F.col("mean")[k], 6).alias(n) for k, n in enumerate(windows.STATS)))


@query(f"""with {INDEX_SQL}, l as (select lane, 1 / (1 + exp(-4 * e[1])) as clean, case when has_successor then 'Merge' when is_left then 'Leftmost' when is_right then 'Rightmost' when rank between 0.35::double and 0.65::double then 'Middle' end as role from idx)
select role, arg_min(lane, struct_pack(v := round(clean, 9), l := lane)) as lane, round(min(clean), 6) as clean from l where role is not null group by role""")
def role_representatives(spark, sf_dir):
    rows = index(spark, sf_dir).withColumn("clean", v.sigmoid(4 * F.col("e")[0]))
    role = lane_op.edge_label(F.col("rank"), F.col("is_left"), F.col("is_right"), F.col("has_successor"))
    return ranking.lowest_by_role(rows, role, "clean", ["lane"]).select("role", "lane", *r6("clean"))


@query(f"with {INDEX_SQL} select lane, row_number() over (order by camera, grp, ordinal) - 1 as place from idx")
def lane_order(spark, sf_dir):
    return ranking.places(index(spark, sf_dir), ["camera", "grp", "ordinal"]).select("lane", *longs("place"))


@query(f"""with {INDEX_SQL}, p as (select *, row_number() over (partition by camera order by grp, ordinal) - 1 as place from idx)
select a.camera, a.place as i, b.place as j, a.lane as lane_i, b.lane as lane_j, round(list_dot_product(a.e, b.e), 6) as sim from p a join p b on a.camera = b.camera""")
def similarity_matrix(spark, sf_dir):
    return ranking.similarity_blocks(index(spark, sf_dir), ["grp", "ordinal"]).select("camera", *longs("i", "j"), "lane_i", "lane_j", *r6("sim"))


@query(f"with {INDEX_SQL} select a.camera as camera_i, b.camera as camera_j, round(avg(list_dot_product(a.e, b.e)), 6) as sim from idx a join idx b on a.camera < b.camera group by all")
def camera_similarity(spark, sf_dir):
    return ranking.camera_similarity(index(spark, sf_dir)).select("camera_i", "camera_j", *r6("sim"))


@query(f"""with recursive {INDEX_SQL},
g as (select camera, (lane + lane % 3) // 4 as grp, count(*) as n, {draw_sql("(lane + lane % 3) // 4")} as o from idx group by all),
s as (select *, o % greatest(ceil((select count(*) from g) / 1000), 1)::bigint as shard from g),
r as (select *, row_number() over (partition by shard order by o, camera, grp) as r from s),
walk(shard, r, batch, held) as (
  select shard, r, 0::bigint, n from r where r = 1
  union all
  select r.shard, r.r, case when held + n > 64 then batch + 1 else batch end, case when held + n > 64 then n else held + n end from walk join r on r.shard = walk.shard and r.r = walk.r + 1)
select camera, grp, shard, batch from walk join r using (shard, r)""")
def group_batches(spark, sf_dir):
    rows = index(spark, sf_dir).withColumn("grp", F.floor((F.col("lane") + F.col("lane") % 3) / 4))  # groups of three to five lanes
    return ranking.group_batches(rows, ["camera", "grp"], 64).select("camera", "grp", *longs("shard", "batch"))


@query("select vec_id, k, case when k <= vec_id % 6 then round(embedding[k]::double, 6) else 0 end as x, k <= vec_id % 6 as real from embeddings cross join (select unnest(range(1, 7)) as k)")
def padded_items(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (F.col("vec_id") % 6).cast("int")).alias("items"))
    out = ranking.padded(rows, "vec_id", "items", F.lit(0.0), 6)
    return out.select("vec_id", F.posexplode(F.arrays_zip("items", "mask")).alias("k", "z")).select("vec_id", (F.col("k") + 1).cast("long").alias("k"), F.round("z.items", 6).alias("x"), F.col("z.mask").alias("real"))


ORACLE = PSEUDO + """,
f as (select substr(camera, 4)::bigint * 4 + group_id * 2 + cls_id as lane, camera,
  [speed, curvature, lateral_offset, density, cls_id::double, (cls_id = 0)::int::double, (cls_id = 1)::int::double, (group_id = 1 and cls_id = 1)::int::double, 1::double] as f from ps),
e as (select lane, camera, list_transform(f, lambda x: x / (sqrt(list_dot_product(f, f)) + 1e-8)) as e from f)"""


def _oracle(spark, sf_dir):
    rows = _pseudo(spark, sf_dir).withColumn("lane", F.regexp_extract("camera", "[0-9]+", 0).cast("long") * 4 + F.col("group_id") * 2 + F.col("cls_id"))
    role = [F.col("cls_id"), F.col("cls_id") == 0, F.col("cls_id") == 1, (F.col("group_id") == 1) & (F.col("cls_id") == 1), F.lit(1.0)]
    return ranking.oracle_features(rows, list(windows.STATS), role).select("lane", "camera", F.col("features").alias("e"))


@query(ORACLE + " select lane, unnest(range(9)) as k, round(unnest(e), 6) as x from e")
def stats_oracle(spark, sf_dir):
    return _oracle(spark, sf_dir).select("lane", F.posexplode("e").alias("k", "x")).select("lane", *longs("k"), *r6("x"))


@query(ORACLE + ", s as (select a.lane as query, b.lane as ref, list_dot_product(a.e, b.e) as sim from e a join e b on a.camera <> b.camera) select query, ref, round(sim, 6) as sim from s qualify row_number() over (partition by query order by round(sim, 9) desc, ref) = 1")
def stats_oracle_loco(spark, sf_dir):
    rows = _oracle(spark, sf_dir)
    return match.nearest(rows, rows).select("query", "ref", *r6("sim"))


@query(f"with {INDEX_SQL} select lane, round((rank - 0.5::double) ** 2 + (group_size - 1) ** 2, 6) as distance from idx")
def behavior_prefix(spark, sf_dir):
    mask, wanted = spec.LaneSpec.from_behavior(speed=0.5, count=1.0).prefix()
    values = F.array(F.col("rank"), F.col("has_successor").cast("double"), F.col("rank") * 2, F.col("group_size"))
    return index(spark, sf_dir).select("lane", F.round(spec.prefix_distance(values, mask, wanted), 6).alias("distance"))


@query(f"with {INDEX_SQL}, c as (select k, avg(x) as x from (select unnest(e) as x, unnest(range(len(e))) as k from idx where is_right) group by k) select k, round(x, 6) as x from c")
def spec_replace(spark, sf_dir):
    wanted = spec.LaneSpec.replace_role(3, "rightmost")
    return gen.resolve(index(spark, sf_dir), wanted).select(F.posexplode("e").alias("k", "x")).select(*longs("k"), *r6("x"))


@query(f"with {INDEX_SQL} select lane, 1 / (1 + exp(-4 * e[1])) > 0.5 as anomaly, 1 / (1 + exp(-4 * e[1])) > 0.55::double as youden from idx")
def anomaly_decision(spark, sf_dir):
    logit = 4 * F.col("e")[0]
    return index(spark, sf_dir).select("lane", spec.decision(logit).alias("anomaly"), spec.decision(logit, 0.55).alias("youden"))


@query(f"with {INDEX_SQL}, s as (select label::bigint as size, avg(e[1]) as f1, avg(e[2]) as clean, avg(e[3]) as injected from idx group by label) select arg_min(size, struct_pack(s := -round(f1, 9), z := size)) as size, round(max(f1), 6) as f1, round(arg_min(injected - clean, struct_pack(s := -round(f1, 9), z := size)), 6) as gap from s")
def best_window(spark, sf_dir):
    rows = index(spark, sf_dir).groupBy(F.col("label").cast("long").alias("size")).agg(*(F.avg(F.col("e")[k]).alias(n) for k, n in enumerate(("f1", "clean", "injected"))))
    return metrics.best_window(rows).select("size", *r6("f1", "gap"))


@query(f"with {INDEX_SQL} select grp, arg_min(ordinal, struct_pack(s := -round(e[1], 9), o := ordinal)) as candidate from idx group by grp")
def best_candidate(spark, sf_dir):
    rows = index(spark, sf_dir).select("grp", F.col("ordinal").alias("candidate"), F.col("e")[0].alias("score"))
    return gen.best_candidate(rows, ["grp"])


@query("select vec_id, k, round(case when k < 4 then cos((vec_id % 1000) * exp(-ln(10000) * k / 4)) else sin((vec_id % 1000) * exp(-ln(10000) * (k - 4) / 4)) end, 6) as x from embeddings cross join (select unnest(range(8)) as k)")
def step_embedding(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.sinusoidal((F.col("vec_id") % 1000).cast("double"), 8).alias("e"))
    return rows.select("vec_id", F.posexplode("e").alias("k", "x")).select("vec_id", *longs("k"), *r6("x"))


@query(KNN.replace("place <= 3", "place <= 5") + f""", m as (select a.camera, a.lane, avg(list_dot_product(a.e, b.e)) as mean_sim from idx a join idx b on a.camera <> b.camera group by all),
q as (select camera, lane from m qualify row_number() over (partition by camera order by round(mean_sim, 9) desc, lane) = 1 order by camera limit 6)
select query, ref, round(sim, 6) as sim, place from knn join q on q.lane = knn.query""")
def diverse_topk(spark, sf_dir):
    rows = index(spark, sf_dir)
    chosen = match.cross_camera_queries(rows).select("lane")  # one of each of the first six cameras
    return match.nearest(rows.join(F.broadcast(chosen), "lane", "left_semi"), rows, 5).select("query", "ref", *r6("sim"), *longs("place"))


def _shaken(copies: int, noise: str, tag: int) -> str:
    return f"(2 * ({draw_sql(f'id * {copies} + copy', str(tag), 'k')} / {float(ranking.MODULUS)}::double) - 1) * {noise}::double"


AUGMENTED = f"""with {SP},
a as (select *, (2 * ({draw_sql("id * 3 + copy", "1")} / {float(ranking.MODULUS)}::double) - 1) * 0.26::double as a from sp cross join (select unnest(range(1, 4)) as copy)),
s as (select id as vec_id, copy, k, px * cos(a) - py * sin(a) + {_shaken(3, "0.005", 2)} as x, px * sin(a) + py * cos(a) + {_shaken(3, "0.005", 3)} as y,
  {draw_sql("id * 3 + copy", "4", "k")} / {float(ranking.MODULUS)}::double as u from a)"""


@query(AUGMENTED + " select vec_id, copy, k, round(x, 6) as x, round(y, 6) as y from s")
def augment(spark, sf_dir):
    return flat(gen.augment(scaled(spark, sf_dir).select("vec_id", "line"), "vec_id", 3), "vec_id", "copy").withColumn("copy", F.col("copy").cast("long"))


@query(AUGMENTED + " select vec_id, copy, row_number() over (partition by vec_id, copy order by k) - 1 as k, round(x, 6) as x, round(y, 6) as y from s where k in (0, 7) or u < 0.7::double")
def augment_thinned(spark, sf_dir):
    return flat(gen.augment(scaled(spark, sf_dir).select("vec_id", "line"), "vec_id", 3, keep=0.7), "vec_id", "copy").withColumn("copy", F.col("copy").cast("long"))


_UNIT = {n: f"({draw_sql('vec_id * 10 + copy', str(n))} / {float(ranking.MODULUS)}::double)" for n in range(1, 5)}


def _moved(tag: int, px: str, py: str) -> str:
    x, y = (f"(2 * ({draw_sql('vec_id * 10 + copy', str(t), 'k')} / {float(ranking.MODULUS)}::double) - 1) * 0.01::double" for t in (tag, tag + 1))
    return f"round(({px} * cos(angle) - {py} * sin(angle)) * stretch + {x}, 6), round({px} * sin(angle) + {py} * cos(angle) + shift + {y}, 6)"


@query(f"""with {SP},
c as (select id as vec_id, copy, (2 * {_UNIT[1].replace("vec_id", "id")} - 1) * radians(15) as angle, (2 * {_UNIT[2].replace("vec_id", "id")} - 1) * 0.02::double as shift, 0.9::double + {_UNIT[3].replace("vec_id", "id")} * (1.1::double - 0.9::double) as stretch, {_UNIT[4].replace("vec_id", "id")} >= 0.3::double as has_relation
  from (select distinct id from sp) cross join (select unnest(range(10)) as copy)),
j as (select c.*, sp.k, sp.px, sp.py, nb.px as nx, nb.py as ny from c join sp on sp.id = c.vec_id join sp nb on nb.grp = sp.grp and nb.lane = (sp.lane + 1) % 5 and nb.k = sp.k),
m as (select *, [{_moved(5, "px", "py")}] as t, [{_moved(7, "nx", "ny")}] as n from j)
select vec_id, copy, k, has_relation, t[1] as tx, t[2] as ty, case when has_relation then n[1] else 0 end as nx, case when has_relation then n[2] else 0 end as ny, case when has_relation then 0.5 else 0 end::double as merge_point from m""")
def augment_pairs(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    beside = rows.select("group_id", ((F.col("cls_id") + 4) % 5).alias("cls_id"), F.col("line").alias("neighbour_line"))
    pairs = rows.join(beside, ["group_id", "cls_id"]).select("vec_id", F.col("line").alias("target_line"), "neighbour_line", F.lit(0.5).alias("merge_point"), F.lit(0.1).alias("offset"))
    out = gen.augment_pairs(pairs, "vec_id")
    out = out.select("vec_id", "copy", "has_relation", "merge_point", F.posexplode(F.arrays_zip("target_line", "neighbour_line")).alias("k", "z"))
    return out.select("vec_id", *longs("copy", "k"), "has_relation", F.round("z.target_line.x", 6).alias("tx"), F.round("z.target_line.y", 6).alias("ty"), F.round("z.neighbour_line.x", 6).alias("nx"), F.round("z.neighbour_line.y", 6).alias("ny"), "merge_point")


CANON = f"""{FRAME},
cn as (select sp.grp, lane, k, ((px - cx) * cos(-a) - (py - cy) * sin(-a)) / s as x, ((px - cx) * sin(-a) + (py - cy) * cos(-a)) / s as y from sp join fr using (id))"""


def _clipped(x: str, y: str) -> str:
    return f"least(greatest({x}, 0), 1) as px, least(greatest({y}, 0), 1) as py"


def _back(frame: str = "fr") -> tuple[str, str]:
    return f"(x * cos({frame}.a) - y * sin({frame}.a)) * {frame}.s + {frame}.cx", f"(x * sin({frame}.a) + y * cos({frame}.a)) * {frame}.s + {frame}.cy"


def _candidates(spark, sf_dir):
    """Each group's lanes' shapes, in canonical form, as its candidates."""
    return scaled(spark, sf_dir).select("camera", "group_id", F.col("cls_id").alias("candidate"), g.to_canonical(F.col("line"))["canon"].alias("canon"))


EVEN = """
hd as (select id, k, atan2(lead(py) over w - py, lead(px) over w - px) as h from sm window w as (partition by id order by k)),
tn as (select id, abs(h - lag(h) over (partition by id order by k)) as d from hd where h is not null),
ev as (select id, 1 / (1 + var_pop(d)) as even from tn where d is not null group by id)"""
NEAR = """
dd as (select l.id, l.k as ka, an.k as kb, sqrt((l.px - an.px) ** 2 + (l.py - an.py) ** 2) as d from sm l join an on an.grp = l.id // 5),
ch as (select id, (select avg(m) from (select min(d) as m from dd e where e.id = c.id group by ka)) / 2 + (select avg(m) from (select min(d) as m from dd e where e.id = c.id group by kb)) / 2 as d from (select distinct id from dd) c),
sc as (select id, 0.7::double * (1 - d / (max(d) over (partition by id // 5) + 1e-8)) + 0.3::double * even as score from ch join ev using (id))
select id // 5 as group_id, id % 5 as candidate, round(score, 6) as score, row_number() over (partition by id // 5 order by round(score, 9) desc, id) = 1 as best from sc"""


@query(f"""with {SP}, {CANON},
raw as (select cn.grp * 5 + cn.lane as id, k, {_clipped(*_back())} from cn join fr on fr.id = cn.grp * 5),
{smooth_sql("raw", "sm")}, an as (select grp, k, px, py from sp where lane = 0), {EVEN}, {NEAR}""")
def directed_trajectory(spark, sf_dir):
    anchors = scaled(spark, sf_dir).where("cls_id = 0").select("camera", "group_id", "line")
    out = directed.at_trajectory(_candidates(spark, sf_dir), anchors, None)
    return out.select("group_id", "candidate", *r6("score"), "best")


@query(f"""with {SP}, {CANON},
raw as (select cn.grp * 5 + cn.lane as id, k, {_clipped(*_back())} from cn join fr on fr.id = cn.grp * 5 + 1),
{smooth_sql("raw", "s0")}, an as (select grp, k, px, py from sp where lane = 0),
sm as (select s0.id, k, 0.6::double * an.px + 0.4::double * s0.px as px, 0.6::double * an.py + 0.4::double * s0.py as py from s0 join an using (k) where an.grp = s0.id // 5), {EVEN}, {NEAR}""")
def directed_beside(spark, sf_dir):
    lines = scaled(spark, sf_dir).select("camera", "group_id", "cls_id", "line")
    out = directed.beside_trajectory(_candidates(spark, sf_dir), lines.where("cls_id = 0").drop("cls_id"), lines.where("cls_id = 1").drop("cls_id"), None)
    return out.select("group_id", "candidate", *r6("score"), "best")


CROSS = """
ng as (select id, k, px, py, lead(px) over w as nx, lead(py) over w as ny from sm window w as (partition by id order by k)),
xs as (select distinct a.id from ng a join ng b on a.id = b.id and b.k >= a.k + 2 and a.nx is not null and b.nx is not null
  where ((a.nx - a.px) * (b.py - a.py) - (a.ny - a.py) * (b.px - a.px)) * ((a.nx - a.px) * (b.ny - a.py) - (a.ny - a.py) * (b.nx - a.px)) < 0
    and ((b.nx - b.px) * (a.py - b.py) - (b.ny - b.py) * (a.px - b.px)) * ((b.nx - b.px) * (a.ny - b.py) - (b.ny - b.py) * (a.nx - b.px)) < 0),
en as (select id, sum(step) as len from (select id, coalesce(sqrt((px - lag(px) over w) ** 2 + (py - lag(py) over w) ** 2), 0) as step from sm window w as (partition by id order by k)) group by id),
so as (select id, case when len < 1e-8 or xs.id is not null then 0 else even end as smooth from en join ev using (id) left join xs using (id))"""
CHOSEN = "select id // 5 as group_id, id % 5 as candidate, round(score, 6) as score, row_number() over (partition by id // 5 order by round(score, 9) desc, id) = 1 as best from sc"


@query(f"""with {SP}, {CANON},
raw as (select cn.grp * 5 + cn.lane as id, k, {_clipped(*(b.replace("fr.cx", "0.5::double").replace("fr.cy", "0.5::double") for b in _back()))} from cn join fr on fr.id = cn.grp * 5 + 2),
{smooth_sql("raw", "sm")}, {EVEN}, {CROSS}, sc as (select id, 0.4::double * smooth + 0.6::double * 0.5::double as score from so) {CHOSEN}""")
def directed_reference(spark, sf_dir):
    given = scaled(spark, sf_dir).where("cls_id = 2").select("camera", "group_id", "line", g.point(F.lit(0.5), F.lit(0.5)).alias("centroid"))
    return directed.from_reference(_candidates(spark, sf_dir), given).select("group_id", "candidate", *r6("score"), "best")


RIGHTMOST = CONTEXT + f""", {CANON.lstrip()},
ca as (select lt.grp, lane, curve, heading, spacing, -ty * side as qx, tx * side as qy from lt join cu using (id) join ga using (grp) join ex using (grp) where abs(lat - hi) <= spacing),
an as (select grp, arg_min(lane, struct_pack(c := curve, l := lane)) as anchor, any_value(spacing) as spacing, any_value(heading) as heading, any_value(qx) as qx, any_value(qy) as qy from ca group by grp),"""
ALIGNED = f"""{{smooth}}, {EVEN}, {CROSS},
al as (select id, atan2(max_by(py, k) - min_by(py, k), max_by(px, k) - min_by(px, k)) - heading as d from sm join an on an.grp = sm.id // 5 group by id, heading),
sc as (select id, 0.4::double * smooth + 0.6::double * greatest(0, 1 - least(least(abs(d), 2 * pi() - abs(d)), least(abs(d + pi()), 2 * pi() - abs(d + pi()))) / (pi() / 2)) as score from so join al using (id)) {CHOSEN}"""


@query(RIGHTMOST + f""" raw as (select cn.grp * 5 + cn.lane as id, k, {_clipped(*(f"{b} + {q} * spacing * 1.5::double" for b, q in zip(_back(), ("qx", "qy"), strict=True)))} from cn join an using (grp) join fr on fr.id = cn.grp * 5 + an.anchor),
{ALIGNED.format(smooth=smooth_sql("raw", "sm"))}""")
def directed_rightmost(spark, sf_dir):
    context = right_context(spark, sf_dir)
    return directed.from_specification(_candidates(spark, sf_dir), context, "rightmost").select("group_id", "candidate", *r6("score"), "best")


@query(RIGHTMOST + f""" raw as (select cn.grp * 5 + cn.lane as id, k, {_clipped(*_back())} from cn join an using (grp) join fr on fr.id = cn.grp * 5 + an.anchor),
{ALIGNED.format(smooth=smooth_sql("raw", "sm"))}""")
def directed_relational(spark, sf_dir):
    context = right_context(spark, sf_dir)  # the neighbour is the anchor itself
    return directed.relational(_candidates(spark, sf_dir), context, "rightmost").select("group_id", "candidate", *r6("score"), "best")


@query(RIGHTMOST + """ c as (select an.grp, k, x, y, spacing, fr.s from an join cn on cn.grp = an.grp and cn.lane = an.anchor join fr on fr.id = an.grp * 5 + an.anchor)
select grp as group_id, k, round(x, 6) as x, round(y + spacing / s, 6) as y from c""")
def directed_warm_start(spark, sf_dir):
    context = right_context(spark, sf_dir)
    return flat(directed.warm_start(context).withColumnRenamed("start", "line"), "group_id")


@query(KNN.replace("a.camera <> b.camera)", "a.lane <> b.lane and a.lane % 3 = 0 and b.lane % 4 <> 0)") + " select query, ref, round(sim, 6) as sim, place from knn")
def retrieve_excluding(spark, sf_dir):
    rows = index(spark, sf_dir)
    out = match.retrieve(rows, rows.where("lane % 3 = 0"), 3, cross_camera=False, excluded=rows.where("lane % 4 = 0"))
    return out.select("query", "ref", *r6("sim"), *longs("place"))


@query("select event_id, round((event_id % 100000) / 25::double, 6) as time, round(x, 6) as x, round(y, 6) as y from (select event_id, (props->>'k')::double * 19.2::double as x, 135::double + 270 * (user_id % 4) + value - 40 as y from events)")
def pixel_roundtrip(spark, sf_dir):
    from ..sources import files

    rows = lane_op.pixels(lane_op.normalized(points(spark, sf_dir).withColumn("frame_num", F.col("event_id") % 100000)))
    return files.frame_seconds(rows, 25).select("event_id", *r6("time", "x", "y"))


def _bce_sql(x: str, y: str, weight: str = "1") -> str:
    return f"((1 - {y}) * {x} + (1 + ({weight} - 1) * {y}) * (ln(1 + exp(-abs({x}))) + greatest(-{x}, 0)))"


@query(f"""with {INDEX_SQL}, lanes as (select *, lane // 500 as batch, 2 * e[1] as pr, 3 * e[2] as pl, 3 * e[3] as pt, 2 * e[4] as ps from idx),
s as (select a.batch, a.lane, list_dot_product(a.e, b.e) as sim,
    a.is_left = b.is_left and a.is_right = b.is_right and a.camera <> b.camera and round(abs(a.rank - b.rank), 9) <= 0.15::double
    and round(list_dot_product(a.role, b.role) / ((sqrt(list_dot_product(a.role, a.role)) + 1e-8) * (sqrt(list_dot_product(b.role, b.role)) + 1e-8)), 9) >= 0.8::double as pos
  from lanes a join lanes b on a.batch = b.batch and a.lane <> b.lane),
l as (select batch, lane, ln(sum(exp(sim / 0.07::double))) - ln(sum(exp(sim / 0.07::double)) filter (where pos)) as loss from s group by all),
c as (select batch, coalesce(avg(loss), 0) as contrastive from l group by batch),
m as (select batch, sum(pos::int)::bigint // 2 as n_pos, coalesce(avg(sim) filter (where pos), 0) as mean_pos, coalesce(avg(sim) filter (where not pos), 0) as mean_neg from s group by batch),
r as (select batch, avg({_bce_sql("pr", "rank")}) + (avg({_bce_sql("pl", "is_left::int", "3")}) + avg({_bce_sql("pt", "is_right::int", "3")})) / 2 + 0.5::double * avg({_bce_sql("ps", "group_size")}) as role from lanes group by batch)
select batch, round(contrastive, 6) as contrastive, round(role, 6) as role, round(contrastive + role, 6) as total, n_pos, round(mean_pos, 6) as mean_pos, round(mean_neg, 6) as mean_neg from r join c using (batch) join m using (batch)""")
def training_loss(spark, sf_dir):
    e = F.col("e")
    rows = index(spark, sf_dir).withColumns({"pred_rank": 2 * e[0], "pred_left": 3 * e[1], "pred_right": 3 * e[2], "pred_size": 2 * e[3]})
    return match.training_loss(rows, epoch=50, epochs=100).select(*longs("batch"), *r6("contrastive", "role", "total"), "n_pos", *r6("mean_pos", "mean_neg"))

"""Queries of matching, losses and metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import lanes as lane_op
from ..operators import match as op
from ..operators import metrics
from .fixtures import INDEX_SQL, SHAPE_POINTS_SQL, index, r6, shapes, table
from .lane_queries import STATS, _trajectories, longs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {INDEX_SQL} select a.lane as i, b.lane as j from idx a join idx b on a.is_left = b.is_left and a.is_right = b.is_right and a.lane < b.lane and a.camera <> b.camera
where round(abs(a.rank - b.rank), 9) <= 0.15::double and round(list_dot_product(a.role, b.role) / ((sqrt(list_dot_product(a.role, a.role)) + 1e-8) * (sqrt(list_dot_product(b.role, b.role)) + 1e-8)), 9) >= 0.8::double""")
def positive_pairs(spark, sf_dir):
    return op.positive_pairs(index(spark, sf_dir))


KNN = f"""with {INDEX_SQL},
sims as (select a.lane as query, a.camera, b.lane as ref, list_dot_product(a.e, b.e) as sim from idx a join idx b on a.camera <> b.camera),
knn as (select *, row_number() over (partition by query order by round(sim, 9) desc, ref) as place from sims qualify place <= 3),
loco as (select k.*, q.rank as q_rank, r.rank as m_rank, q.is_left as ql, r.is_left as ml, q.is_right as qr, r.is_right as mr, q.has_successor as qs, r.has_successor as ms, q.role as q_role, r.role as m_role
  from knn k join idx q on q.lane = k.query join idx r on r.lane = k.ref where place = 1),
f as (select camera, avg(sim) as mean_match_sim, avg(abs(q_rank - m_rank)) as mean_lat_rank_diff,
  (coalesce(2 * sum((ml and ql)::int) / nullif(2 * sum((ml and ql)::int) + sum((ml <> ql)::int), 0)::double, 0) + coalesce(2 * sum((mr and qr)::int) / nullif(2 * sum((mr and qr)::int) + sum((mr <> qr)::int), 0)::double, 0)) / 2 as edge_f1,
  avg((ml = ql and mr = qr)::int::double) as edge_accuracy, avg((ms = qs)::int::double) as successor_accuracy,
  avg(list_dot_product(q_role, m_role) / ((sqrt(list_dot_product(q_role, q_role)) + 1e-8) * (sqrt(list_dot_product(m_role, m_role)) + 1e-8))) as mean_role_similarity, count(*) as n_query from loco group by camera)"""
NAMES = ["mean_match_sim", "mean_lat_rank_diff", "edge_f1", "edge_accuracy", "successor_accuracy", "mean_role_similarity"]


def _matches(spark, sf_dir, k=1):
    rows = index(spark, sf_dir)
    return rows, op.nearest(rows, rows, k)


@query(KNN + " select query, ref, round(sim, 6) as sim from loco")
def loco_match(spark, sf_dir):
    return _matches(spark, sf_dir)[1].select("query", "ref", *r6("sim"))


@query(KNN + " select query, ref, round(sim, 6) as sim, place from knn")
def knn_topk(spark, sf_dir):
    return _matches(spark, sf_dir, 3)[1].select("query", "ref", *r6("sim"), *longs("place"))


@query(KNN + " select camera, " + ", ".join(f"round({n}, 6) as {n}" for n in NAMES) + ", n_query from f")
def loco_metrics(spark, sf_dir):
    rows, found = _matches(spark, sf_dir)
    return op.loco_metrics(op.with_roles(found, rows)).select("camera", *r6(*NAMES), "n_query")


@query(KNN + " " + " union all ".join(f"select '{n}' as metric, round(avg({n}), 6) as mean, round(stddev_pop({n}), 6) as std from f" for n in NAMES))
def loco_macro(spark, sf_dir):
    rows, found = _matches(spark, sf_dir)
    return op.macro(op.loco_metrics(op.with_roles(found, rows)), NAMES).select("metric", *r6("mean", "std"))


@query(KNN + " select round(avg(abs(q_rank - m_rank)), 6) as mae, count(*) as n from loco")
def rank_mae(spark, sf_dir):
    rows, found = _matches(spark, sf_dir)
    return metrics.rank_mae(op.with_roles(found, rows)).select(*r6("mae"), "n")


@query(f"""with {INDEX_SQL},
c as (select k, avg(x) as x from (select unnest(e) as x, unnest(range(1, len(e) + 1)) as k from idx where is_left and abs(rank - 0) < 0.2::double) group by k),
q as (select list(x order by k) as q from c),
s as (select lane as ref, list_dot_product(e, q) / greatest(sqrt(list_dot_product(q, q)), 1e-8) as sim from idx cross join q)
select ref, round(sim, 6) as sim, row_number() over (order by round(sim, 9) desc, ref) as place from s qualify place <= 3""")
def role_retrieve(spark, sf_dir):
    return op.retrieve_by_role(index(spark, sf_dir), op.role_filter(left=True, rank=0.0)).select("ref", *r6("sim"), *longs("place"))


@query(KNN + f""", {SHAPE_POINTS_SQL},
w as (select *, case when sum(greatest(sim, 0)) over q < 1e-8 then 1 / count(*) over q::double else greatest(sim, 0) / sum(greatest(sim, 0)) over q end as w from knn window q as (partition by query))
select query, k, round(sum(w * px), 6) as x, round(sum(w * py), 6) as y from w join pts on pts.vec_id = w.ref group by query, k""")
def weighted_interp(spark, sf_dir):
    _, found = _matches(spark, sf_dir, 3)
    geometry = shapes(spark, sf_dir).select(F.col("vec_id").alias("ref"), F.posexplode("line").alias("k", "p")).select("ref", F.col("k").cast("long"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return op.interpolate(found, geometry).select("query", "k", *r6("x", "y"))


@query(f"""with {INDEX_SQL},
s as (select greatest(stddev_pop(rank), 1e-8) as sr, greatest(stddev_pop(has_successor::int), 1e-8) as ss from idx),
w as (select e, exp(-(((rank - 0.8::double) / sr) ** 2 + ((has_successor::int - 1) / ss) ** 2) / 2) as w from idx cross join s),
u as (select unnest(e) as x, unnest(range(len(e))) as k, w from w)
select k, round(sum(w * x) / sum(w), 6) as x from u group by k""")
def behavior_weighted(spark, sf_dir):
    rows = index(spark, sf_dir).withColumn("succ", F.col("has_successor").cast("double"))
    out = op.behaviour_weighted(rows, {"rank": 0.8, "succ": 1.0})
    return out.select(F.posexplode("e").alias("k", "x")).select(*longs("k"), *r6("x"))


@query(f"""with {INDEX_SQL},
p as (select case when a.camera = b.camera and a.grp = b.grp then 'same group' when a.camera = b.camera then 'same camera' when round(abs(a.rank - b.rank), 9) < 0.15::double then 'same rank' else 'other' end as kind, list_dot_product(a.e, b.e) as sim
  from idx a join idx b on a.lane < b.lane)
select kind, count(*) as n, round(quantile_cont(sim, 0.25), 6) as q1, round(median(sim), 6) as median, round(quantile_cont(sim, 0.75), 6) as q3, round(avg(sim), 6) as mean from p group by kind""")
def pair_type_stats(spark, sf_dir):
    return op.pair_type_stats(index(spark, sf_dir)).select("kind", "n", *r6("q1", "median", "q3", "mean"))


@query(STATS + """ select a.group_id::bigint as group_id, a.cls_id::bigint as i, b.cls_id::bigint as j, round(a.lateral_offset - b.lateral_offset, 6) as lateral_diff, round(a.speed - b.speed, 6) as speed_diff,
  round(least(greatest(a.density / (b.density + 1e-6), -10), 10), 6) as density_ratio from dense a join dense b on a.group_id = b.group_id""")
def relative_features(spark, sf_dir):
    _, normal, trajs = _trajectories(spark, sf_dir)
    out = op.relative_features(lane_op.traj_stats(trajs, normal), ["camera", "group_id"], "cls_id")
    return out.select(*longs("group_id", "i", "j"), *r6("lateral_diff", "speed_diff", "density_ratio"))


@query("""with g as (select vec_id // 5 as group_id, vec_id // 50 as cam, atan2(sum(embedding[2]::double), sum(embedding[1]::double)) as h from embeddings group by all),
q as (select vec_id as query, vec_id // 50 as cam, atan2(embedding[4]::double, embedding[3]::double) as h from embeddings),
claimed as (select cam, min(group_id) as group_id from g group by cam),
m as (select query, group_id, greatest(cos(q.h - g.h), cos(q.h - g.h + pi())) as score from q join g on q.cam = g.cam where not exists (select 1 from claimed where claimed.cam = g.cam and claimed.group_id = g.group_id))
select query, arg_min(group_id, struct_pack(s := -round(score, 9), g := group_id)) as group_id, round(max(score), 6) as score from m group by query""")
def heading_match(spark, sf_dir):
    asked, groups = _headings(spark, sf_dir)
    claimed = groups.groupBy("camera").agg(F.min("group_id").alias("group_id"))  # each camera's first group has its lanes already
    return op.heading_match(asked, groups, claimed).select("query", "group_id", *r6("score"))


def _headings(spark, sf_dir):
    """Headings asked and those of all groups."""
    e = table(spark, sf_dir, "embeddings").withColumn("camera", F.floor(F.col("vec_id") / 50).cast("string"))
    x, y = (F.sum(F.col("embedding")[k].cast("double")) for k in (0, 1))
    groups = e.groupBy("camera", F.floor(F.col("vec_id") / 5).alias("group_id")).agg(F.atan2(y, x).alias("group_heading"))
    return e.select("camera", F.col("vec_id").alias("query"), F.atan2(F.col("embedding")[3].cast("double"), F.col("embedding")[2].cast("double")).alias("heading")), groups


@query("""with g as (select vec_id // 5 as group_id, vec_id // 50 as cam, atan2(sum(embedding[2]::double), sum(embedding[1]::double)) as h from embeddings group by all),
q as (select vec_id as query, vec_id // 50 as cam, atan2(embedding[4]::double, embedding[3]::double) as h from embeddings),
m as (select query, group_id, greatest(cos(q.h - g.h), cos(q.h - g.h + pi())) as score from q join g on q.cam = g.cam)
select query, arg_min(group_id, struct_pack(s := -round(score, 9), g := group_id)) as group_id, round(max(score), 6) as score from m group by query""")
def heading_match_all(spark, sf_dir):
    return op.heading_match(*_headings(spark, sf_dir)).select("query", "group_id", *r6("score"))


@query(f"""with {INDEX_SQL}, s as (select a.camera, a.lane, avg(list_dot_product(a.e, b.e)) as mean_sim from idx a join idx b on a.camera <> b.camera group by all),
r as (select *, row_number() over (partition by camera order by round(mean_sim, 9) desc, lane) as rn from s)
select camera, lane, round(mean_sim, 6) as mean_sim from r where rn = 1 order by camera limit 6""")
def diverse_queries(spark, sf_dir):
    return op.cross_camera_queries(index(spark, sf_dir)).select("camera", "lane", *r6("mean_sim"))


INFONCE = """with {index}, lanes as (select *, lane // {size} as batch from idx),
s as (select a.lane, a.batch, b.lane as other, list_dot_product(a.e, b.e) / 0.07::double as s,
    a.is_left = b.is_left and a.is_right = b.is_right and a.camera <> b.camera and round(abs(a.rank - b.rank), 9) <= 0.15::double
    and round(list_dot_product(a.role, b.role) / ((sqrt(list_dot_product(a.role, a.role)) + 1e-8) * (sqrt(list_dot_product(b.role, b.role)) + 1e-8)), 9) >= 0.8::double as pos
  from lanes a left join lanes b on a.batch = b.batch and a.lane <> b.lane),
m as (select *, max(s) over (partition by lane) as m from s),
l as (select lane, batch, round(ln(sum(exp(s - m))) - ln(sum(case when pos then exp(s - m) end)), 6) as loss, sum(coalesce(pos, false)::int)::bigint as n_pos from m group by lane, batch)"""


@query(INFONCE.format(index=INDEX_SQL, size=100) + " select lane, loss, n_pos from l where n_pos > 0")
def infonce(spark, sf_dir):
    return op.info_nce_batches(index(spark, sf_dir), 100).where("n_pos > 0").select("lane", *r6("loss"), *longs("n_pos"))


@query(INFONCE.format(index=INDEX_SQL, size=500) + " select lane, batch, loss, n_pos from l")
def infonce_batches(spark, sf_dir):
    return op.info_nce_batches(index(spark, sf_dir)).select("lane", *longs("batch"), *r6("loss"), *longs("n_pos"))


@query(f"""with {INDEX_SQL}, p as (select grp, lane, 1 / (1 + exp(-4 * e[1])) as p, count(*) over (partition by grp) as n from idx),
t as (select *, (row_number() over (partition by grp order by p, lane) - 1) / (n - 1)::double as t from p where n > 1) select grp, round(avg((p - t) ** 2), 6) as loss from t group by grp""")
def rank_consistency(spark, sf_dir):
    return op.rank_consistency(index(spark, sf_dir).select("grp", "lane", (4 * F.col("e")[0]).alias("pred"))).select("grp", *r6("loss"))


@query(f"""with {INDEX_SQL} select round(avg((1 - y) * x + (1 + 2 * y) * (ln(1 + exp(-abs(x))) + greatest(-x, 0))), 6) as edge_bce, count(*) as n from (select 4 * e[1] as x, is_left::int as y from idx)""")
def edge_bce(spark, sf_dir):
    loss = op.bce(4 * F.col("e")[0], F.col("is_left").cast("double"), 3.0)
    return index(spark, sf_dir).agg(F.round(F.avg(loss), 6).alias("edge_bce"), F.count("*").alias("n"))


SCORED = "r as (select n_chars::double as score, toxic = 1 as truth from labels join documents using (doc_id))"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("toxic") == 1).alias("truth"))


@query(f"with {SCORED}, c as (select sum((score > 2000 and truth)::int) as tp, sum((score > 2000 and not truth)::int) as fp, sum((score <= 2000 and truth)::int) as fn, sum((score <= 2000 and not truth)::int) as tn from r), d as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as p, coalesce(tp / nullif(tp + fn, 0)::double, 0) as q from c) select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(p, 6) as precision, round(q, 6) as recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) as f1 from d")
def confusion(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), F.col("score") > 2000, F.col("truth")).select(*longs("tp", "fp", "fn", "tn"), *r6("precision", "recall", "f1"))


@query(f"with {SCORED}, c as (select sum((score > 2000 and truth)::int) as tp, sum((score > 2000 and not truth)::int) as fp, sum((score <= 2000 and truth)::int) as fn from r), d as (select *, tp / (tp + fp + 1e-8) as p, tp / (tp + fn + 1e-8) as q from c) select round(p, 6) as precision, round(q, 6) as recall, round(2 * p * q / (p + q + 1e-8), 6) as f1 from d")
def confusion_eps(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), F.col("score") > 2000, F.col("truth"), 1e-8).select(*r6("precision", "recall", "f1"))


@query(f"""with {SCORED}, b as (select score, sum(truth::int) as p, sum((not truth)::int) as n from r group by score),
c as (select score, sum(p) over o / sum(p) over ()::double as tpr, sum(n) over o / sum(n) over ()::double as fpr from b window o as (order by score desc)),
d as (select *, (tpr + lag(tpr, 1, 0) over (order by score desc)) / 2 * (fpr - lag(fpr, 1, 0) over (order by score desc)) as h from c)
select round(sum(h), 6) as auc, round(max(tpr - fpr), 6) as best_j, arg_min(score, struct_pack(s := -round(tpr - fpr, 9), t := -score)) as youden from d""")
def roc_auc(spark, sf_dir):
    return metrics.auc(metrics.roc(_scored(spark, sf_dir))).select(*r6("auc", "best_j"), "youden")


@query("""with m as (select o_orderstatus as variant, month(o_orderdate) as epoch, avg(o_totalprice::double) as v from orders group by all),
h as (select variant, epoch, v / max(v) over () as value from m)
select variant, 'price' as metric, min(case when value >= 0.8::double then epoch end)::bigint as epochs_to_threshold, arg_min(epoch, struct_pack(s := -round(value, 9), e := epoch))::bigint as best_epoch, round(max(value), 6) as best_value, round(max_by(value, epoch), 6) as final_value from h group by variant""")
def history_summary(spark, sf_dir):
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("variant"), F.lit("price").alias("metric"), F.month("o_orderdate").alias("epoch"), F.col("o_totalprice").cast("double").alias("value"))
    h = metrics.epoch_means(o)
    h = h.withColumn("value", F.col("value") / F.max("value").over(Window.partitionBy("metric")))
    return metrics.history_summary(h).select("variant", "metric", *longs("epochs_to_threshold", "best_epoch"), *r6("best_value", "final_value"))


@query("select vec_id, vec_id // 50 = 3 as held_out from embeddings where vec_id // 50 = 3 union all select vec_id, false from embeddings where vec_id // 50 <> 3")
def train_split(spark, sf_dir):
    rows = index(spark, sf_dir)
    held = rows.where("camera = 'cam3'").select("lane")
    train = rows.join(held, "lane", "left_anti").select(F.col("lane").alias("vec_id"), F.lit(False).alias("held_out"))
    return train.unionByName(rows.join(held, "lane", "left_semi").select(F.col("lane").alias("vec_id"), F.lit(True).alias("held_out")))


@query("select vec_id, label::bigint as label, 'ref' as part from embeddings where vec_id % 5 <> 0 union all select vec_id, label::bigint, 'query' from embeddings where vec_id % 5 = 0")
def union_ref_query(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long"))
    return e.where("vec_id % 5 <> 0").withColumn("part", F.lit("ref")).unionByName(e.where("vec_id % 5 = 0").withColumn("part", F.lit("query")))


@query(f"with {INDEX_SQL} select lane, round(sqrt(list_dot_product(e, e)), 6) as norm from idx")
def unit_embeddings(spark, sf_dir):
    return index(spark, sf_dir).select("lane", F.round(v.norm(F.col("e")), 6).alias("norm"))

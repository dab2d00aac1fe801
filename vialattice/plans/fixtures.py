"""How the driver's tables play the part of tracks, lanes and embeddings, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, cameras: int = 1) -> DataFrame:
    """events as detections; a track is a user's three days."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    k = F.get_json_object("props", "$.k").cast("double")
    camera = F.lit("cam0") if cameras == 1 else F.concat(F.lit("cam"), (F.col("user_id") % cameras).cast("string"))
    return e.select(
        camera.alias("camera"),
        "event_id",
        (F.col("user_id") * 1000 + F.floor(day / 3)).alias("track_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("time"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long").alias("frame_num"),
        (k * F.lit(19.2)).alias("x"),
        (F.lit(135.0) + 270 * (F.col("user_id") % 4) + F.col("value") - 40).alias("y"),
        F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "view", 7).otherwise(0).alias("class"),
        ((k + 1) / 100).alias("conf"),
    )


def lane_rows(cameras: int = 1) -> list[tuple]:
    out = []
    for c in range(cameras):
        for group in range(2):
            for lane in range(2):
                y = 135.0 + 270 * (2 * group + lane)
                out.append((f"cam{c}", group, lane, [(0.0, y), (640.0, y + 10), (1280.0, y - 10), (1920.0, y)]))
    return out


def lanes(spark: SparkSession, cameras: int = 1) -> DataFrame:
    """Four lanes in two groups on each camera, inline, so that their size is known when plans are made."""

    def line(points: list[tuple]) -> str:
        return "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in points) + ")"

    rows = ", ".join(f"('{cam}', {gid}, {cls}, {line(points)})" for cam, gid, cls, points in lane_rows(cameras))
    return spark.sql(f"select * from values {rows} as t(camera, group_id, cls_id, waypoints)")


def relationships(spark: SparkSession, cameras: int = 1) -> DataFrame:
    rows = ", ".join(f"('cam{c}', 1, 'successor', 1, 0), ('cam{c}', 0, 'adjacent', 0, 1)" for c in range(cameras))
    return spark.sql(f"select * from values {rows} as t(camera, group_id, type, from_cls, to_cls)")


def documents(spark: SparkSession, cameras: int = 1) -> DataFrame:
    """The lanes as annotation documents, one a camera."""
    lane = F.struct("cls_id", "waypoints")
    groups = lanes(spark, cameras).groupBy("camera", "group_id").agg(F.array_sort(F.collect_list(lane)).alias("lanes"))
    linked = relationships(spark, cameras).groupBy("camera", "group_id").agg(F.collect_list(F.struct("type", "from_cls", "to_cls")).alias("relationships"))
    rows = groups.join(linked, ["camera", "group_id"], "left")
    return rows.groupBy("camera").agg(F.array_sort(F.collect_list(F.struct("group_id", "lanes", "relationships"))).alias("lane_groups"))


#: embeddings as annotated lanes of three to five waypoints, and their relationships.
ANNOTATED_SQL = """
annotated as (select vec_id, 'cam' || (vec_id // 50) as camera, vec_id // 5 as group_id, vec_id % 5 as cls_id, k, 480::double * k as wx, 100 + 150 * (vec_id % 5) + 40::double * embedding[k + 1]::double as wy
  from embeddings cross join (select unnest(range(5)) as k) where k < 3 + vec_id % 3),
related as (select 'cam' || (vec_id // 50) as camera, vec_id // 5 as group_id, case when vec_id % 7 = 0 then 'successor' else 'adjacent' end as type, vec_id % 5 as from_cls, (vec_id + 1) % 5 as to_cls from embeddings where vec_id % 7 = 0 or vec_id % 11 = 0)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as annotation documents, one a camera: five lanes to a group, some with a relationship."""
    n = F.col("vec_id")
    line = F.transform(F.sequence(F.lit(0), (2 + n % 3).cast("int")), lambda k: g.point(k * 480.0, 100 + 150 * (n % 5) + 40.0 * F.get("embedding", k).cast("double")))
    linked = F.struct(F.when(n % 7 == 0, "successor").otherwise("adjacent").alias("type"), (n % 5).alias("from_cls"), ((n + 1) % 5).alias("to_cls"))
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("cam"), F.floor(n / 50).cast("string")).alias("camera"), F.floor(n / 5).alias("group_id"), F.struct((n % 5).alias("cls_id"), line.alias("waypoints")).alias("lane"), F.when((n % 7 == 0) | (n % 11 == 0), linked).alias("linked"))
    groups = rows.groupBy("camera", "group_id").agg(F.array_sort(F.collect_list("lane")).alias("lanes"), F.collect_list("linked").alias("relationships"))
    return groups.groupBy("camera").agg(F.array_sort(F.collect_list(F.struct("group_id", "lanes", "relationships"))).alias("lane_groups"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as lanes: five to a group, ten groups to a camera."""
    e = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    o = n % 5
    return e.select(
        n.alias("lane"),
        F.concat(F.lit("cam"), F.floor(n / 50).cast("string")).alias("camera"),
        F.floor(n / 5).alias("grp"),
        o.alias("ordinal"),
        (o / F.lit(4.0)).alias("rank"),
        (o == 0).alias("is_left"),
        (o == 4).alias("is_right"),
        (n % 7 == 0).alias("has_successor"),
        F.lit(5.0 / 6).alias("group_size"),
        "label",
        v.normalize(v.doubles(F.col("embedding"))).alias("e"),
    ).withColumn("role", F.array("rank", F.col("is_left").cast("double"), F.col("is_right").cast("double"), F.col("has_successor").cast("double"), "group_size"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines of eight points from the first sixteen components of each embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    line = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: g.point(k + F.col("v")[2 * k], F.col("v")[2 * k + 1]))
    return e.select("vec_id", line.alias("line"))


POINTS_SQL = """
points as (select 'cam' || (user_id % 5) as camera5, event_id,
  user_id * 1000 + (datediff('day', date '2024-01-01', cast(ts as date)) // 3) as track_id,
  epoch_us(ts) / 1000000::double as time,
  (props->>'k')::double * 19.2::double as x,
  135::double + 270 * (user_id % 4) + value - 40 as y,
  case event_type when 'click' then 2 when 'purchase' then 5 when 'view' then 7 else 0 end as class,
  ((props->>'k')::double + 1) / 100 as conf
  from events)"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::double" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


SEGMENTS = [(gid, cls, k, *line[k], *line[k + 1]) for _, gid, cls, line in lane_rows() for k in range(3)]
SEGS_SQL = f"segs(group_id, cls_id, seg, ax, ay, bx, by2) as (values {_values(SEGMENTS)})"
WAYPOINTS_SQL = f"waypoints(group_id, cls_id, k, wx, wy) as (values {_values([(gid, cls, k, *p) for _, gid, cls, line in lane_rows() for k, p in enumerate(line)])})"


def distances_sql(points: str = "points", segs: str = "segs") -> str:
    """CTE dist(event_id, track_id, group_id, cls_id, d)."""
    return f"""
foot as (select p.event_id, p.track_id, p.x, p.y, s.*,
  least(greatest(((p.x - ax) * (bx - ax) + (p.y - ay) * (by2 - ay)) / greatest((bx - ax) * (bx - ax) + (by2 - ay) * (by2 - ay), 1e-12), 0), 1) as t
  from {points} p cross join {segs} s),
dist as (select event_id, track_id, group_id, cls_id, min(sqrt((x - (ax + t * (bx - ax))) ** 2 + (y - (ay + t * (by2 - ay))) ** 2)) as d
  from foot group by event_id, track_id, group_id, cls_id)"""


INDEX_SQL = """
idx as (select vec_id as lane, 'cam' || (vec_id // 50) as camera, vec_id // 5 as grp, vec_id % 5 as ordinal,
  (vec_id % 5) / 4::double as rank, vec_id % 5 = 0 as is_left, vec_id % 5 = 4 as is_right, vec_id % 7 = 0 as has_successor,
  5::double / 6 as group_size, label,
  list_transform(embedding::double[], lambda q: q / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-8)) as e,
  [(vec_id % 5) / 4::double, (vec_id % 5 = 0)::int::double, (vec_id % 5 = 4)::int::double, (vec_id % 7 = 0)::int::double, 5::double / 6] as role
  from embeddings)"""

SHAPE_POINTS_SQL = """
pts as (select vec_id, k, k + embedding[2 * k + 1]::double as px, embedding[2 * k + 2]::double as py
  from embeddings cross join (select unnest(range(8)) as k))"""


def r6(*names: str) -> list:
    """Columns rounded to six digits."""
    return [F.round(F.col(n), 6).alias(n) for n in names]

"""Lane geometry from trajectories, specifications and neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from .ranking import MODULUS, drawn

GROUP = ["camera", "group_id"]


def mean_polyline(trajectories: DataFrame, keys: list[str], k: int = 32) -> DataFrame:
    """Pointwise mean of a lane's trajectories, each resampled to k points."""
    rows = trajectories.where(F.size("line") >= 2).select(*keys, F.posexplode(g.resample(F.col("line"), k)).alias("k", "p"))
    points = rows.groupBy(*keys, "k").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    return points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: g.point(p["x"], p["y"])).alias("line"))


def centerlines(trajectories: DataFrame, keys: list[str], k: int = 32) -> DataFrame:
    """Smoothed mean polylines."""
    return mean_polyline(trajectories, keys, k).withColumn("line", g.smooth(F.col("line")))


def geometry(lanes: DataFrame, default_spacing: float | None = 0.05) -> DataFrame:
    """Each group's tangent, perpendicular to the right, spacing and outer lanes with their order.

    ``lanes``: camera, group_id, lane_ord (left to right), line. A group of one lane has the default spacing.
    """
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    dx, dy = last["x"] - first["x"], last["y"] - first["y"]
    n = F.sqrt(dx * dx + dy * dy)
    rows = lanes.withColumn("ux", F.when(n > 1e-8, dx / n)).withColumn("uy", F.when(n > 1e-8, dy / n)).withColumn("c", g.centroid(F.col("line")))
    ends = rows.groupBy(*GROUP).agg(F.coalesce(F.avg("ux"), F.lit(1.0)).alias("tx"), F.coalesce(F.avg("uy"), F.lit(0.0)).alias("ty"), F.count("*").alias("n_lanes"), F.min_by("line", "lane_ord").alias("left"), F.max_by("line", "lane_ord").alias("right"), F.min("lane_ord").alias("left_ord"), F.max("lane_ord").alias("right_ord"), F.min_by("c", "lane_ord").alias("cl"), F.max_by("c", "lane_ord").alias("cr"), F.collect_list("c").alias("cs"))
    ends = ends.withColumn("s", F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2) + 1e-8)
    ends = ends.withColumn("tx", F.col("tx") / F.col("s")).withColumn("ty", F.col("ty") / F.col("s"))
    return _sided(ends, default_spacing)


def _sided(ends: DataFrame, default_spacing: float | None) -> DataFrame:
    def across(c: Column) -> Column:
        return -c["x"] * F.col("ty") + c["y"] * F.col("tx")

    flip = F.when(across(F.col("cl")) > across(F.col("cr")), -1.0).otherwise(1.0)
    rows = ends.withColumn("flip", flip).withColumn("lat", F.array_sort(F.transform("cs", lambda c: F.col("flip") * across(c))))
    m = F.greatest(F.size("lat") - 1, F.lit(0))
    rows = rows.withColumn("gaps", F.array_sort(F.zip_with(F.slice("lat", 1, m), F.slice("lat", 2, m), lambda a, b: b - a)))
    middle = (F.element_at("gaps", F.floor((F.size("gaps") + 1) / 2).cast("int")) + F.element_at("gaps", F.floor((F.size("gaps") + 2) / 2).cast("int"))) / 2
    spacing = F.when(F.size("gaps") > 0, middle).otherwise(default_spacing)
    return rows.select(*GROUP, "n_lanes", "tx", "ty", (-F.col("flip") * F.col("ty")).alias("px"), (F.col("flip") * F.col("tx")).alias("py"), spacing.alias("spacing"), "left", "right", "left_ord", "right_ord")


def new_lane(geometry_rows: DataFrame, spec: str, k: int = 32, start: float = 3.5, fewest: int = 2) -> DataFrame:
    """A lane beside the outermost one, or one that merges into the rightmost.

    Groups of fewer than ``fewest`` lanes give none; without a spacing, all points are the origin.
    """
    rows = geometry_rows.where(F.col("n_lanes") >= fewest)
    unit = F.lit(0.0)

    def shifted(line: Column, factor) -> Column:
        n = F.greatest(F.size(line) - 1, F.lit(1))

        def at(p: Column, i: Column) -> Column:
            f = factor(i, n) * F.col("spacing")
            return g.point(F.least(F.greatest(p["x"] + F.col("px") * f, unit), F.lit(1.0)), F.least(F.greatest(p["y"] + F.col("py") * f, unit), F.lit(1.0)))

        return F.transform(line, at)

    if spec == "rightmost":
        line = shifted(F.col("right"), lambda i, n: F.lit(1.0))
    elif spec == "leftmost":
        line = shifted(F.col("left"), lambda i, n: F.lit(-1.0))
    elif spec == "merge":
        line = shifted(F.col("right"), lambda i, n: F.lit(start) * (1 - i / n))
    else:
        raise ValueError(f"unknown specification {spec}: rightmost, leftmost or merge")
    rows = rows.withColumn("raw", line).withColumn("even", g.resample(F.col("raw"), k))
    return rows.select(*GROUP, F.lit(spec).alias("spec"), g.smooth(F.col("even")).alias("line"), "px", "py", "spacing")


def merge_point(target: Column, neighbour: Column) -> Column:
    """Where along the target it is nearest to the neighbour, in 0..1."""
    near = F.transform(target, lambda p, i: F.struct(F.array_min(F.transform(neighbour, lambda q: g.distance(p, q))).alias("d"), i.alias("i")))
    return F.array_min(near)["i"] / F.greatest(F.size(target) - 1, F.lit(1))


def start_offset(target: Column, neighbour: Column, px: Column, py: Column) -> Column:
    """Signed offset of the target's start from the neighbour's nearest point."""
    first = F.element_at(target, 1)
    near = F.array_min(F.transform(neighbour, lambda q, i: F.struct(g.distance(first, q).alias("d"), i.alias("i"), q["x"].alias("x"), q["y"].alias("y"))))
    return (first["x"] - near["x"]) * px + (first["y"] - near["y"]) * py


def relational_pairs(lanes: DataFrame, relationships: DataFrame, gate: bool = True) -> DataFrame:
    """Explicit relationships and neighbours by rank as (target, neighbour) pairs.

    ``lanes``: camera, group_id, cls_id, rank, line. Neighbours by rank count only in groups that have
    a relationship, unless ``gate`` is off. Targets are given in the neighbour's frame.
    """
    rel = relationships.where("type in ('successor', 'adjacent')").select(*GROUP, F.col("type").alias("kind"), F.col("from_cls").alias("target"), F.col("to_cls").alias("neighbour"))
    order = Window.partitionBy(*GROUP).orderBy("rank", "cls_id")
    beside = lanes.withColumn("next", F.lead("cls_id").over(order)).where("next is not null").select(*GROUP, F.lit("adjacent").alias("kind"), F.col("cls_id").alias("target"), F.col("next").alias("neighbour"))
    if gate:
        beside = beside.join(relationships.select(*GROUP).distinct(), GROUP, "left_semi")
    both = beside.unionByName(beside.select(*GROUP, "kind", F.col("neighbour").alias("target"), F.col("target").alias("neighbour")))
    pairs = rel.unionByName(both.join(rel.select(*GROUP, "target", "neighbour"), [*GROUP, "target", "neighbour"], "left_anti"))
    axes = geometry(lanes.withColumnRenamed("rank", "lane_ord")).select(*GROUP, "tx", "ty")
    t = lanes.select(*GROUP, F.col("cls_id").alias("target"), F.col("line").alias("t_line"))
    n = lanes.select(*GROUP, F.col("cls_id").alias("neighbour"), F.col("line").alias("n_line"))
    rows = pairs.join(t, [*GROUP, "target"]).join(n, [*GROUP, "neighbour"]).join(axes, GROUP)
    rows = rows.withColumn("merge_point", merge_point(F.col("t_line"), F.col("n_line"))).withColumn("offset", start_offset(F.col("t_line"), F.col("n_line"), -F.col("ty"), F.col("tx")))
    rows = rows.withColumn("frame", g.to_canonical(F.col("n_line")))
    return rows.select(*GROUP, "kind", "target", "neighbour", "merge_point", "offset", g.shared_frame(F.col("t_line"), F.col("frame.centroid"), F.col("frame.angle"), F.col("frame.scale")).alias("target_line"), F.col("frame.canon").alias("neighbour_line"), F.col("frame.centroid").alias("centroid"), F.col("frame.angle").alias("angle"), F.col("frame.scale").alias("scale"))


def spatial_context(lanes: DataFrame, right: bool | None = None, left: bool | None = None, successor: bool | None = None, replace: int | None = None, default_spacing: float | None = 0.01) -> DataFrame:
    """Each group's anchor, neighbour, relationship and offset for a specification.

    ``lanes``: camera, group_id, cls_id, lane_ord, is_left, is_right, has_successor, line. The tangent
    is folded to the upper half plane and the perpendicular turned so that right lanes lie right. A group
    of one lane has the default spacing; without one it has no outer anchor.
    """
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    dx, dy = last["x"] - first["x"], last["y"] - first["y"]
    n = F.sqrt(dx * dx + dy * dy)
    group = Window.partitionBy(*GROUP)
    rows = lanes.withColumn("ux", F.when(n > 1e-8, dx / n)).withColumn("uy", F.when(n > 1e-8, dy / n)).withColumn("c", g.centroid(F.col("line")))
    rows = rows.withColumn("mx", F.avg("ux").over(group)).withColumn("my", F.avg("uy").over(group))
    fold = F.when((F.col("my") < 0) | ((F.col("my") == 0) & (F.col("mx") < 0)), -1.0).otherwise(1.0)
    rows = rows.withColumn("f", fold / (F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2) + 1e-8)).withColumn("tx", F.coalesce(F.col("mx") * F.col("f"), F.lit(1.0))).withColumn("ty", F.coalesce(F.col("my") * F.col("f"), F.lit(0.0)))
    rows = rows.withColumn("lat", -F.col("c.x") * F.col("ty") + F.col("c.y") * F.col("tx"))
    inverted = F.avg(F.when(F.col("is_right"), F.col("lat"))).over(group) < F.avg(F.when(F.col("is_left"), F.col("lat"))).over(group)
    rows = rows.withColumn("side", F.when(inverted, -1.0).otherwise(1.0)).withColumn("lat", F.round(F.col("lat") * F.col("side"), 12))
    curve = F.coalesce(g.variance_pop(g.turning(F.col("line"))), F.lit(0.0))
    item = F.struct("lane_ord", "cls_id", "lat", F.round(curve, 12).alias("curve"), "has_successor", "line")
    wide = rows.groupBy(*GROUP).agg(F.array_sort(F.collect_list(item)).alias("all"), F.max(-F.col("ty") * F.col("side")).alias("px"), F.max(F.col("tx") * F.col("side")).alias("py"), F.max(F.atan2("ty", "tx")).alias("heading"))
    wide = wide.withColumn("sorted", F.array_sort(F.transform("all", lambda z: z["lat"])))
    m = F.greatest(F.size("sorted") - 1, F.lit(0))
    wide = wide.withColumn("gaps", F.array_sort(F.zip_with(F.slice("sorted", 1, m), F.slice("sorted", 2, m), lambda a, b: b - a)))
    middle = (F.element_at("gaps", F.floor((F.size("gaps") + 1) / 2).cast("int")) + F.element_at("gaps", F.floor((F.size("gaps") + 2) / 2).cast("int"))) / 2
    wide = wide.withColumn("spacing", F.when(F.size("gaps") > 0, middle).otherwise(default_spacing))

    def pick(items: Column, key) -> Column:
        """The item of least key; the earlier lane of equal ones."""
        return F.array_min(F.transform(items, lambda z: F.struct(key(z).alias("k"), z.alias("z"))))["z"]

    every = F.col("all")
    rightmost, leftmost = pick(every, lambda z: -z["lat"]), pick(every, lambda z: z["lat"])
    side = F.lit("right")
    if replace is not None:
        found = F.filter(every, lambda z: z["cls_id"] == replace)
        anchor = F.when(F.size(found) > 0, F.element_at(found, 1)).otherwise(rightmost)
        half = (F.element_at("sorted", F.floor((F.size("sorted") + 1) / 2).cast("int")) + F.element_at("sorted", F.floor((F.size("sorted") + 2) / 2).cast("int"))) / 2
        side = F.when((F.size(found) > 0) & (F.element_at(found, 1)["lat"] < half), "left").otherwise("right")
    elif successor:
        found = F.filter(every, lambda z: z["has_successor"])
        anchor = F.when(F.size(found) > 0, pick(found, lambda z: -z["lat"])).otherwise(rightmost)
    elif right:
        anchor = rightmost
    else:
        anchor, side = leftmost, F.lit("left")
    wide = wide.withColumn("z_anchor", anchor).withColumn("anchor_side", side)
    if right or left:
        wide = wide.withColumn("z_anchor", pick(F.filter(every, lambda z: F.abs(z["lat"] - F.col("z_anchor")["lat"]) <= F.col("spacing")), lambda z: z["curve"]))
    others = F.filter(every, lambda z: z["lane_ord"] != F.col("z_anchor")["lane_ord"])
    kind, neighbour, offset = F.lit("adjacent"), F.col("z_anchor"), F.lit(None).cast("double")
    if replace is not None:
        neighbour = F.when(F.size(others) > 0, pick(others, lambda z: F.abs(z["lat"] - F.col("z_anchor")["lat"]))).otherwise(F.col("z_anchor"))
    elif successor:
        kind, ends = F.lit("successor"), F.filter(every, lambda z: ~z["has_successor"])
        neighbour = F.when(F.size(ends) > 0, pick(ends, lambda z: F.abs(z["lat"] - F.col("z_anchor")["lat"]))).otherwise(F.col("z_anchor"))
    wide = wide.withColumn("z_neighbour", neighbour)
    same = F.col("z_neighbour")["lane_ord"] == F.col("z_anchor")["lane_ord"]
    if replace is not None:
        offset = F.when(same, 0.0).otherwise(F.col("z_anchor")["lat"] - F.col("z_neighbour")["lat"])
    elif not successor and (right or left):
        offset = F.col("spacing") if right else -F.col("spacing")
    a, b = F.col("z_anchor")["line"], F.col("z_neighbour")["line"]
    fallback = F.when(F.col("anchor_side") == "right", F.col("spacing")).otherwise(-F.col("spacing"))
    return wide.select(
        *GROUP, "heading", "spacing", "px", "py", "anchor_side",
        F.col("z_anchor")["cls_id"].alias("anchor"), F.col("z_neighbour")["cls_id"].alias("neighbour"), kind.alias("kind"),
        F.when(same, 1.0).otherwise(merge_point(a, b)).alias("merge_point"),
        F.coalesce(offset, F.when(same, fallback).otherwise(start_offset(a, b, F.col("px"), F.col("py")))).alias("offset"),
        a.alias("anchor_line"), b.alias("neighbour_line"),
    )


def lateral_offset(line: Column, px: Column, py: Column, spacing: Column, spec: str) -> Column:
    """Shift of a candidate by one and a half lanes, tapered for a merge."""
    n = F.greatest(F.size(line) - 1, F.lit(1))
    factor = {"rightmost": lambda i: F.lit(1.5), "leftmost": lambda i: F.lit(-1.5), "merge": lambda i: 1.5 * (1 - i / n), "replace": lambda i: F.lit(0.0)}[spec]
    return F.transform(line, lambda p, i: g.point(p["x"] + px * spacing * factor(i), p["y"] + py * spacing * factor(i)))


def blend(anchor: Column, candidate: Column, share: float = 0.6) -> Column:
    """Pointwise mix of an anchor and a candidate."""
    return F.zip_with(anchor, candidate, lambda a, c: g.point(a["x"] * share + c["x"] * (1 - share), a["y"] * share + c["y"] * (1 - share)))


def smoothness(line: Column) -> Column:
    """Evenness of turning, 0 for a line that crosses itself."""

    def score(x: Column) -> Column:
        heads = F.transform(g.segments(x), lambda s: F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"]))

        def changes(h: Column) -> Column:
            m = F.greatest(F.size(h) - 1, F.lit(0))
            return F.zip_with(F.slice(h, 1, m), F.slice(h, 2, m), lambda a, b: F.abs(b - a))

        last = F.size(x) - 2
        crosses = F.exists(F.sequence(F.lit(0), last), lambda a: F.exists(F.sequence(F.lit(0), last), lambda b: (b >= a + 2) & g.segments_intersect(x[a], x[a + 1], x[b], x[b + 1])))
        return F.when((g.arc_length(x) < 1e-8) | crosses, 0.0).otherwise(1 / (1 + F.coalesce(g.variance_pop(g.let(heads, changes)), F.lit(0.0))))

    return g.let(line, score)


def heading_alignment(line: Column, heading: Column) -> Column:
    """1 along the group's heading or against it, 0 across."""
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    own = F.atan2(b["y"] - a["y"], b["x"] - a["x"])

    def wrapped(x: Column) -> Column:
        return F.least(F.abs(x), 2 * math.pi - F.abs(x))

    return F.greatest(F.lit(0.0), 1 - F.least(wrapped(own - heading), wrapped(own - heading + math.pi)) / (math.pi / 2))


def merge_convergence(line: Column, neighbour: Column) -> Column:
    """How a lane comes nearer to its neighbour: ratio of ends, and share of approaching steps."""
    near = F.transform(line, lambda p: F.array_min(F.transform(neighbour, lambda q: g.distance(p, q))))
    frame = F.struct(near.alias("d"))

    def score(z: Column) -> Column:
        d = z["d"]
        n = F.size(d)

        def mean(v: Column) -> Column:
            return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)

        width = F.least(n, F.lit(3))
        ratio = mean(F.slice(d, 1, width)) / (mean(F.slice(d, n - width + 1, width)) + 1e-8)
        steps = F.zip_with(F.slice(d, 1, F.greatest(n - 1, F.lit(0))), F.slice(d, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(b < a, 1.0).otherwise(0.0))
        return 0.6 * F.least(F.lit(1.0), ratio / 3) + 0.4 * F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.greatest(n - 1, F.lit(1))

    return F.transform(F.array(frame), score)[0]


def consensus(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """1 at the candidates' mean shape, 0 at the farthest candidate (G18): keys, candidate, consensus."""
    points = candidates.select(*keys, "candidate", F.posexplode("line").alias("k", "p"))
    mean = points.groupBy(*keys, "k").agg(F.avg("p.x").alias("mx"), F.avg("p.y").alias("my"))
    d = points.join(mean, [*keys, "k"]).groupBy(*keys, "candidate").agg(F.avg(F.sqrt((F.col("p.x") - F.col("mx")) ** 2 + (F.col("p.y") - F.col("my")) ** 2)).alias("d"))
    group = Window.partitionBy(*keys)
    score = F.when(F.count("*").over(group) > 1, 1 - F.col("d") / (F.max("d").over(group) + 1e-8)).otherwise(1.0)
    return d.select(*keys, "candidate", score.alias("consensus"))


def proximity(candidates: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """1 for no distance to the anchor, 0 for the farthest candidate (G19): keys, candidate, proximity."""
    d = candidates.join(anchors.select(*keys, F.col("line").alias("anchor_line")), keys).select(*keys, "candidate", g.chamfer(F.col("line"), F.col("anchor_line")).alias("d"))
    return d.select(*keys, "candidate", "d", (1 - F.col("d") / (F.max("d").over(Window.partitionBy(*keys)) + 1e-8)).alias("proximity"))


def best_candidate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of the highest score; the lower number of equal ones."""
    return scored.groupBy(*keys).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "candidate")).alias("b")).select(*keys, F.col("b.candidate").alias("candidate"))


def augment(lines: DataFrame, key: str, factor: int = 10, angle: float = 0.26, noise: float = 0.005, keep: float = 1.0, seed: int = 42) -> DataFrame:
    """Rotated and shaken copies of canonical lines (R2, R3): an integer key, copy, line; the same on every run.

    ``keep``: share of inner points that a copy keeps (ends stay), by their draws.
    """
    rows = lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(factor))))

    def unit(tag: int, *more: Column) -> Column:
        return drawn(F.col(key) * factor + F.col("copy"), F.lit(tag), *more, seed=seed) / float(MODULUS)

    rows = rows.withColumn("a", (2 * unit(1) - 1) * angle)

    def at(p: Column, k: Column) -> Column:
        x, y = p["x"] * F.cos("a") - p["y"] * F.sin("a"), p["x"] * F.sin("a") + p["y"] * F.cos("a")
        return g.point(x + (2 * unit(2, k) - 1) * noise, y + (2 * unit(3, k) - 1) * noise)

    shaken = F.transform("line", at)
    if keep < 1:
        shaken = F.filter(shaken, lambda p, k: (k == 0) | (k == F.size("line") - 1) | (unit(4, k) < keep))
    return rows.select(key, "copy", shaken.alias("line"))


def augment_pairs(pairs: DataFrame, key: str, factor: int = 10, degrees: float = 15.0, jitter: float = 0.02, stretch: tuple[float, float] = (0.9, 1.1), noise: float = 0.01, dropped: float = 0.3, seed: int = 42) -> DataFrame:
    """Copies of relational pairs, both lanes turned, moved and stretched alike.

    ``pairs``: an integer key, target_line, neighbour_line, merge_point, offset. A share of copies
    loses its relation: the neighbour, merge point and offset become 0. Draws are hashes of key, copy
    and place, so every run gives the same; noise is uniform.
    """
    rows = pairs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))

    def unit(tag: int, *more: Column) -> Column:
        return drawn(F.col(key) * factor + F.col("copy"), F.lit(tag), *more, seed=seed) / float(MODULUS)

    rows = rows.withColumn("angle", (2 * unit(1) - 1) * math.radians(degrees)).withColumn("shift", (2 * unit(2) - 1) * jitter).withColumn("by", stretch[0] + unit(3) * (stretch[1] - stretch[0])).withColumn("has_relation", unit(4) >= dropped)

    def moved(line: str, tag: int) -> Column:
        def at(p: Column, k: Column) -> Column:
            x = (p["x"] * F.cos("angle") - p["y"] * F.sin("angle")) * F.col("by")
            y = p["x"] * F.sin("angle") + p["y"] * F.cos("angle") + F.col("shift")
            return g.point(x + (2 * unit(tag, k) - 1) * noise, y + (2 * unit(tag + 1, k) - 1) * noise)

        return F.transform(line, at)

    kept = F.col("has_relation")
    gone = F.transform("neighbour_line", lambda p: g.point(F.lit(0.0), F.lit(0.0)))
    return rows.select(
        key,
        "copy",
        moved("target_line", 5).alias("target_line"),
        F.when(kept, moved("neighbour_line", 7)).otherwise(gone).alias("neighbour_line"),
        F.when(kept, F.col("merge_point")).otherwise(0.0).alias("merge_point"),
        F.when(kept, F.col("offset")).otherwise(0.0).alias("offset"),
        "has_relation",
    )


def resolve(index: DataFrame, spec) -> DataFrame:
    """One row with the mean vector of the lanes that a specification matches, nearer behaviour weighing more.

    If none matches, the mean of all.
    """
    from . import match

    chosen = match.behaviour_weighted(index.where(spec.condition()), spec.behaviour())
    mean = match.centroid(index).select(F.col("e").alias("all"))
    return mean.crossJoin(chosen).select(F.when(F.size("e") > 0, F.col("e")).otherwise(F.col("all")).alias("e"))  # a row each


def resolve_in_place(index: DataFrame, lanes: DataFrame, spec) -> DataFrame:
    """``resolve``, and where the lane goes if the specification names a camera and a group.

    One row: e, and ``context``, that group's row of ``spatial_context``; null if camera or group are not
    given, or there is no such group.
    """
    target = resolve(index, spec)
    here = lanes.where(F.lit(False) if spec.camera is None or spec.group_id is None else (F.col("camera") == spec.camera) & (F.col("group_id") == spec.group_id))
    context = spatial_context(here, spec.is_rightmost, spec.is_leftmost, spec.has_successor, spec.replace_cls)
    return target.join(context.select(F.struct("*").alias("context")), F.lit(True), "left")  # a row each


def placement(lines: DataFrame) -> DataFrame:
    """Centroid, angle and scale of the mean of all lines (G12), in one row."""
    points = lines.select(F.posexplode("line").alias("k", "p")).groupBy("k").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    mean = points.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: g.point(p["x"], p["y"])).alias("line"))
    return mean.select(g.to_canonical(F.col("line")).alias("f")).select("f.centroid", "f.angle", "f.scale")


def bev_lanes(rows: DataFrame, key: str, k: int = 16, radius: float = 60.0, most_variance: float = 0.001, limit: int | None = None) -> DataFrame:
    """Straight centre lines of a bird's-eye view within the scene, resampled in 0..1.

    ``rows``: key, line in metres around the vehicle. ``limit`` keeps the first by key.
    """
    inside = F.filter(F.transform("line", lambda p: g.point(p["x"] / (2 * radius) + 0.5, p["y"] / (2 * radius) + 0.5)), lambda p: p["x"].between(-0.1, 1.1) & p["y"].between(-0.1, 1.1))
    kept = rows.where(F.size("line") >= 2).select(key, inside.alias("line")).where(F.size("line") >= 2)

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    even = kept.select(key, F.transform(g.resample(F.col("line"), k), lambda p: g.point(clip(p["x"]), clip(p["y"]))).alias("line"))
    straight = even.withColumn("variance", g.variance_pop(g.turning(F.col("line")))).where(F.col("variance") <= most_variance)
    return straight if limit is None else straight.orderBy(key).limit(limit)

"""Lanes generated to a specification, from candidates in canonical form.

A sampler (any; see ``models``) gives ``candidates``: the group, candidate, canon. What is relational
is done here: where candidates are placed, how they are shifted, clipped and smoothed, how they are
scored, and which one is best. All joins are on the group, and a group has few candidates.

Each function returns the group, candidate, line, score, best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from . import generate as gen

GROUP = gen.GROUP
SPECS = ("rightmost", "leftmost", "merge", "replace")


def finished(line: Column) -> Column:
    """Within the frame, and smoothed."""

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    return g.smooth(F.transform(line, lambda p: g.point(clip(p["x"]), clip(p["y"]))))


def evenness(line: Column) -> Column:
    """How even a line's turning is, loops not asked for."""
    heads = F.transform(g.segments(line), lambda s: F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"]))

    def changes(h: Column) -> Column:
        m = F.greatest(F.size(h) - 1, F.lit(0))
        return F.zip_with(F.slice(h, 1, m), F.slice(h, 2, m), lambda a, b: F.abs(b - a))

    return 1 / (1 + F.coalesce(g.variance_pop(g.let(heads, changes)), F.lit(0.0)))


def warm_start(contexts: DataFrame) -> DataFrame:
    """The anchor in its neighbour's frame, moved sideways if it is its own neighbour (G12): group, start."""
    rows = contexts.withColumn("f", g.to_canonical(F.col("neighbour_line")))
    seen = g.shared_frame(F.col("anchor_line"), F.col("f.centroid"), F.col("f.angle"), F.col("f.scale"))
    shift = F.when(F.col("anchor") == F.col("neighbour"), F.coalesce("offset", F.lit(0.0)) / F.col("f.scale")).otherwise(0.0)
    return rows.withColumn("shift", shift).withColumn("seen", seen).select(*GROUP, F.transform("seen", lambda p: g.point(p["x"], p["y"] + F.col("shift"))).alias("start"))


def _placed(candidates: DataFrame, poses: DataFrame, line: str) -> DataFrame:
    """Candidates put where a line of their group is, with the poses' other columns."""
    rows = candidates.select(*GROUP, "candidate", "canon").join(poses, GROUP).withColumn("f", g.to_canonical(F.col(line)))
    return rows.withColumn("line", g.from_canonical(F.col("canon"), F.col("f.centroid"), F.col("f.angle"), F.col("f.scale"))).drop("canon", "f")


def _chosen(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy(*GROUP).orderBy(F.round("score", 9).desc(), "candidate")
    return scored.select(*GROUP, "candidate", "line", "score", (F.row_number().over(order) == 1).alias("best"))


def _by_specification(rows: DataFrame, spec: str | None) -> DataFrame:
    """Four tenths smoothness, six tenths what the specification asks for."""
    if spec == "merge":
        quality = gen.merge_convergence(F.col("line"), F.col("neighbour_line"))
    elif spec in ("rightmost", "leftmost"):
        quality = gen.heading_alignment(F.col("line"), F.col("heading"))
    elif spec == "replace":
        rows = rows.join(gen.consensus(rows, GROUP), [*GROUP, "candidate"])
        quality = F.col("consensus")
    else:
        quality = F.lit(0.5)
    return rows.withColumn("score", 0.4 * gen.smoothness(F.col("line")) + 0.6 * quality)


def from_specification(candidates: DataFrame, contexts: DataFrame, spec: str) -> DataFrame:
    """Candidates at their anchor's pose, moved aside as the specification asks.

    ``contexts``: of ``generate.spatial_context``. Groups without a context give none.
    """
    if spec not in SPECS:
        raise ValueError(f"unknown specification {spec}: {', '.join(SPECS)}")
    rows = _placed(candidates, contexts.select(*GROUP, "anchor_line", "neighbour_line", "heading", "px", "py", "spacing"), "anchor_line")
    moved = F.when(F.col("spacing") < 1e-6, F.col("line")).otherwise(gen.lateral_offset(F.col("line"), F.col("px"), F.col("py"), F.col("spacing"), spec))
    return _chosen(_by_specification(rows.withColumn("line", finished(moved)), spec))


def relational(candidates: DataFrame, contexts: DataFrame, spec: str) -> DataFrame:
    """Candidates in their neighbour's frame, where its relation to them is part of their shape."""
    rows = _placed(candidates, contexts.select(*GROUP, "neighbour_line", "heading"), "neighbour_line")
    return _chosen(_by_specification(rows.withColumn("line", finished(F.col("line"))), spec))


def _even(lines: DataFrame, k: int | None, name: str) -> DataFrame:
    """Lines of as many points as candidates have; None: they have these already."""
    return lines.select(*GROUP, (F.col("line") if k is None else g.resample(F.col("line"), k)).alias(name))


def _near_anchor(rows: DataFrame) -> DataFrame:
    """Seven tenths nearness to the anchor, three tenths evenness."""
    near = gen.proximity(rows.select(*GROUP, "candidate", "line"), rows.groupBy(*GROUP).agg(F.first("anchor_line").alias("line")), GROUP)
    scored = rows.join(near.select(*GROUP, "candidate", "proximity"), [*GROUP, "candidate"])
    return _chosen(scored.withColumn("score", 0.7 * F.col("proximity") + 0.3 * evenness(F.col("line"))))


def at_trajectory(candidates: DataFrame, anchors: DataFrame, k: int | None = 16) -> DataFrame:
    """Candidates at the pose of a centre line that vehicles drove (anchors: the group, line)."""
    rows = _placed(candidates, _even(anchors, k, "anchor_line"), "anchor_line")
    return _near_anchor(rows.withColumn("line", finished(F.col("line"))))


def beside_trajectory(candidates: DataFrame, anchors: DataFrame, neighbours: DataFrame, k: int | None = 16, share: float = 0.6) -> DataFrame:
    """Candidates in the frame of the driven line beside them, drawn towards the anchor."""
    near = _even(neighbours, k, "neighbour_line")
    rows = _placed(candidates, near.join(_even(anchors, k, "anchor_line"), GROUP), "neighbour_line")
    return _near_anchor(rows.withColumn("line", gen.blend(F.col("anchor_line"), finished(F.col("line")), share)))


def from_reference(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Candidates at the pose of a given line, or with its angle and size at another place (column centroid)."""
    rows = candidates.select(*GROUP, "candidate", "canon").join(references, GROUP).withColumn("f", g.to_canonical(F.col("line")))
    centre = F.coalesce("centroid", "f.centroid") if "centroid" in references.columns else F.col("f.centroid")
    rows = rows.withColumn("line", finished(g.from_canonical(F.col("canon"), centre, F.col("f.angle"), F.col("f.scale"))))
    return _chosen(_by_specification(rows, None))

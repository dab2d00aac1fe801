"""Geometry as column expressions over ``array<struct<x: double, y: double>>`` polylines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(line: Column) -> Column:
    """Consecutive pairs of a polyline's points: struct(a, b) each."""

    def build(x: Column) -> Column:
        n = F.greatest(F.size(x) - 1, F.lit(0))
        return F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(line, build)


def segment_distance(px: Column, py: Column, a: Column, b: Column, floor: float = 1e-12) -> Column:
    """Distance of a point to a segment; the foot is clamped to the segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = ((px - a["x"]) * dx + (py - a["y"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(floor))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (a["x"] + t * dx), py - (a["y"] + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def polyline_distance(px: Column, py: Column, segs: Column, drop_empty: bool = True) -> Column:
    """Least distance of a point to segments; empty segments are dropped or kept with a floor.

    Without any segment the result is infinite.
    """
    used = F.filter(segs, lambda s: (s["a"]["x"] != s["b"]["x"]) | (s["a"]["y"] != s["b"]["y"])) if drop_empty else segs
    return F.coalesce(F.array_min(F.transform(used, lambda s: segment_distance(px, py, s["a"], s["b"]))), F.lit(float("inf")))


def signed_distance(px: Column, py: Column, segs: Column) -> Column:
    """Distance to the nearest segment, negative on its right-hand side."""

    def each(s: Column, k: Column) -> Column:
        a, b = s["a"], s["b"]
        cross = (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
        return F.struct(segment_distance(px, py, a, b).alias("d"), k.alias("k"), F.when(cross < 0, -1.0).otherwise(1.0).alias("s"))

    near = F.array_min(F.transform(segs, each))
    return near["d"] * near["s"]


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def lengths(line: Column) -> Column:
    """Cumulative arc length at each point."""
    steps = F.transform(segments(line), lambda s: distance(s["a"], s["b"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))


def arc_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))


def resample(line: Column, k: int) -> Column:
    """k points at equal arc lengths: zeros for fewer than two points, the first point repeated for no length."""
    return let(line, lambda x: let(F.struct(x.alias("line"), lengths(x).alias("cum")), lambda z: _resampled(z["line"], z["cum"], k)))


def _resampled(line: Column, cum: Column, k: int) -> Column:
    total = F.element_at(cum, -1)
    steps = F.sequence(F.lit(0), F.lit(k - 1))

    def at(i: Column) -> Column:
        d = total * i / F.lit(float(max(k - 1, 1)))
        left = F.least(F.size(F.filter(cum, lambda c: c <= d)), F.size(line) - 1)  # 1-based
        c0, c1 = F.element_at(cum, left), F.element_at(cum, left + 1)
        a, b = F.element_at(line, left), F.element_at(line, left + 1)
        w = F.when(c1 > c0, (d - c0) / (c1 - c0)).otherwise(F.lit(0.0))
        return point(a["x"] + w * (b["x"] - a["x"]), a["y"] + w * (b["y"] - a["y"]))

    return (
        F.when(F.size(line) < 2, F.transform(steps, lambda i: point(F.lit(0.0), F.lit(0.0))))
        .when(total <= 0, F.transform(steps, lambda i: F.element_at(line, 1)))
        .otherwise(F.transform(steps, at))
    )


def centroid(line: Column) -> Column:
    return let(line, lambda x: point(F.aggregate(x, F.lit(0.0), lambda s, p: s + p["x"]) / F.size(x), F.aggregate(x, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(x)))


def to_canonical(line: Column) -> Column:
    """struct(canon, centroid, angle, scale): centred, chord along +x, unit arc length."""

    def frame(x: Column) -> Column:
        first, last = F.element_at(x, 1), F.element_at(x, -1)
        return F.struct(x.alias("line"), centroid(x).alias("c"), F.atan2(last["y"] - first["y"], last["x"] - first["x"]).alias("a"), F.greatest(arc_length(x), F.lit(1e-8)).alias("s"))

    return let(let(line, frame), lambda z: F.struct(shared_frame(z["line"], z["c"], z["a"], z["s"]).alias("canon"), z["c"].alias("centroid"), z["a"].alias("angle"), z["s"].alias("scale")))


def shared_frame(line: Column, c: Column, angle: Column, scale: Column) -> Column:
    """A polyline in the frame of another lane."""
    cos, sin = F.cos(-angle), F.sin(-angle)
    return F.transform(line, lambda p: point(((p["x"] - c["x"]) * cos - (p["y"] - c["y"]) * sin) / scale, ((p["x"] - c["x"]) * sin + (p["y"] - c["y"]) * cos) / scale))


def from_canonical(canon: Column, c: Column, angle: Column, scale: Column) -> Column:
    cos, sin = F.cos(angle), F.sin(angle)
    return F.transform(canon, lambda p: point((p["x"] * cos - p["y"] * sin) * scale + c["x"], (p["x"] * sin + p["y"] * cos) * scale + c["y"]))


def smooth(line: Column, passes: int = 4) -> Column:
    """Moving averages of three points; end points stay."""
    for _ in range(passes):
        # each pass sees the line once, by name
        line = F.transform(F.array(line), lambda z: F.transform(z, lambda p, k: F.when((k == 0) | (k == F.size(z) - 1), p).otherwise(point((F.element_at(z, F.greatest(k, F.lit(1))).getField("x") + p["x"] + F.element_at(z, F.least(k + 2, F.size(z))).getField("x")) / 3, (F.element_at(z, F.greatest(k, F.lit(1))).getField("y") + p["y"] + F.element_at(z, F.least(k + 2, F.size(z))).getField("y")) / 3))))[0]
    return line


def densify(line: Column, spacing: float = 5.0) -> Column:
    """Interpolated to about ``spacing``; the number of points depends on the length."""
    n = F.greatest((arc_length(line) / spacing).cast("int") + 1, F.lit(2))
    frame = F.struct(line.alias("line"), lengths(line).alias("cum"), n.alias("n"))

    def build(z: Column) -> Column:
        def at(i: Column) -> Column:
            d = F.element_at(z["cum"], -1) * i / (z["n"] - 1)
            # each step by name, as the search for the segment costs most
            return let(d, lambda d: let(F.least(F.size(F.filter(z["cum"], lambda c: c <= d)), F.size(z["line"]) - 1), lambda left: between(d, left)))

        def between(d: Column, left: Column) -> Column:
            ends = F.struct(F.element_at(z["cum"], left).alias("c0"), F.element_at(z["cum"], left + 1).alias("c1"), F.element_at(z["line"], left).alias("a"), F.element_at(z["line"], left + 1).alias("b"))
            return let(ends, lambda s: let(F.when(s["c1"] > s["c0"], (d - s["c0"]) / (s["c1"] - s["c0"])).otherwise(F.lit(0.0)), lambda w: along(s["a"], s["b"], w)))

        def along(a: Column, b: Column, w: Column) -> Column:
            return point(a["x"] + w * (b["x"] - a["x"]), a["y"] + w * (b["y"] - a["y"]))

        return F.transform(F.sequence(F.lit(0), z["n"] - 1), at)

    return F.transform(F.array(frame), build)[0]


def wrap(angle: Column) -> Column:
    """The smaller of an absolute angle difference and its complement to a turn."""
    return F.least(F.abs(angle), F.lit(2 * 3.141592653589793) - F.abs(angle))


def turning(line: Column) -> Column:
    """Wrapped absolute heading changes between consecutive segments."""
    heads = F.transform(segments(line), lambda s: F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"]))

    def build(x: Column) -> Column:
        m = F.greatest(F.size(x) - 1, F.lit(0))
        return F.zip_with(F.slice(x, 1, m), F.slice(x, 2, m), lambda a, b: wrap(b - a))

    return let(heads, build)


def variance_pop(values: Column) -> Column:
    """Population variance of an array of doubles; null if it is empty."""

    def spread(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
        return F.when(F.size(x) > 0, let(mean, lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m))) / F.size(x))

    return let(values, spread)


def segments_intersect(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Whether two segments cross strictly."""

    def side(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    return (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)


def chamfer(a: Column, b: Column) -> Column:
    """Mean nearest-point distance, averaged over both directions."""

    def one_way(x: Column, y: Column) -> Column:
        near = F.transform(x, lambda p: F.array_min(F.transform(y, lambda q: distance(p, q))))
        return F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.size(near)

    return (one_way(a, b) + one_way(b, a)) / 2


def project_to_pixel(x: Column, y: Column, z: Column, k: list[list[float]], r: list[list[float]], t: list[float]) -> Column:
    """Pinhole projection struct(u, v); null where the depth is not above 0.5."""
    cam = [sum((F.lit(float(r[i][j])) * (x, y, z)[j] for j in range(3)), F.lit(float(t[i]))) for i in range(3)]
    u, v, w = (sum((F.lit(float(k[i][j])) * cam[j] for j in range(3)), F.lit(0.0)) for i in range(3))
    return F.when(cam[2] > 0.5, F.struct((u / w).alias("u"), (v / w).alias("v")))

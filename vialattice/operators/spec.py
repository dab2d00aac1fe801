"""Specifications of lanes, written or spoken, and labels by rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .match import role_filter


@dataclass(frozen=True)
class LaneSpec:
    """What a lane should be like; unset parts ask nothing."""

    camera: str | None = None
    group_id: int | None = None
    is_leftmost: bool | None = None
    is_rightmost: bool | None = None
    has_successor: bool | None = None
    lateral_rank: float | None = None
    replace_cls: int | None = None
    speed: float | None = None
    curvature: float | None = None
    replace_with: str | None = None
    offset: float | None = None
    count: float | None = None

    @classmethod
    def rightmost(cls, **more) -> LaneSpec:
        return cls(is_rightmost=True, **more)

    @classmethod
    def leftmost(cls, **more) -> LaneSpec:
        return cls(is_leftmost=True, **more)

    @classmethod
    def merge(cls, **more) -> LaneSpec:
        return cls(has_successor=True, **more)

    @classmethod
    def replace_role(cls, replace_cls: int, replace_with: str, **more) -> LaneSpec:
        """A lane in the place of another, in a given role; an unknown role asks nothing of it."""
        role = {"rightmost": {"is_rightmost": True}, "leftmost": {"is_leftmost": True}, "merge": {"has_successor": True}}
        return cls(replace_cls=replace_cls, replace_with=replace_with, **role.get(replace_with, {}), **more)

    @classmethod
    def from_behavior(cls, speed: float | None = None, curvature: float | None = None, offset: float | None = None, count: float | None = None, **more) -> LaneSpec:
        """A lane by some of its statistics, and by its role if that is given, too."""
        return cls(speed=speed, curvature=curvature, offset=offset, count=count, **more)

    def prefix(self) -> tuple[list[float], list[float]]:
        """Which of the four statistics are set, as ones and zeros, and their values, 0 where they aren't."""
        given = (self.speed, self.curvature, self.offset, self.count)
        return [float(x is not None) for x in given], [0.0 if x is None else float(x) for x in given]

    def condition(self) -> Column:
        return role_filter(self.is_leftmost, self.is_rightmost, self.has_successor, self.lateral_rank)

    def behaviour(self) -> dict[str, float]:
        """Wanted statistics that are set."""
        return {n: x for n, x in (("speed", self.speed), ("curvature", self.curvature), ("lateral_offset", self.offset), ("density", self.count)) if x is not None}


#: Words that a description is searched for.
RIGHT, LEFT, MERGE = ("rightmost", "right"), ("leftmost", "left"), ("merge", "exit")
FAST, SLOW = ("fast", "high speed", "highway"), ("slow", "low speed")
CURVY, STRAIGHT = ("curvy", "high curvature", "winding"), ("straight", "low curvature")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def parse(text: Column) -> Column:
    """A described lane as struct(is_rightmost, is_leftmost, has_successor, speed, curvature) (P20)."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    right = _any(t, RIGHT)
    return F.struct(
        right.alias("is_rightmost"),
        (~right & _any(t, LEFT)).alias("is_leftmost"),
        _any(t, MERGE).alias("has_successor"),
        F.when(_any(t, FAST), 0.8).when(_any(t, SLOW), 0.2).alias("speed"),
        F.when(_any(t, CURVY), 0.05).when(_any(t, STRAIGHT), 0.005).alias("curvature"),
    )


def prefix_distance(values: Column, mask: list[float], wanted: list[float]) -> Column:
    """Squared distance of statistics from a prefix over the dimensions that it sets."""
    return sum((m * (values[k] - w) ** 2 for k, (m, w) in enumerate(zip(mask, wanted, strict=True))), F.lit(0.0))


def decision(logit: Column, threshold: float = 0.5) -> Column:
    """Whether a logit's probability is above the threshold."""
    return 1 / (1 + F.exp(-logit)) > threshold


def hcm_type(speed: Column, density: Column, edge_ratio: Column) -> Column:
    """Kind of traffic from a cluster's statistics."""
    return (
        F.when(density < 0.1, "Low-volume")
        .when((speed > 0.015) & (density > 0.3), "Free-flow (high vol)")
        .when((speed > 0.01) & (edge_ratio > 0.5), "Edge lane (free)")
        .when(speed > 0.01, "Free-flow")
        .when(speed > 0.005, "Synchronized")
        .otherwise("Congested")
    )

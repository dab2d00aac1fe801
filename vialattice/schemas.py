"""Schemas of the inputs and results."""

from __future__ import annotations

POINTS = "id long, time double, frame_num long, class int, conf double, x double, y double, w int, h int"
RELATIONSHIPS = "array<struct<type: string, from_cls: int, to_cls: int, from_lane: int, to_lane: int>>"
ANNOTATION = (
    "camera string, image string, lane_groups array<struct<group_id: int, heading_deg: double, "
    "lanes: array<struct<cls_id: int, color: array<int>, waypoints: array<struct<x: double, y: double>>>>, "
    f"relationships: {RELATIONSHIPS}>>"
)
ASSIGNMENTS = "track_id long, time double, x double, y double, lane_id long, lane_score double, group_id long, lane_change boolean"

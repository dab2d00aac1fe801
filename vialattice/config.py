"""Default parameters of the lane operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LaneConfig:
    """Pixel frame, assignment thresholds, window layout and matching thresholds."""

    width: float = 1920.0
    height: float = 1080.0
    reject_px: float = 60.0
    change_std_px: float = 30.0
    min_points: int = 5
    polyline_points: int = 16
    max_trajectories: int = 50
    rank_gap: float = 0.15
    role_cosine: float = 0.8
    window_size: float = 300.0
    window_stride: float = 150.0
    window_total: float = 1800.0
    min_window_trajectories: int = 2
    z_limit: float = 2.0


DEFAULT = LaneConfig()

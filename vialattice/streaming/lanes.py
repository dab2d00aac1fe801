"""Lanes on a stream: windows anchored at each lane's first trajectory, and a recurrent state by lane.

Both need the RocksDB state store, and start again from their checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.models import Weights, dense
from ..operators.windows import LANE, n_windows

TRAJECTORY = "first_ms long, mean_time double, speed double, curvature double, lateral_offset double"
WINDOW = "lane_key string, w int, n_traj long, speed double, curvature double, lateral_offset double"


class LaneWindows(StatefulProcessor):
    """Counts and sums of each window of a lane that a trajectory's mean time falls into.

    A lane's windows begin at its first trajectory, which is known once the watermark has passed the least
    first time seen: until then trajectories are held. A window is put out when the watermark passes
    its end, as no trajectory that began later can fall into it.
    """

    def __init__(self, size: float, stride: float, total: float):
        self.size, self.stride, self.count = size, stride, n_windows(size, stride, total)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "ms long")
        self.least = handle.getValueState("least", "ms long")
        self.held = handle.getListState("held", TRAJECTORY)
        self.sums = handle.getMapState("sums", "w int", "n long, speed double, curvature double, lateral_offset double")

    def _add(self, rows: Iterator[tuple], start: int) -> None:
        for _, time, *values in rows:
            t = time - start / 1000
            last = min(self.count - 1, int(t // self.stride))
            for w in range(max(0, last - int(self.size // self.stride) - 1), last + 1):
                if w * self.stride <= t < w * self.stride + self.size:
                    old = self.sums.getValue((w,)) if self.sums.containsKey((w,)) else (0, 0.0, 0.0, 0.0)
                    self.sums.updateValue((w,), (old[0] + 1, *(a + b for a, b in zip(old[1:], values, strict=True))))
                    self.handle.registerTimer(self._end(start, w))

    def _end(self, start: int, w: int) -> int:
        return start + int(np.ceil((w * self.stride + self.size) * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            given = list(batch[["first_ms", "mean_time", "speed", "curvature", "lateral_offset"]].itertuples(index=False, name=None))
            if not given:
                continue
            if self.start.exists():
                self._add(given, self.start.get()[0])
                continue
            self.held.appendList([tuple(r) for r in given])
            first = min(r[0] for r in given)
            if not self.least.exists() or first < self.least.get()[0]:
                self.least.update((int(first),))
                self.handle.registerTimer(int(first))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.start.exists():
            if at == self.least.get()[0]:  # none that begins earlier can come any more
                self.start.update((at,))
                self._add(self.held.get(), at)
                self.held.clear()
            yield pd.DataFrame()
            return
        out = []
        start = self.start.get()[0]
        for w in range(self.count):
            if self._end(start, w) == at and self.sums.containsKey((w,)):
                n, *total = self.sums.getValue((w,))
                out.append((key[0], w, n, *(x / n for x in total)))
                self.sums.removeKey((w,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOW.split(", ")]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def lane_windows(trajectories: DataFrame, size: float, stride: float, total: float, late: str = "1 day") -> DataFrame:
    """lane_key, w, n_traj and mean statistics of each window with trajectories, once it is over.

    ``trajectories``: a stream of camera, group_id, cls_id, first_time, mean_time (seconds), speed, curvature,
    lateral_offset. Those that come later than ``late`` behind the latest are left out.
    """
    rows = trajectories.withColumn("began", F.timestamp_millis(F.floor(F.col("first_time") * 1000).cast("long"))).withWatermark("began", late)
    rows = rows.select(F.concat_ws("|", *LANE).alias("lane_key"), "began", F.floor(F.col("first_time") * 1000).cast("long").alias("first_ms"), "mean_time", "speed", "curvature", "lateral_offset")
    return rows.groupBy("lane_key").transformWithStateInPandas(LaneWindows(size, stride, total), WINDOW, "Append", "EventTime")


class Recurrent(StatefulProcessor):
    """The hidden state of each lane between batches, and a logit for each window as it comes."""

    def __init__(self, w: Weights, names: tuple[str, ...]):
        self.w, self.names = w, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last int, hidden string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows)).sort_values("w")
        d = self.w["out"].shape[0] - 1
        last, h = -1, np.zeros(d)
        if self.state.exists():
            last, text = self.state.get()
            h = np.array(json.loads(text))
        t = t[t.w > last].drop_duplicates("w")  # a window that came before, or twice, changes nothing
        out = []
        for w, step in zip(t.w, t[list(self.names)].to_numpy(float), strict=True):
            a, b = dense(step, self.w["x"]), dense(h, self.w["h"])
            r, z = (1 / (1 + np.exp(-(a[k * d : (k + 1) * d] + b[k * d : (k + 1) * d]))) for k in (0, 1))
            n = np.tanh(a[2 * d :] + r * b[2 * d :])
            h = (1 - z) * n + z * h
            out.append((key[0], int(w), float(dense(h, self.w["out"])[0])))
        if out:
            self.state.update((out[-1][1], json.dumps(h.tolist())))
        yield pd.DataFrame(out, columns=["lane_key", "w", "logit"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def anomaly_logits(windows: DataFrame, w: Weights, names: tuple[str, ...] = ("speed", "curvature", "lateral_offset", "density")) -> DataFrame:
    """lane_key, w, logit of a stream of windows (lane_key, w and ``names``), which come in order of w for each lane."""
    return windows.select("lane_key", "w", *names).groupBy("lane_key").transformWithStateInPandas(Recurrent(w, names), "lane_key string, w int, logit double", "Append", "None")

"""Lane windows and the recurrent state on streams against their batch versions, over several batches and a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialattice.operators import models
from vialattice.operators import windows as batch
from vialattice.streaming import lanes
from vialattice.streaming.windows import run_available

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRAJS = "camera string, group_id int, cls_id int, first_time double, mean_time double, speed double, curvature double, lateral_offset double"


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windows_anchored_by_lane_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    base, rows = 1_700_000_000.0, []
    for k in range(300):
        first = base + 1000 * (k % 3) + float(rng.uniform(0, 7200))
        rows.append((f"c{k % 2}", k % 3, 0, first, first + float(rng.uniform(1, 400)), float(rng.normal()), float(rng.normal()), float(rng.normal())))
    rows.sort(key=lambda r: r[3] + float(rng.uniform(-300, 300)))  # out of order by less than what may come late
    size, stride, total = 600.0, 300.0, 7200.0
    end = [(f"c{a}", b, 0, base + 90_000, base + 90_000, 0.0, 0.0, 0.0) for a in range(2) for b in range(3)]  # moves the watermark on
    given = spark.createDataFrame(rows, TRAJS)
    want = batch.assign_windows(given, size, stride, total).groupBy(*batch.LANE, "w").agg(F.count("*").alias("n"), F.avg("speed").alias("s"), F.avg("lateral_offset").alias("o"))
    want = {("|".join(map(str, r[:3])), r["w"]): (r["n"], round(r["s"], 9), round(r["o"], 9)) for r in want.collect()}
    parts = [rows[k::1][: 100] if k == 0 else rows[k : k + 100] for k in (0, 100, 200)]
    for k, part in enumerate([*parts, end[:3], end[3:]]):
        spark.createDataFrame(part, TRAJS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # each run takes what is new and ends; the next one starts again from the checkpoint
        stream = lanes.lane_windows(spark.readStream.schema(TRAJS).parquet(str(tmp_path / "in")), size, stride, total, "20 minutes")
        run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    got = {(r["lane_key"], r["w"]): (r["n_traj"], round(r["speed"], 9), round(r["lateral_offset"], 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and len(want) > 100


def test_late_rows_are_left_out(spark, tmp_path):
    row = lambda first, speed: ("c", 0, 0, first, first, speed, 0.0, 0.0)
    for part in ([row(1000.0, 1.0)], [row(9000.0, 1.0)], [row(1010.0, 50.0)], [row(99_000.0, 1.0)], [row(99_001.0, 1.0)]):
        spark.createDataFrame(part, TRAJS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_available(lanes.lane_windows(spark.readStream.schema(TRAJS).parquet(str(tmp_path / "in")), 60.0, 60.0, 600.0, "1 minute"), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    assert [(r["w"], r["n_traj"], r["speed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(0, 1, 1.0)]


def test_recurrent_state_goes_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(2)
    schema = "lane_key string, w int, speed double, curvature double, lateral_offset double, density double"
    rows = [(f"l{k}", w, *map(float, rng.normal(size=4))) for k in range(5) for w in range(11)]
    w = models.gru_weights(seed=3)
    for low, high in ((0, 4), (4, 5), (5, 11)):
        part = [r for r in rows if low <= r[1] < high] + [r for r in rows if r[1] == low - 1]  # some come again
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        run_available(lanes.anomaly_logits(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), w), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    got = {(r["lane_key"], r["w"]): r["logit"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["lane_key"], r["w"]): r["logit"] for r in models.anomaly_logits(spark.createDataFrame(rows, schema), ["lane_key"], w).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)

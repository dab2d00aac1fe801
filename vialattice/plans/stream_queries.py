"""Queries of the streaming twins, run as batches of all available rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows
from .fixtures import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def stream_windows(spark, sf_dir):
    """The windowed statistics in batch, equal to the stream's final result."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.windowed(events)
    return out.select(F.unix_micros("start").alias("start_us"), "camera", "n", F.round("mean_value", 6).alias("mean_value"))


QUERIES["stream_windows"] = stream_windows
ORACLE_SQL["stream_windows"] = """
with e as (select epoch_us(ts) as t, 'cam' || (user_id % 5) as camera, value from events),
w as (select t - t % 216000000000 - o * 216000000000 as start_us, camera, value from e cross join (select unnest([0, 1]) as o))
select start_us, camera, count(*) as n, round(avg(value), 6) as mean_value from w group by all"""


def stream_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.sessions(events)
    return out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "user_id", "n")


QUERIES["stream_sessions"] = stream_sessions
ORACLE_SQL["stream_sessions"] = """
with e as (select user_id, epoch_us(ts) as t from events),
g as (select *, coalesce(t - lag(t) over (partition by user_id order by t) >= 21600000000, true)::int as first from e),
s as (select *, sum(first) over (partition by user_id order by t rows unbounded preceding) as k from g)
select min(t) as start_us, max(t) + 21600000000 as end_us, user_id, count(*) as n from s group by user_id, k"""


"""Streaming twins: windowed lane statistics with late data bounded, and forward fill by key (2.12)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """events as a stream; ts becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "5 days", slide: str | None = "2 days 12 hours", late: str = "1 day") -> DataFrame:
    """Count and mean value by sliding window and camera; late rows beyond the watermark are dropped.

    Windows are aligned to the epoch, not to a lane's first point as in the batch operator.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    camera = F.concat(F.lit("cam"), (F.col("user_id") % 5).cast("string"))
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), camera.alias("camera")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "camera", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Activity sessions of each user."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def run_available(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there into Parquet, exactly once, and stop."""
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class ForwardFill(StatefulProcessor):
    """Gives each row of a key its last known value (W9 on a stream)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.sort_values(["ts", "event_id"])
            known = self.last.get()[0] if self.last.exists() else None
            filled = batch["value"].ffill()
            if known is not None:
                filled = filled.fillna(known)
            left = filled.dropna()
            if len(left):
                self.last.update((float(left.iloc[-1]),))
            yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"], "filled": filled})

    def close(self) -> None:
        pass


def forward_fill(events: DataFrame) -> DataFrame:
    """event_id and last known value; needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(ForwardFill(), "user_id long, event_id long, filled double", "Append", "None")

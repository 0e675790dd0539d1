"""Usage analytics as a stream: windowed counts by tool, with late calls up to a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_calls(usage: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, tool, calls, tokens): calls of a stream (ts, tool, tokens) by window; later than ``late`` are dropped."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    timed = usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(at.alias("w"), "tool").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select(
        F.col("w.start").alias("start"), "tool", "calls", "tokens"
    )


def sessions(usage: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(start, end, user_id, calls): runs of a user's calls without a pause of ``gap``."""
    timed = usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("calls")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "calls"
    )


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what there is as Parquet and stops; run again, it goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

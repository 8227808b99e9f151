"""Odds ticks as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_prices(ticks: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Opening, closing, lowest and highest price of each runner and bookmaker by window of event time.

    Works on a batch and on a stream alike; on a stream, ticks later than ``lateness`` are dropped and closed windows leave the state.
    """
    rows = ticks.withWatermark("tick_ts", lateness) if ticks.isStreaming else ticks
    order = F.struct("tick_ts", "event_id")
    out = rows.groupBy(F.window("tick_ts", width).alias("w"), "runner_id", "bookmaker").agg(F.min_by("price", order).alias("opening"), F.max_by("price", order).alias("closing"), F.min("price").alias("lowest"), F.max("price").alias("highest"), F.count(F.lit(1)).alias("ticks"))
    return out.select(F.col("w.start").alias("window_start"), "runner_id", "bookmaker", "opening", "closing", "lowest", "highest", "ticks")


def run_to_parquet(ticks: DataFrame, path: str, checkpoint: str, width: str = "1 hour", lateness: str = "2 hours"):
    """Starts the stream of finished windows into a folder; it ends when the available input is read."""
    return windowed_prices(ticks, width, lateness).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sliding_windows(ticks: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Ticks and mean price by bookmaker in windows that overlap."""
    rows = ticks.withWatermark("tick_ts", late) if ticks.isStreaming else ticks
    out = rows.groupBy(F.window("tick_ts", length, step).alias("w"), "bookmaker").agg(F.count(F.lit(1)).alias("ticks"), F.avg("price").alias("mean_price"))
    return out.select(F.col("w.start").alias("window_start"), "bookmaker", "ticks", "mean_price")


def session_windows(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A runner's ticks in sessions that a gap ends."""
    rows = ticks.withWatermark("tick_ts", late) if ticks.isStreaming else ticks
    out = rows.groupBy(F.session_window("tick_ts", gap).alias("w"), "runner_id").agg(F.count(F.lit(1)).alias("ticks"))
    return out.select("runner_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ticks")


def once(stream: DataFrame, keys: list[str], time: str = "tick_ts", late: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def idempotent_sink(path: str):
    """A ``foreachBatch`` writer: each micro-batch replaces a folder of its own, so that one run again after a failure changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write

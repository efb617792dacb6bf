"""Time windows anchored at the first record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULT, DetectConfig


def bounds(requests: DataFrame) -> DataFrame:
    """One row: t0 and t_max."""
    return requests.agg(F.min("ts").alias("t0"), F.max("ts").alias("t_max"))


def training_window(requests: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """Requests of the first hour, both ends included."""
    span = bounds(requests)
    return requests.join(F.broadcast(span), F.col("ts") <= F.col("t0") + F.expr(f"INTERVAL {cfg.training_sec} SECONDS")).drop("t0", "t_max")


def assign_windows(requests: DataFrame, window_sec: int | None = None, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """Add w, window_start and window_end of tumbling windows that start while they begin before t_max.

    A record at t_max exactly on a boundary belongs to no window; if all times are equal there is none.
    """
    sec = window_sec or cfg.window_sec
    span = bounds(requests)
    w = F.floor((F.unix_micros("ts") - F.unix_micros("t0")) / (sec * 1_000_000)).cast("long")
    start = F.timestamp_micros(F.unix_micros("t0") + F.col("w") * (sec * 1_000_000))
    rows = requests.join(F.broadcast(span)).withColumn("w", w).withColumn("window_start", start).filter(F.col("window_start") < F.col("t_max"))
    return rows.withColumn("window_end", F.timestamp_micros(F.unix_micros("window_start") + sec * 1_000_000)).drop("t0", "t_max")


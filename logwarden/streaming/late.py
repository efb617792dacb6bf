"""Window counts of a stream that keep what comes too late, in a table of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.sources.scratch import materialise, temporary_tables
from logwarden.streaming.rates import DELAY
from logwarden.streaming.versions import drop_versions, last_version, write_version

#: Windows that are still open, and the latest time that any batch has seen; the second tells that both are whole.
STATE = {"open": "window_start timestamp, ip string, n long, errors long", "latest": "ts timestamp"}


def _counts(rows: DataFrame, *keys: str | Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))


def start_counts(requests: DataFrame, path: str, delay: str = DELAY, window_sec: int = 300):
    """Count requests by tumbling window and address; returns the query.

    requests: a stream with ts, ip, status. As with a watermark, a row is late if its window ended at
    least ``delay`` before the latest time that earlier batches saw. A window is written to
    path/counts (window_start, ip, n, errors) by the batch that lets it close; late rows are counted
    in path/late (window_start, ip, windows_late, n, errors), windows_late being whole windows
    between the end of the row's own and that bound. Together they hold every request once. Rows
    without a time are late by nothing known and go to path/late with null windows.

    A batch reads the open windows that the batch before left, and nothing older. All it writes lies
    under its number, so a repeated batch replaces its own rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with temporary_tables():
            micros = F.unix_micros("ts")
            start = F.timestamp_micros(micros - F.pmod(micros, F.lit(window_sec * 1_000_000)))
            rows = batch.select("ip", start.alias("window_start"), "ts", F.lit(1).alias("n"), F.coalesce((F.col("status") >= 400).cast("long"), F.lit(0)).alias("errors"))
            rows = materialise(rows.groupBy("window_start", "ip").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.max("ts").alias("ts")), "arrived")
            if rows.isEmpty():
                return
            last, state = last_version(spark, path, STATE, number)
            seen = state["latest"].agg(F.max(F.unix_micros("ts"))).first()[0]
            now = state["latest"].unionByName(rows.select("ts")).agg(F.max("ts").alias("ts"))
            newest = now.select(F.unix_micros("ts")).first()[0]
            end = F.col("window_start") + F.expr(f"INTERVAL {window_sec} SECONDS")
            bound = lambda at: F.timestamp_micros(F.lit(at).cast("long")) - F.expr(f"INTERVAL {delay}")
            late = F.col("window_start").isNull() | F.coalesce(end <= bound(seen), F.lit(False))
            behind = F.floor((F.unix_micros(bound(seen)) - F.unix_micros(end)) / (window_sec * 1_000_000))
            rows.filter(late).select("window_start", "ip", behind.alias("windows_late"), "n", "errors").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            open_ = materialise(_counts(rows.filter(~late).select("window_start", "ip", "n", "errors").unionByName(state["open"]), "window_start", "ip"), "open")
            closed = F.coalesce(end <= bound(newest), F.lit(False))
            open_.filter(closed).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
            write_version(path, number, {"open": open_.filter(~closed), "latest": now})
            drop_versions(spark, path, STATE, (last, number))

    return requests.select("ts", "ip", "status").writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def counted(spark: SparkSession, path: str) -> DataFrame:
    """(window_start, ip, windows_late, n, errors): what start_counts() has written so far; on time is null windows_late of a known window."""
    on_time = spark.read.schema("window_start timestamp, ip string, n long, errors long, batch long").parquet(f"{path}/counts").withColumn("windows_late", F.lit(None).cast("long"))
    late = spark.read.schema("window_start timestamp, ip string, windows_late long, n long, errors long, batch long").parquet(f"{path}/late")
    return on_time.unionByName(late).select("window_start", "ip", "windows_late", "n", "errors")

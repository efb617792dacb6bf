"""A request log derived from ``lineitem`` by integer arithmetic, so that queries have logs to read.

The tables hold no access log. FIXTURES.md has the rule; the same rule in SQL is in oracle.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions import network, parsing
from logwarden.sources.scratch import materialise

BASE = 1_758_826_800  # 2025-09-25 19:00:00 UTC


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed requests of the derived log."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").cast("long").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_partkey").cast("long").alias("pk"),
        F.col("l_suppkey").cast("long").alias("sk"), F.col("l_quantity").cast("int").alias("q"),
    )
    # the table is one row group, hence one task; a log is many splits
    li = li.repartition(spark.sparkContext.defaultParallelism, "ok", "ln", "pk")
    rows = li.selectExpr("*", "(ok*7919 + ln*104729 + pk*31) % 10800 AS sec", "(ok*31 + ln*17 + pk*7) % 100 AS k")
    rows = rows.selectExpr(
        f"timestamp_seconds({BASE} + sec) AS ts",
        """CASE WHEN k < 45 THEN concat('203.0.113.', pk % 120) WHEN k < 50 THEN '198.51.100.7'
                WHEN sk % 5 = 0 THEN concat('2a03:2880:f8', lpad(string(sk % 100), 2, '0'), ':c::', ln % 2 + 1)
                ELSE concat('10.', sk % 200, '.', sk div 200, '.', ln % 2 + 1) END AS ip""",
        """CASE WHEN k < 45 THEN concat('/4cHCCP5v8YP_K73rMwVH0iMr', CASE WHEN pk % 12 = 0 THEN 1 + ok % 3 ELSE 0 END)
                WHEN k < 50 THEN concat('/z', ok, '-', ln) WHEN sec >= 3600 AND k < 60 THEN concat('/New01', pk % 20)
                ELSE concat('/p', pk % 10, '/', pk % 40, repeat('x', q)) END AS path""",
        "CASE WHEN k < 45 THEN 301 WHEN k < 50 THEN 404 WHEN q >= 47 THEN 404 WHEN q = 46 THEN 503 ELSE 200 END AS status",
        "CASE WHEN k < 45 THEN 'netbot/1.0' WHEN k < 50 THEN NULL ELSE concat('Mozilla/5.', sk % 20) END AS ua",
        "CASE WHEN k >= 50 AND ok % 7 = 0 THEN 'POST' WHEN k >= 50 AND ok % 11 = 0 THEN 'HEAD' ELSE 'GET' END AS verb",
        "CASE WHEN (ok + ln) % 3 > 0 THEN concat('https://site', pk % 15, '.example/', ln) END AS ref",
    )
    hexed = F.when(network.is_ipv4(F.col("ip")), network.ipv4_hex(F.col("ip")))
    rows = rows.withColumn("status_class", parsing.status_class(F.col("status")))
    # stored once: later steps name these columns many times over; few name the address's value
    return materialise(rows, "requests").withColumn("ip_hex", hexed)


def combined_lines(requests: DataFrame) -> DataFrame:
    """The log as lines of the combined format."""
    time = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    return requests.select(
        F.concat(
            "ip", F.lit(" - - ["), time, F.lit(' +0000] "'), "verb", F.lit(" "), "path", F.lit(' HTTP/1.1" '), F.col("status").cast("string"), F.lit(' 169 "'),
            F.coalesce("ref", F.lit("-")), F.lit('" "'), F.coalesce("ua", F.lit("-")), F.lit('"'),
        ).alias("value")
    )


def cdn_lines(requests: DataFrame) -> DataFrame:
    """The log as lines of the pipe-delimited format, paths as URLs with parameters and queries."""
    return requests.select(
        F.concat_ws(
            "|", F.lit("HIT"), F.col("status").cast("string"), F.unix_millis("ts").cast("string"), F.lit("1314"), F.lit("4029805"), "ip", F.lit("-"),
            F.concat(F.lit("https://www.example.com"), "path", F.lit(";v=1?q=2#top")), F.lit("LA"), F.coalesce("ua", F.lit("-")), F.sha2("path", 256), F.lit("CN"),
        ).alias("value")
    )


def mixed_lines(requests: DataFrame) -> DataFrame:
    """Both formats by turns, with lines that hold no request: blank, rotation, bad time, other text."""
    bad = F.when(F.col("status") == 503, F.lit("2025-09-25T20:00:00 host newsyslog[1]: logfile turned over")).when(F.col("status") == 404, F.lit("no request")).otherwise(F.lit("  "))
    broken = requests.filter("ua is null").select(F.concat("ip", F.lit(' - - [31/Feb/2025:00:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "-"')).alias("value"))
    return (
        combined_lines(requests.filter(F.second("ts") % 2 == 0)).unionByName(cdn_lines(requests.filter(F.second("ts") % 2 == 1)))
        .unionByName(requests.filter(F.second("ts") == 0).select(bad.alias("value"))).unionByName(broken)
    )

"""Reports on decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.sources.scratch import materialise


def in_order(decisions: DataFrame) -> DataFrame:
    """By window, then networks, addresses and agents, then first appearance."""
    rank = F.when(F.col("entity_type") == "cidr", 0).when(F.col("entity_type") == "ip", 1).when(F.col("entity_type") == "ua", 2).otherwise(3)
    return decisions.orderBy("w", rank, "first_seen", "entity_value")


def with_places(ordered: DataFrame) -> DataFrame:
    """Add place, from 0 without gaps, to rows that an orderBy has range-sorted; no task sees another's rows.

    Rows of each partition are counted, and the counts of those before it, one number a partition, give its start.
    """
    rows = materialise(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__at")) - 1
    return rows.join(F.broadcast(starts), "__part").withColumn("place", (F.col("__start") + own).cast("long")).drop("__part", "__at", "__start")


def top_offenders(decisions: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` entities of each type by best score, with the explanation of their first best window."""
    stats = decisions.groupBy("entity_type", "entity_value").agg(
        F.max("score").alias("max_score"), F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("num_windows"), F.max("duration_sec").alias("max_duration"),
        F.max_by("explanation", F.struct("score", -F.col("w"))).alias("explanation"), F.min("w").alias("first_w"),
    )
    order = Window.partitionBy("entity_type").orderBy(F.col("max_score").desc(), "first_w", "entity_value")
    return stats.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)

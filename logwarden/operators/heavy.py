"""The most frequent values of each key, exactly, when a key may have millions of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.sources.scratch import materialise

#: Sums by hash that bound the values of a key.
BUCKETS = 256


def _ranked(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """Add rank and keep those up to ``most``; tasks keep no more than that of a key before rows move."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)


def top_values(rows: DataFrame, keys: tuple[str, ...], value: str, weight: str, most: int, buckets: int = BUCKETS) -> DataFrame:
    """(keys, value, weight, total, rank): the ``most`` values of each key by summed weight, ties by value.

    ``total`` is the key's whole weight, so what the others hold is known as well. Values are summed
    by hash first, a bounded number of sums a key. The heaviest of these are counted by value, and the
    least of the best found there is a bound: a value that beats it lies in a sum of at least that
    much. Only values in such sums are then counted and ranked, so of a key with few heavy values
    among millions of light ones hardly any move; where no value stands out, all do. Weights are
    whole numbers of 0 or more; null values are left out. ``rows`` is read three times: store it.
    """
    key = list(keys)
    rows = rows.select(*key, F.col(value).alias("value"), F.col(weight).alias("weight")).filter("value is not null").withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    sums = materialise(rows.groupBy(*key, "bucket").agg(F.sum("weight").alias("held")), "bucket-sums")
    totals = sums.groupBy(*key).agg(F.sum("held").alias("total"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*key, "bucket"]]

    def counted(within: DataFrame) -> DataFrame:
        inside = rows.alias("r").join(within.select(*key, "bucket").alias("b"), same("r", "b"), "left_semi")
        return _ranked(inside.groupBy(*key, "value").agg(F.sum("weight").alias("weight")), key, [F.col("weight").desc(), "value"], most)

    first = materialise(counted(_ranked(sums, key, [F.col("held").desc(), "bucket"], most)), "first-candidates")
    bound = first.filter(F.col("rank") == most).select(*key, F.col("weight").alias("least"))
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}")) for k in key]
    open_ = sums.alias("s").join(bound.alias("l"), on, "left").filter(F.col("held") >= F.coalesce("least", F.lit(0))).select(*[F.col(f"s.{k}").alias(k) for k in key], "bucket")
    best, whole = counted(open_).alias("c"), totals.alias("t")
    met = best.join(whole, [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in key])
    return met.select(*[F.col(f"c.{k}").alias(k) for k in key], F.col("c.value").alias(value), F.col("c.weight").alias(weight), "total", "rank")

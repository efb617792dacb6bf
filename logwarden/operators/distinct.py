"""Distinct clients that can be merged: stored once by window, they give the counts of any longer window or larger group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions import network

#: Addresses of a /24 are the bits of four numbers.
MASKS = tuple(f"m{k}" for k in range(4))
#: The relative standard error of a sketch of 2 to the LG registers is about 1.04 / sqrt(2 ** LG).
LG = 12


def host_masks(rows: DataFrame, keys: tuple[str, ...], ip: str = "ip") -> DataFrame:
    """(keys, net, m0 .. m3): the IPv4 addresses of each group, exactly, as a bit for each address of each /24.

    A group has 32 bytes for each /24 that it meets, however many requests there are. Other
    addresses are left out; client_sketches() counts them.
    """
    parts = F.split(ip, r"\.")
    last = parts[3].cast("int")
    net = network.ipv4_network(F.col(ip), 24)
    bit = F.expr("shiftleft(1L, __last & 63)")
    rows = rows.filter(network.is_ipv4(F.col(ip))).select(*keys, net.alias("net"), last.alias("__last")).withColumn("__bit", bit)
    return rows.groupBy(*keys, "net").agg(*[F.bit_or(F.when(F.floor(F.col("__last") / 64) == k, F.col("__bit")).otherwise(F.lit(0).cast("long"))).alias(m) for k, m in enumerate(MASKS)])


def merged_masks(masks: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """host_masks() of larger groups: keys gives each by name, such as an hour for windows."""
    return masks.select(*[c.alias(n) for n, c in keys.items()], "net", *MASKS).groupBy(*keys, "net").agg(*[F.bit_or(m).alias(m) for m in MASKS])


def address_counts(masks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, addresses, networks) of host_masks(): distinct addresses and distinct /24."""
    own = sum((F.bit_count(m) for m in MASKS), F.lit(0))
    return masks.groupBy(*keys).agg(F.sum(own).cast("long").alias("addresses"), F.count(F.lit(1)).alias("networks"))


def client_sketches(rows: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """(keys, sketch_<value>): HyperLogLog sketches of the distinct values of columns of text, nulls left out."""
    return rows.groupBy(*keys).agg(*[F.hll_sketch_agg(v, LG).alias(f"sketch_{v}") for v in values])


def merged_sketches(sketches: DataFrame, keys: dict[str, Column], values: tuple[str, ...]) -> DataFrame:
    """client_sketches() of larger groups; requests are not read again."""
    return sketches.select(*[c.alias(n) for n, c in keys.items()], *[f"sketch_{v}" for v in values]).groupBy(*keys).agg(*[F.hll_union_agg(f"sketch_{v}").alias(f"sketch_{v}") for v in values])


def sketch_counts(sketches: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """(keys, about_<value>): estimates of the distinct values."""
    return sketches.select(*keys, *[F.hll_sketch_estimate(f"sketch_{v}").alias(f"about_{v}") for v in values])

"""Networks of several lengths in one pass, rolled up along the tree of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions import network
from logwarden.sources.scratch import materialise

#: Prefix lengths from the address up: of IPv4, and of IPv6.
IPV4, IPV6 = (32, 24, 16, 8), (128, 64, 48, 32)


def network_levels(grain: DataFrame, share: float = 0.1, ipv4: tuple[int, ...] = IPV4, ipv6: tuple[int, ...] = IPV6) -> DataFrame:
    """(w, level, network, n, errors, ips, rest, heavy) of every window and network of these lengths.

    grain: w, ip, status_class, n. Level 0 are the longest prefixes; each level is added up from the
    one below it, so requests are only read once and every step is over fewer rows. ``ips`` counts
    distinct addresses, which are those of the networks below. A network is ``heavy`` if, without
    the heavy networks below it, it still holds ``share`` of its window's requests (``rest``): so a
    busy address is named by itself, and its network only if there is more to it. IPv4 and IPv6 have
    the same number of levels; texts that are no addresses are networks of themselves.
    """
    if len(ipv4) != len(ipv6) or any(a < b for x in (ipv4, ipv6) for a, b in zip(x, x[1:], strict=False)):
        raise ValueError("as many lengths of either kind, from long to short")
    error = F.when(F.col("status_class").isin("4xx", "5xx"), F.col("n")).otherwise(0)
    addresses = grain.groupBy("w", "ip").agg(F.sum("n").alias("n"), F.sum(error).alias("errors"))
    addresses = materialise(addresses, "addresses")
    totals = addresses.groupBy("w").agg(F.sum("n").alias("window_n"))
    rows = addresses.select("w", F.col("ip").alias("member"), "n", "errors", F.lit(1).cast("long").alias("ips"), F.col("n").alias("rest"))
    out = None
    for k, (v4, v6) in enumerate(zip(ipv4, ipv6, strict=True)):
        # any member stands for its network, as lengths only get shorter
        level = rows.groupBy("w", network.network_of(F.col("member"), v4, v6).alias("network")).agg(
            F.min("member").alias("member"), F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.sum("ips").alias("ips"), F.sum("rest").alias("rest")
        )
        level = level.join(totals, "w").withColumn("heavy", F.col("rest") >= F.lit(share) * F.col("window_n")).withColumn("level", F.lit(k))
        level = materialise(level, "networks")
        out = level if out is None else out.unionByName(level)
        rows = level.select("w", "member", "n", "errors", "ips", F.when(F.col("heavy"), 0).otherwise(F.col("rest")).alias("rest"))
    return out.select("w", "level", "network", "n", "errors", "ips", "rest", "heavy")

"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import materialise, release


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (u, v), u > v. Each node hands its larger (or, small: smaller) neighbours its least one."""
    if small:
        near = edges
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = near.join(least, "u")
    if small:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that some link names; a component is its smallest node.

    Links are undirected; nulls and self-links are ignored. Each round is a few joins on the node,
    whose hot side adaptive execution can split; rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder, so nothing is kept on one executor, and the
    round before it is deleted.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = materialise(links.filter(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u > v").distinct(), "links")
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
    seen = print_of(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        before, edges = edges, materialise(_star(_star(edges, small=False), small=True), "links")
        release(before)
        now = print_of(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

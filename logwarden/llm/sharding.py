"""Sharding by minimax contiguous partition of ordered groups, in DataFrame expressions.

Equal texts are one atomic group. Groups are ordered by a hash of the text and cut into contiguous
shards so that the fullest shard is as small as can be: the smallest feasible capacity is found by
search over capacities, each checked by filling shards greedily along the running sum of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import ROW, UNIT_ROWS, leading_bits, materialise, null_safe, running_sums, unit_bits, with_rows

#: Capacities checked side by side in each round of the search.
PROBES = 15


def greedy_cuts(groups: DataFrame, capacities: list[int], shards: int) -> dict[int, list[int]]:
    """For each capacity the running sums at which greedily filled shards end.

    One aggregate a shard looks up, for all capacities at once, the last group that still fits;
    the driver holds one number a capacity and shard.
    """
    ends: dict[int, list[int]] = {c: [] for c in capacities}
    for _ in range(shards):
        limits = {c: (e[-1] if e else 0) + c for c, e in ends.items()}
        row = groups.agg(*[F.max(F.when(F.col("through") <= x, F.col("through"))).alias(f"c{n}") for n, x in enumerate(limits.values())]).first()
        for c, at in zip(limits, row, strict=True):
            ends[c].append(at or 0)
    return ends


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that fills no more than ``shards`` shards, and the running sums at its cuts.

    groups: (size, through), through being the running sum of sizes with the group's own.
    """
    total, largest = groups.agg(F.max("through"), F.max("size")).first()
    if not total:
        return 0, []
    low = max(-(-total // shards), largest)
    high, best = -(-total // shards) + largest, None
    while best is None or low < high:
        step = max(1, (high - low + PROBES) // (PROBES + 1))
        tried = sorted({min(high, low + step * k) for k in range(PROBES)} | ({high} if best is None else set()))
        found = greedy_cuts(groups, tried, shards)
        for c in tried:
            if found[c][-1] >= total:
                high, best = c, found[c]
                break
            low = c + 1
    return high, best[:-1]


def _measures() -> list[Column]:
    """A row's size, checksum and hash, which equal texts share."""
    return [
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("group"),
    ]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1. The law is ``bytes``: shards are as equal in size as
    whole groups of equal texts allow, in the order of the text's hash. Slots run from 0 without
    gaps in each shard, dealt over units by doc_id so that a large group is not one task.

    A null text has no bytes, is a group with other null texts and has the checksum of no bytes.
    Repeated rows get slots of their own. Some shards stay empty where there are fewer groups; an
    empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    rows = materialise(docs.select("doc_id", *_measures()), "shard-rows")
    n = rows.count()
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    groups = running_sums(groups, [], leading_bits(F.col("group"), unit_bits(n)), [F.col("group")], {"start": F.col("size")})
    groups = materialise(groups.select("group", "size", (F.col("start") + F.col("size")).alias("through")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    cuts = [c for c in cuts if c]
    at = {r["through"]: r["group"] for r in groups.filter(F.col("through").isin(cuts)).select("through", "group").collect()} if cuts else {}
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("group") > at[c]).cast("int")
    placed = rows.withColumn("shard", number.cast("int"))
    unit = leading_bits(F.xxhash64("doc_id", "group"), unit_bits(n))
    placed = running_sums(placed, ["shard"], unit, [F.col("group"), F.col("doc_id"), F.col("size")], {"slot": F.lit(1)})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write every row of the documents as one folder a shard, each in the order of its slots.

    placed: shard() of the same documents. Rows meet places by doc_id (null too), size and checksum;
    where several share these, the one takes the n-th place in the order of the text's hash, in
    which shards are cut.
    """
    rows, key = with_rows(docs)
    keys = ["doc_id", "size", "text_crc32"]
    own = materialise(rows.select(F.col(key).alias(ROW), "doc_id", *_measures()), "shard-keys")
    bits = unit_bits(own.count())
    places = materialise(placed.select(*keys, "shard", "slot"), "shard-places")
    own = running_sums(own, keys, F.struct("group", leading_bits(F.xxhash64(ROW), bits).alias("part")), [F.col(ROW)], {"__nth": F.lit(1)})
    places = running_sums(places, keys, F.struct("shard", F.floor(F.col("slot") / UNIT_ROWS).alias("part")), [F.col("slot")], {"__nth": F.lit(1)})
    where = null_safe(own, places, [*keys, "__nth"]).select(ROW, "shard", "slot")
    if {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError("documents have columns named shard or slot, as the folders and their order have")
    rows.join(where.withColumnRenamed(ROW, key), key).drop(key).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Metrics per entity (address, user agent, network) and window.

Requests are first counted by window, address, agent, referrer, path, verb and status class; only
those counts are dealt out to the entity types, so a user agent with half the log moves as its
distinct combinations, not as its requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULT, DetectConfig
from logwarden.functions import network, scoring
from logwarden.functions.parsing import deepest_depth
from logwarden.sources.scratch import materialise

TYPES = ("ip", "ua", "cidr")
KEY = ["entity_type", "entity_value", "w"]
SPAN = ("window_start", "window_end")
STATUS = ("2xx", "3xx", "4xx", "5xx")


def add_network(requests: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """Add cidr, by expressions."""
    return requests.withColumn("cidr", network.network_of(F.col("ip"), cfg.ipv4_prefix, cfg.ipv6_prefix))


def request_grain(windowed: DataFrame) -> DataFrame:
    """Counts by window, address, agent, referrer, path, verb and status class."""
    # a window's bounds go with its number
    spans = [F.min(c).alias(c) for c in SPAN]
    return windowed.groupBy("w", "ip", "ua", "ref", "path", "verb", "status_class").agg(*spans, F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def window_totals(grain: DataFrame) -> DataFrame:
    """(w, window_requests); one row a window."""
    return grain.groupBy("w").agg(F.sum("n").alias("window_requests"))


def by_entity(grain: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """A row per entity type of each count; rows without a value (no user agent) are left out here."""
    pairs = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(t).alias("entity_value")) for t in types])
    out = grain.withColumn("__e", F.explode(pairs)).select("*", "__e.entity_type", "__e.entity_value").drop("__e")
    return out.filter(F.col("entity_value").isNotNull())


def path_grain(entities: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """Counts by entity, window and path, with the path's deepest depth."""
    status = [F.sum(F.when(F.col("status_class") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in STATUS]
    out = entities.groupBy(*KEY, "path").agg(
        *[F.min(c).alias(c) for c in SPAN], F.sum("n").alias("n"), *status, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    return out.withColumn("depth", deepest_depth(F.col("path"), cfg.depths))


def _opens(text: str, last: str, depth: int) -> Column:
    """1 where a text begins another prefix of that depth than the one sorted before it."""
    begins = F.coalesce(F.substring(last, 1, depth) != F.substring(text, 1, depth), F.lit(True))
    return (F.coalesce(F.length(text) >= depth, F.lit(False)) & begins).cast("long")


def _parted(rows: DataFrame, cfg: DetectConfig) -> tuple[DataFrame, DataFrame]:
    """Rows of entities whose prefixes count, and those of others: networks, in the reference."""
    own = F.col("entity_type") != "cidr" if cfg.cidr_depth == "reference" else F.lit(True)
    return rows.filter(own), rows.filter(~own)


def _stem_length(cfg: DetectConfig) -> int:
    depths = sorted(cfg.depths)
    return max(depths[(len(depths) - 1) // 2] if depths else 0, cfg.new_depth)


def path_stems(paths: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """Per entity, window and common beginning of paths (stem): sums, the top path, and distinct prefixes longer than it.

    Texts with a common beginning follow each other when sorted, so a path opens a new prefix exactly
    where its first characters differ from its predecessor's. Paths are sorted within their stem, so
    that an entity with half the log is dealt out by it. A stem is as long as new content is judged by, at
    least. Networks without prefixes are only added up.
    """
    depths, split = sorted(cfg.depths), _stem_length(cfg)
    long = [d for d in depths if d > split]
    counts = ["n", *[f"n_{s}" for s in STATUS], "depth_sum"]

    def summed(rows: DataFrame, by: list[str], opens: list[Column]) -> DataFrame:
        return rows.groupBy(*by).agg(
            *[F.min(c).alias(c) for c in SPAN], *[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("paths"), F.max("n").alias("top_n"),
            F.max(F.struct("n", "path")).alias("top"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *opens,
        )

    rows = paths.withColumn("stem", F.substring("path", 1, split)).withColumn("depth_sum", F.col("depth") * F.col("n"))
    own, others = _parted(rows, cfg)
    # a hash in front of the sort keys: few comparisons go on to the texts
    by = ["__key", *KEY, "stem"]
    own = own.withColumn("__key", F.xxhash64(*KEY, "stem"))
    own = own.withColumn("__last", F.lag("path").over(Window.partitionBy(*by).orderBy("path")))
    made = summed(own, by, [F.sum(_opens("path", "__last", d)).alias(f"opens_{d}") for d in long]).drop("__key")
    return made.unionByName(summed(others.withColumn("depth_sum", F.lit(0)), [*KEY, "stem"], [F.lit(0).cast("long").alias(f"opens_{d}") for d in long]))


def stem_metrics(stems: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """Per entity and window of path_stems(): sums over its paths, the top path, and distinct prefixes of every depth.

    Stems, one row each, are sorted within the entity. The top path itself is left out if ``top`` is.
    """
    depths, split = sorted(cfg.depths), _stem_length(cfg)
    short = [d for d in depths if d <= split]
    own, others = _parted(stems, cfg)

    def summed(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(
            *[F.min(c).alias(c) for c in SPAN], F.sum("n").alias("total_requests"), (F.sum("n_4xx") + F.sum("n_5xx")).alias("error_count"), *[F.sum(f"n_{s}").alias(f"status_{s}") for s in STATUS],
            F.sum("paths").alias("unique_paths"), F.max("top_n").alias("top_path_count"), *([F.max("top").alias("top")] if "top" in rows.columns else []), F.sum("depth_sum").alias("depth_sum"),
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *[F.sum(f"opens_{d}").alias(f"uniq_prefix_{d}") for d in cfg.depths],
        )

    by = ["__key", *KEY]
    own = own.withColumn("__key", F.xxhash64(*KEY)).withColumn("__last", F.lag("stem").over(Window.partitionBy(*by).orderBy("stem")))
    own = own.withColumns({f"opens_{d}": _opens("stem", "__last", d) for d in short})
    others = others.withColumns({f"opens_{d}": F.lit(0).cast("long") for d in short})
    out = summed(own, by).drop("__key").unionByName(summed(others, KEY))
    return out.withColumn("top_path", F.col("top.path")).drop("top") if "top" in out.columns else out


def path_metrics(paths: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """stem_metrics() of a path_grain()."""
    return stem_metrics(path_stems(paths, cfg), cfg)


#: What is counted of an entity besides its paths, and of which entity types.
SIDES = {"ua": ("ip", "cidr"), "ip": ("ua", "cidr"), "ref": None, "verb": None}


def method_counts(entities: DataFrame) -> DataFrame:
    """(entity_type, entity_value, w, verb, n): requests by verb as rows, however many verbs a client makes up."""
    return entities.filter("verb is not null").groupBy(*KEY, "verb").agg(F.sum("n").alias("n"))


def _sides(kind: Column, sides: list[str]) -> Column:
    """An array of (side, value) of what is counted of a row's entity type."""
    value = lambda s: F.col(s) if SIDES[s] is None else F.when(kind.isin(*SIDES[s]), F.col(s))
    return F.filter(F.array(*[F.struct(F.lit(s).alias("side"), value(s).alias("value")) for s in sides]), lambda x: x["value"].isNotNull())


def side_counts(grain: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Per entity and window: distinct agents, addresses and referrers.

    Who came with which agent is reduced to distinct pairs before the entity types multiply it.
    """
    columns = [*KEY, "side", "value"]
    met = [by_entity(grain.select("w", *[F.col(t) for t in dict.fromkeys((*types, "ref"))]).filter("ref is not null"), types).select(*KEY, F.lit("ref").alias("side"), F.col("ref").alias("value"))]
    clients = tuple(t for t in types if any(t in (SIDES[s] or ()) for s in ("ua", "ip")))
    if clients:
        pairs = by_entity(grain.select("w", *dict.fromkeys((*clients, "ip", "ua"))).distinct(), clients)
        met.append(pairs.select(*KEY, F.explode(_sides(F.col("entity_type"), ["ua", "ip"])).alias("__s")).select(*KEY, "__s.*"))
    every = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    return every.select(*columns).distinct().groupBy(*KEY).agg(*[F.count(F.when(F.col("side") == s, 1)).alias(f"unique_{s}s") for s in ("ua", "ip", "ref")])


def side_metrics(entities: DataFrame, approximate: bool = False) -> DataFrame:
    """Per entity and window: distinct agents, addresses and referrers, and requests by verb, in one pass."""
    kind, is_side = F.col("entity_type"), lambda s: F.col("side") == s
    counted = entities.select(*KEY, "n", F.explode(_sides(kind, [*SIDES])).alias("__s")).groupBy(*KEY, "__s.side", "__s.value").agg(F.sum("n").alias("n"))
    verbs = F.map_from_entries(F.sort_array(F.collect_list(F.when(is_side("verb"), F.struct(F.col("value").alias("verb"), "n")))))
    if not approximate:
        distinct = [F.count(F.when(is_side(s), 1)).alias(f"unique_{s}s") for s in ("ua", "ip", "ref")]
        return counted.groupBy(*KEY).agg(*distinct, verbs.alias("methods"))
    own = method_counts(entities).withColumns({"side": F.lit("verb"), "value": F.col("verb")})
    return about_sides(entities).join(own.groupBy(*KEY).agg(verbs.alias("methods")), KEY, "left")


def about_sides(entities: DataFrame) -> DataFrame:
    """Per entity and window: estimates of distinct agents, addresses and referrers."""
    value = lambda s: F.col(s) if SIDES[s] is None else F.when(F.col("entity_type").isin(*SIDES[s]), F.col(s))
    return entities.groupBy(*KEY).agg(*[F.approx_count_distinct(value(s)).alias(f"unique_{s}s") for s in ("ua", "ip", "ref")])


def entity_metrics(grain: DataFrame, cfg: DetectConfig = DEFAULT, types: tuple[str, ...] = TYPES, approximate: bool = False, stems: DataFrame | None = None, methods: bool = True) -> DataFrame:
    """One row per entity and window; see FIXTURES.md for the columns.

    grain: see request_grain(). With ``approximate`` the distinct agents, addresses and referrers are
    HyperLogLog estimates, for logs whose exact sets are too many to shuffle; paths and their
    prefixes are exact. stems: path_stems() of these types, if it is stored already. ``methods`` is one
    map an entity: the jobs do without it, as method_counts() has the same as rows.
    """
    entities = by_entity(grain, types)
    stems = materialise(path_stems(path_grain(entities, cfg), cfg), "stems") if stems is None else stems
    sides = side_metrics(entities, approximate) if methods else about_sides(entities) if approximate else side_counts(grain, types)
    # a client may have no agent, no referrer and no verb
    out = stem_metrics(stems, cfg).join(sides, KEY, "left").fillna(0, [f"unique_{s}s" for s in ("ua", "ip", "ref")])
    total = F.col("total_requests")
    return out.withColumns(
        {
            "error_rate": F.col("error_count") / total, "explore_ratio": F.col("unique_paths") / total, "path_concentration": 1 - F.col("unique_paths") / total,
            "top_path_ratio": F.col("top_path_count") / total, "redirect_rate": F.col("status_3xx") / total, "depth_score": F.col("depth_sum") / total,
            **{f"fanout_{d}": F.col(f"uniq_prefix_{d}") / total for d in cfg.depths},
        }
    ).drop("depth_sum")


def status_report(metrics: DataFrame, entity_type: str, w: int | None = None) -> DataFrame:
    """Metrics of one entity type, and window if given, with the status counts nested."""
    rows = metrics.filter(F.col("entity_type") == entity_type)
    rows = rows if w is None else rows.filter(F.col("w") == w)
    nested = F.struct(*[F.col(f"status_{s}").alias(f"s{s}") for s in STATUS])
    return rows.select(*KEY, "total_requests", "error_rate", "explore_ratio", nested.alias("status_distribution"))


def entity_windows(metrics: DataFrame) -> DataFrame:
    """(entity_type, entity_value, windows, first_w, last_w): where each entity appears."""
    return metrics.groupBy("entity_type", "entity_value").agg(F.count_distinct("w").alias("windows"), F.min("w").alias("first_w"), F.max("w").alias("last_w"))


def networks_hammering(grain: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """Networks with over 35 of dominance and 25 of hammering in a window: needs no baseline and no state."""
    entities = by_entity(grain, ("cidr",))
    rows = path_grain(entities, cfg).groupBy(*KEY).agg(F.sum("n").alias("total_requests"), F.count(F.lit(1)).alias("unique_paths"), F.max("n").alias("top_path_count"))
    totals = window_totals(grain)
    rows = rows.join(totals, "w")
    share, top = F.col("total_requests") / F.col("window_requests"), F.col("top_path_count") / F.col("total_requests")
    concentration = 1 - F.col("unique_paths") / F.col("total_requests")
    out = rows.withColumn("dominance", scoring.dominance_signal(share, cfg)).withColumn("hammer", scoring.hammer_signal(F.col("total_requests"), top, concentration, share, cfg))
    return out.filter("dominance > 35 and hammer > 25").select("w", "entity_value", "total_requests", "window_requests", "dominance", "hammer")


"""URL-prefix analytics: hits, distinct clients, status and first sight of every prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULT, DetectConfig
from logwarden.functions.parsing import is_error, prefix_at, prefixes
from logwarden.sources.scratch import broadcast_if_small

#: Windows of new prefixes that are broadcast at most.
MANY = 200_000


def explode_prefixes(requests: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """A row per depth that a request's path reaches: depth, prefix."""
    return requests.withColumn("__p", F.explode(prefixes(F.col("path"), cfg.depths))).select("*", "__p.depth", "__p.prefix").drop("__p")


def prefix_stats(requests: DataFrame, cfg: DetectConfig = DEFAULT, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per prefix (and keys): hits, unique_ips, unique_uas, status_dist, error_rate, tofs.

    Requests are counted by path and client before the seven depths multiply them.
    """
    by = [*keys, "depth", "prefix"]
    counted = requests.groupBy(*keys, "path", "ip", "ua", "status_class").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"))
    rows = explode_prefixes(counted, cfg)
    sums = rows.groupBy(*by).agg(F.sum("n").alias("hits"), F.sum(F.when(is_error(F.col("status_class")), F.col("n")).otherwise(0)).alias("errors"), F.min("ts").alias("tofs"))
    distinct = rows.groupBy(*by).agg(F.count_distinct("ip").alias("unique_ips"), F.count_distinct("ua").alias("unique_uas"))
    status = rows.groupBy(*by, "status_class").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status_class", "n")))).alias("status_dist"))
    return sums.join(distinct, by).join(status, by).withColumn("error_rate", F.col("errors") / F.col("hits"))


def prefix_lookup(wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """(depth, prefix) with what is known of it; nothing known is no tofs and zeros."""
    found = wanted.join(stats.select("depth", "prefix", "hits", "unique_ips", "unique_uas", "error_rate", "tofs"), ["depth", "prefix"], "left")
    return found.fillna(0, ["hits", "unique_ips", "unique_uas"]).fillna(0.0, ["error_rate"])


def prefixes_at_depth(stats: DataFrame) -> DataFrame:
    return stats.groupBy("depth").agg(F.count(F.lit(1)).alias("n_prefixes"), F.sum("hits").alias("hits"))


def prefix_clients(grain: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """(prefix, ip, w): hits, errors and first sight of prefixes of the depth that new content is judged by."""
    rows = grain.withColumn("prefix", prefix_at(F.col("path"), cfg.new_depth)).filter(F.col("prefix").isNotNull())
    return rows.groupBy("prefix", "ip", "w").agg(
        F.sum("n").alias("n"), F.sum(F.when(is_error(F.col("status_class")), F.col("n")).otherwise(0)).alias("errors"), F.min("first_seen").alias("ts")
    )


def prefix_windows(clients: DataFrame, new_clients: DataFrame | None = None) -> DataFrame:
    """(prefix, w, n, errors, ts, new_ips): an address is new in the window of its first hit on the prefix.

    new_clients: (prefix, w, new_ips), if earlier windows are not among ``clients`` but known elsewhere.
    """
    if new_clients is None:
        new_clients = clients.groupBy("prefix", "ip").agg(F.min("w").alias("w")).groupBy("prefix", "w").agg(F.count(F.lit(1)).alias("new_ips"))
    per = clients.groupBy("prefix", "w").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.min("ts").alias("ts")).join(new_clients, ["prefix", "w"], "left")
    return per.select("prefix", "w", "n", "errors", "ts", F.coalesce("new_ips", F.lit(0)).cast("long").alias("new_ips"))


def running_state(per: DataFrame) -> DataFrame:
    """(w, prefix): first sight, and distinct addresses and error rate up to each window of prefix_windows()."""
    so_far = Window.partitionBy("prefix").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(
        "w", "prefix", F.min("ts").over(so_far).alias("tofs"), F.sum("new_ips").over(so_far).alias("unique_ips"), F.sum("n").over(so_far).alias("hits"), (F.sum("errors").over(so_far) / F.sum("n").over(so_far)).alias("error_rate")
    )


def prefix_state(grain: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """running_state() of a whole log."""
    return running_state(prefix_windows(prefix_clients(grain, cfg)))


def new_requests(paths: DataFrame, state: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """(entity_type, entity_value, w, new_requests): requests to new prefixes, of entities that have any.

    paths: counts by entity, window and path, or by common beginnings that are long enough. Prefixes
    that are not new are left out first, so that of the others' counts hardly any move.
    """
    likely = broadcast_if_small(state.filter((F.col("unique_ips") >= cfg.new_min_ips) & (F.col("error_rate") < cfg.new_max_error)).select("w", "prefix", "tofs"), "new-prefixes", MANY)
    rows = paths.select("entity_type", "entity_value", "w", "window_end", "n", prefix_at(F.col("path"), cfg.new_depth).alias("prefix")).filter(F.col("prefix").isNotNull())
    age = (F.unix_micros("window_end") - F.unix_micros("tofs")) / 60e6
    return rows.join(likely, ["w", "prefix"]).filter(age <= cfg.grace_minutes).groupBy("entity_type", "entity_value", "w").agg(F.sum("n").alias("new_requests"))


def new_share(total: str = "total_requests") -> Column:
    """30 times the share of new_requests()."""
    return 30.0 * F.coalesce("new_requests", F.lit(0)) / F.col(total)


def new_content(paths: DataFrame, state: DataFrame, totals: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """(entity_type, entity_value, w, d_new): 30 times the share of an entity's requests to new prefixes.

    paths: see new_requests(); totals: entity metrics with total_requests.
    """
    joined = totals.select("entity_type", "entity_value", "w", "total_requests").join(new_requests(paths, state, cfg), ["entity_type", "entity_value", "w"], "left")
    return joined.select("entity_type", "entity_value", "w", new_share().alias("d_new"))

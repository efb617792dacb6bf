"""Registered queries of the access-log library, with the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.config import DEFAULT
from logwarden.functions import network, parsing
from logwarden.jobs import derived, detect, oracle, replay, report
from logwarden.operators import baseline, distinct, entities, heavy, networks, persistence, prefixes, rates, windows
from logwarden.sources import logs
from logwarden.sources.scratch import materialise, new_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
KEY = entities.KEY


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(name: str) -> Column:
    return F.round(name, oracle.R).alias(name)


def _rs(*names: str) -> str:
    return ", ".join(f"round({n}, {oracle.R}) AS {n}" for n in names)


def _grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.grain_of(derived.requests(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.entity_metrics(_grain(spark, sf_dir), methods=False)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of addresses and agents by window."""
    return entities.by_entity(_grain(spark, sf_dir), ("ip", "ua")).groupBy(*KEY).agg(F.sum("n").alias("total_requests"))


# --- sources and parsing -----------------------------------------------------------------------


@query(oracle.sql([oracle.REQ], "SELECT ts, ip, verb, path, status, status_class, ref, ua, 'combined' AS fmt FROM r"))
def parse_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialise(derived.combined_lines(derived.requests(spark, sf_dir)), "lines")
    return logs.requests(logs.parse_lines(lines)).select("ts", "ip", "verb", "path", "status", "status_class", "ref", "ua", "fmt")


@query(oracle.sql([oracle.REQ], "SELECT ts, ip, 'GET' AS verb, path, status, ua, 'HIT' AS cache_status, 'LA' AS edge, 'CN' AS country, sha256(path) AS request_id FROM r"))
def parse_cdn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialise(derived.cdn_lines(derived.requests(spark, sf_dir)), "lines")
    extra = [F.col("extras")[n].alias(n) for n in ("cache_status", "edge", "country", "request_id")]
    return logs.requests(logs.parse_lines(lines, "cdn")).select("ts", "ip", "verb", "path", "status", "ua", *extra)


@query(
    oracle.sql(
        [oracle.REQ],
        """SELECT fmt, reject, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
             SELECT CASE WHEN sec % 2 = 0 THEN 'combined' ELSE 'cdn' END AS fmt, CAST(NULL AS VARCHAR) AS reject, ts FROM r
             UNION ALL SELECT NULL, CASE WHEN status = 503 THEN 'rotation' WHEN status = 404 THEN 'no match' ELSE 'blank' END, NULL FROM r WHERE sec % 60 = 0
             UNION ALL SELECT 'combined', 'bad timestamp', NULL FROM r WHERE ua IS NULL) GROUP BY fmt, reject""",
    )
)
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.load_report(logs.parse_lines(materialise(derived.mixed_lines(derived.requests(spark, sf_dir)), "lines")))


@query(r"""SELECT page_id, url, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '') AS p FROM pages)""")
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", parsing.url_path(F.col("url")).alias("path"))


@query(
    oracle.sql(
        [oracle.REQ],
        """SELECT DISTINCT ip, cidr, ip LIKE '%:%' AS is_v6,
             CASE WHEN ip LIKE '%:%' THEN '2a032880' || split_part(ip, ':', 3) || '000c' || '000000000000000' || split_part(ip, ':', 6)
                  ELSE lower(lpad(printf('%02x%02x%02x%02x', split_part(ip,'.',1)::INT, split_part(ip,'.',2)::INT, split_part(ip,'.',3)::INT, split_part(ip,'.',4)::INT), 32, '0')) END AS ip_hex FROM r""",
    )
)
def ip_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.ip_dimension(derived.requests(spark, sf_dir)).select(F.col("canonical").alias("ip"), "cidr", "is_v6", "ip_hex")


@query(
    oracle.sql(
        [oracle.REQ],
        """SELECT DISTINCT ip || CASE WHEN ip LIKE '%:%' THEN '/48' ELSE '/24' END AS network, cidr AS canonical FROM r
           UNION ALL SELECT DISTINCT split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2), split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) FROM r WHERE ip NOT LIKE '%:%'""",
    )
)
def canonical_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks written with host bits, and texts that are none, in canonical form."""
    ip = F.col("ip")
    six = F.contains(ip, F.lit(":"))
    rows = derived.requests(spark, sf_dir)
    nets = rows.select(F.concat(ip, F.when(six, "/48").otherwise("/24")).alias("cidr")).unionByName(rows.filter(~six).select(F.substring_index(ip, ".", 2).alias("cidr")))
    return network.network_base(nets).select(F.col("raw").alias("network"), "canonical")


@query(
    oracle.sql(
        [oracle.REQ],
        """SELECT f.name, f.fmt, count(r.sec) AS requests FROM (VALUES ('log=a', 'combined', 0), ('log=b', 'cdn', 1), ('log=c', 'combined', 2), ('log=d', 'cdn', 3)) f(name, fmt, k)
           LEFT JOIN r ON f.k < 2 AND r.sec % 2 = f.k GROUP BY ALL""",
    )
)
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats found by the heads of text files, and the requests that files yield when read in their format.

    Two folders hold a log each, one in each format, that begins with blank lines; two hold lines
    that are no requests, the last of them after one line that is in the CDN format but for its time.
    """
    path = new_folder(spark, "logs")
    rows = derived.requests(spark, sf_dir).withColumn("sec", F.unix_seconds("ts") - derived.BASE)
    other = rows.filter("sec = 0").select(F.lit("no request").alias("value"))
    blank = lambda n: F.concat(F.lit("\n" * n), F.col("value")).alias("value")
    derived.combined_lines(rows.filter("sec % 2 = 0")).select(blank(1)).write.text(f"{path}/log=a")
    derived.cdn_lines(rows.filter("sec % 2 = 1")).select(blank(2)).write.text(f"{path}/log=b")
    other.write.text(f"{path}/log=c")
    other.limit(1).select(F.lit("HIT|200|99999999999999999999|1|1|1.1.1.1|-|/|LA|x|y|CN").alias("value")).write.text(f"{path}/log=d")
    lines = logs.read_lines(spark, f"{path}/log=*")
    name = F.regexp_extract("file", "(log=[a-d])", 1).alias("name")
    found = logs.detect_formats(lines)
    per = found.groupBy(name, "fmt").agg(F.count(F.lit(1)).alias("files")).drop("files")
    good = logs.parse_lines(lines.join(F.broadcast(found), "file")).filter("reject is null").groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return per.join(good, "name", "left").select("name", "fmt", F.coalesce("n", F.lit(0)).cast("long").alias("requests"))


@query(
    oracle.sql(
        [oracle.REQ, "d AS (SELECT unnest([2, 4, 6, 8, 16, 32, 64]) AS depth)"],
        f"SELECT depth, substr(path, 1, depth) AS prefix, {oracle._deepest('path')} AS deepest, count(*) AS n FROM r, d WHERE length(path) >= depth GROUP BY ALL",
    )
)
def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.requests(spark, sf_dir).withColumn("deepest", parsing.deepest_depth(F.col("path"), DEFAULT.depths))
    return prefixes.explode_prefixes(rows).groupBy("depth", "prefix", "deepest").agg(F.count(F.lit(1)).alias("n"))


# --- windows and entities ----------------------------------------------------------------------


@query(oracle.sql([oracle.REQ], "SELECT w, window_requests, t0 + w * INTERVAL 300 SECOND AS window_start FROM tot, span"))
def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assign_windows(derived.requests(spark, sf_dir)).groupBy("w", "window_start").agg(F.count(F.lit(1)).alias("window_requests"))


@query(
    oracle.sql(
        [oracle.REQ, "sz AS (SELECT unnest([60, 300, 3600]) AS size)"],
        "SELECT size, w, count(*) AS n FROM (SELECT size, CAST(epoch(ts - t0) AS BIGINT) // size AS w, ts, t0, t_max FROM r, span, sz) WHERE t0 + (w * size) * INTERVAL 1 SECOND < t_max GROUP BY ALL",
    )
)
def window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.requests(spark, sf_dir).select("ts")
    per = [windows.assign_windows(rows, size).groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.lit(size)) for size in (60, 300, 3600)]
    return per[0].unionByName(per[1]).unionByName(per[2])


@query(oracle.sql([oracle.REQ], "SELECT count(*) AS n, count(DISTINCT ip) AS ips, min(ts) AS first_ts, max(ts) AS last_ts FROM r, span WHERE ts <= t0 + INTERVAL 1 HOUR"))
def training_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.training_window(derived.requests(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ip").alias("ips"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_COUNTS = ["total_requests", "error_count", "status_2xx", "status_3xx", "status_4xx", "status_5xx", "unique_paths", "unique_uas", "unique_ips", "top_path_count", "top_path", *[f"uniq_prefix_{d}" for d in DEFAULT.depths], "first_seen", "last_seen"]
_RATIOS = ["error_rate", "explore_ratio", "path_concentration", "top_path_ratio", "redirect_rate", "depth_score", *[f"fanout_{d}" for d in DEFAULT.depths]]


@query(oracle.sql([oracle.REQ, oracle.METRICS], f"SELECT entity_type, entity_value, w, {', '.join(_COUNTS)}, unique_refs, {_rs(*_RATIOS)} FROM m"))
def entity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select(*KEY, *_COUNTS, "unique_refs", *[_r(n) for n in _RATIOS])


@query(oracle.sql([oracle.REQ], "SELECT entity_type, entity_value, w, verb, count(*) AS n FROM ent GROUP BY ALL"))
def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.method_counts(entities.by_entity(_grain(spark, sf_dir)))


@query(oracle.sql([oracle.REQ, oracle.METRICS], f"SELECT entity_type, entity_value, w, total_requests, status_2xx AS s2xx, status_3xx AS s3xx, status_4xx AS s4xx, status_5xx AS s5xx, {_rs('error_rate', 'explore_ratio')} FROM m WHERE entity_type = 'cidr'"))
def network_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.status_report(_metrics(spark, sf_dir), "cidr")
    return rows.select(*KEY, "total_requests", *[F.col(f"status_distribution.s{s}").alias(f"s{s}") for s in entities.STATUS], _r("error_rate"), _r("explore_ratio"))


@query(oracle.sql([oracle.REQ], "SELECT entity_type, entity_value, count(DISTINCT w) AS windows, min(w) AS first_w, max(w) AS last_w FROM ent GROUP BY ALL"))
def entity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.entity_windows(entities.by_entity(_grain(spark, sf_dir)))


@query(
    oracle.sql(
        [oracle.REQ, oracle.METRICS, "x AS (SELECT m.*, window_requests, total_requests / window_requests AS share FROM m JOIN tot USING (w) WHERE entity_type = 'cidr')"],
        f"""SELECT w, entity_value, total_requests, window_requests, {_rs('dominance', 'hammer')} FROM (SELECT *, CASE WHEN share < 0.30 THEN 0.0 ELSE 100 * greatest(0.0, least(1.0, (share - 0.30) / 0.30)) END AS dominance,
            CASE WHEN share >= 0.30 AND total_requests >= 50 THEN CASE WHEN path_concentration >= 0.99 THEN 100 * greatest(0.0, least(1.0, (path_concentration - 0.99) / 0.01)) ELSE 100 * greatest(0.0, least(1.0, (top_path_ratio - 0.30) / 0.40)) END
                 WHEN total_requests < 50 THEN 0.0 ELSE 100 * greatest(0.0, least(1.0, (top_path_ratio - 0.5) / 0.4)) END AS hammer FROM x) WHERE dominance > 35 AND hammer > 25""",
    )
)
def networks_hammering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.networks_hammering(_grain(spark, sf_dir), replace(DEFAULT, n_hammer_min=50))
    return rows.select("w", "entity_value", "total_requests", "window_requests", _r("dominance"), _r("hammer"))


@query(
    oracle.sql(
        [oracle.REQ, "e AS (SELECT 'all' AS entity_type, 'all' AS entity_value, w, ip FROM win UNION ALL SELECT entity_type, entity_value, w, ip FROM ent WHERE entity_type IN ('ua', 'cidr'))"],
        "SELECT entity_type, entity_value, w // 12 AS hour, count(DISTINCT ip) AS addresses, count(DISTINCT regexp_extract(ip, '^(.*)[.]', 1)) AS networks FROM e WHERE ip NOT LIKE '%:%' GROUP BY ALL",
    )
)
def addresses_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct IPv4 addresses and /24 of agents, networks and the whole log by hour, merged from stored masks of five minutes."""
    grain = _grain(spark, sf_dir).withColumn("all", F.lit("all"))
    masks = materialise(distinct.host_masks(entities.by_entity(grain, ("ua", "cidr", "all")), ("entity_type", "entity_value", "w")), "masks")
    hours = distinct.merged_masks(masks, {"entity_type": F.col("entity_type"), "entity_value": F.col("entity_value"), "hour": F.floor(F.col("w") / 12)})
    return distinct.address_counts(hours, ("entity_type", "entity_value", "hour"))


_TOP = "t{i} AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_value ORDER BY n DESC, value) AS rank FROM (SELECT *, sum(n) OVER (PARTITION BY entity_type, entity_value) AS total FROM (SELECT entity_type, entity_value, '{v}' AS kind, {v} AS value, count(*) AS n FROM ent WHERE {v} IS NOT NULL GROUP BY ALL)))"


@query(oracle.sql([oracle.REQ, *[_TOP.format(i=i, v=v) for i, v in enumerate(("path", "verb", "ref"))]], " UNION ALL ".join(f"SELECT entity_type, entity_value, kind, value, n, CAST(total AS BIGINT) AS total, CAST(rank AS INT) AS rank FROM t{i} WHERE rank <= 3" for i in range(3))))
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent paths, verbs and referrers of every entity over the whole log."""
    rows = materialise(entities.by_entity(_grain(spark, sf_dir)).select("entity_type", "entity_value", "path", "verb", "ref", "n"), "entities")
    tops = [heavy.top_values(rows, ("entity_type", "entity_value"), v, "n", 3).withColumnRenamed(v, "value").withColumn("kind", F.lit(v)) for v in ("path", "verb", "ref")]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


_LEVEL = "l{k} AS (SELECT {k} AS level, w, x{k} AS network, {above}sum(n) AS n, sum(errors) AS errors, sum(ips) AS ips, sum(rest) AS rest, sum(rest) >= 0.1::DOUBLE * any_value(window_requests) AS heavy FROM {rows} JOIN tot USING (w) GROUP BY w, x{k})"


@query(
    oracle.sql(
        [
            oracle.REQ,
            """a AS (SELECT w, ip, count(*) AS n, count(*) FILTER (status >= 400) AS errors, 1 AS ips, count(*) AS rest,
                 CASE WHEN ip LIKE '%:%' THEN ip || '/128' ELSE ip || '/32' END AS x0,
                 CASE WHEN ip LIKE '%:%' THEN regexp_extract(ip, '^(.*::)', 1) || '/64' ELSE regexp_extract(ip, '^(.*)[.]', 1) || '.0/24' END AS x1,
                 CASE WHEN ip LIKE '%:%' THEN regexp_extract(ip, '^([^:]*:[^:]*:[^:]*):', 1) || '::/48' ELSE regexp_extract(ip, '^([0-9]+[.][0-9]+)[.]', 1) || '.0.0/16' END AS x2,
                 CASE WHEN ip LIKE '%:%' THEN regexp_extract(ip, '^([^:]*:[^:]*):', 1) || '::/32' ELSE regexp_extract(ip, '^([0-9]+)[.]', 1) || '.0.0.0/8' END AS x3 FROM win GROUP BY w, ip)""",
            *[
                _LEVEL.format(
                    k=k, above="".join(f"any_value(x{j}) AS x{j}, " for j in range(k + 1, 4)),
                    rows="a" if k == 0 else f"(SELECT * REPLACE (CASE WHEN heavy THEN 0 ELSE rest END AS rest) FROM l{k - 1})",
                )
                for k in range(4)
            ],
        ],
        "SELECT level, w, network, n, errors, ips, rest, heavy FROM (" + " UNION ALL ".join(f"SELECT level, w, network, n, errors, ips, rest, heavy FROM l{k}" for k in range(4)) + ")",
    )
)
def network_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of four lengths in one pass over the log, and which of them are heavy by themselves."""
    return networks.network_levels(_grain(spark, sf_dir))


# --- prefixes ----------------------------------------------------------------------------------

_PREFIX_SQL = "SELECT {keys}depth, substr(path, 1, depth) AS prefix, count(*) AS hits, count(DISTINCT ip) AS unique_ips, count(DISTINCT ua) AS unique_uas, min(ts) AS tofs, round(count(*) FILTER (status >= 400) / count(*), 6) AS error_rate, count(*) FILTER (status_class = '3xx') AS n_3xx FROM {rows}, (SELECT unnest([2, 4, 6, 8, 16, 32, 64]) AS depth) WHERE length(path) >= depth GROUP BY ALL"


def _prefix_columns(stats: DataFrame, *keys: str) -> DataFrame:
    return stats.select(*keys, "depth", "prefix", "hits", "unique_ips", "unique_uas", "tofs", _r("error_rate"), F.coalesce(F.col("status_dist")["3xx"], F.lit(0)).alias("n_3xx"))


@query(oracle.sql([oracle.REQ], _PREFIX_SQL.format(keys="", rows="r")))
def prefix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefix_columns(prefixes.prefix_stats(derived.requests(spark, sf_dir)))


@query(oracle.sql([oracle.REQ], _PREFIX_SQL.format(keys="ip AS entity_value, ", rows="r")))
def address_prefix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.requests(spark, sf_dir).withColumn("entity_value", F.col("ip"))
    return _prefix_columns(prefixes.prefix_stats(rows, keys=("entity_value",)), "entity_value")


@query(oracle.sql([oracle.REQ], _PREFIX_SQL.format(keys="ua AS entity_value, ", rows="(SELECT * FROM r WHERE ua IS NOT NULL) r")))
def agent_prefix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.requests(spark, sf_dir).filter("ua is not null").withColumn("entity_value", F.col("ua"))
    return _prefix_columns(prefixes.prefix_stats(rows, keys=("entity_value",)), "entity_value")


@query(oracle.sql([oracle.REQ, "d AS (SELECT unnest([2, 4, 6, 8, 16, 32, 64]) AS depth)"], "SELECT depth, count(DISTINCT substr(path, 1, depth)) AS n_prefixes, count(*) AS hits FROM r, d WHERE length(path) >= depth GROUP BY depth"))
def prefixes_per_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefixes_at_depth(prefixes.prefix_stats(derived.requests(spark, sf_dir)))


@query(
    oracle.sql(
        [oracle.REQ, "p AS (SELECT depth, substr(path, 1, depth) AS prefix, count(*) AS hits, count(DISTINCT ip) AS unique_ips, min(ts) AS tofs FROM r, (SELECT unnest([2, 4, 6, 8, 16, 32, 64]) AS depth) WHERE length(path) >= depth GROUP BY ALL)"],
        "SELECT q.p_partkey, q.depth, q.prefix, coalesce(hits, 0) AS hits, coalesce(unique_ips, 0) AS unique_ips, tofs FROM (SELECT p_partkey, 4 AS depth, '/p' || (p_partkey % 13) || '/' AS prefix FROM part) q LEFT JOIN p ON p.depth = q.depth AND p.prefix = q.prefix",
    )
)
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lit(4).alias("depth"), F.concat(F.lit("/p"), F.col("p_partkey") % 13, F.lit("/")).alias("prefix"))
    found = prefixes.prefix_lookup(wanted, prefixes.prefix_stats(derived.requests(spark, sf_dir)))
    return found.select("p_partkey", "depth", "prefix", "hits", "unique_ips", "tofs")


@query(oracle.sql([oracle.REQ, oracle.STATE], f"SELECT w, prefix, tofs, unique_ips, hits, {_rs('error_rate')} FROM st"))
def prefix_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_state(_grain(spark, sf_dir)).select("w", "prefix", "tofs", "unique_ips", "hits", _r("error_rate"))


@query(oracle.sql([oracle.REQ, oracle.METRICS, oracle.STATE, oracle.NEW], f"SELECT entity_type, entity_value, w, {_rs('d_new')} FROM dn"))
def new_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    grain = materialise(_grain(spark, sf_dir), "grain")
    paths = entities.path_grain(entities.by_entity(grain))
    totals = paths.groupBy(*KEY).agg(F.sum("n").alias("total_requests"))
    return prefixes.new_content(paths, prefixes.prefix_state(grain), totals).select(*KEY, _r("d_new"))


# --- baseline ----------------------------------------------------------------------------------


@query(oracle.sql([oracle.REQ, oracle.TRAIN], f"SELECT ip, total_requests, {_rs('error_rate', 'explore_ratio', 'depth_score', *[f'fanout_{d}' for d in DEFAULT.depths])} FROM te"))
def training_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baseline.training_entities(windows.training_window(derived.requests(spark, sf_dir)))
    return rows.select("ip", "total_requests", *[_r(n) for n in ("error_rate", "explore_ratio", "depth_score", *[f"fanout_{d}" for d in DEFAULT.depths])])


@query(oracle.sql([oracle.REQ, oracle.TRAIN], f"SELECT metric, n, {_rs('median', 'mad', 'mean', 'variance')} FROM bt"))
def baseline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.train(derived.requests(spark, sf_dir)).select("metric", "n", *[_r(n) for n in ("median", "mad", "mean", "variance")])


@query(oracle.sql([oracle.REQ, oracle.TRAIN], f"SELECT {_rs('theta', 'alpha', 'beta')} FROM b"))
def error_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.baseline_row(detect.train(derived.requests(spark, sf_dir))).select(_r("theta"), _r("alpha"), _r("beta"))


@query(
    oracle.sql(
        [oracle.REQ, oracle.METRICS, oracle.TRAIN, f"v AS (SELECT entity_type, entity_value, w, {oracle._z('explore_ratio')} AS explore_z, {oracle._z('depth_score')} AS depth_z, {oracle._z('fanout_8')} AS fanout_z FROM m)"],
        f"SELECT entity_type, entity_value, w, {_rs('explore_z', 'depth_z', 'fanout_z')}, abs(depth_z) > 4 AS depth_anomalous FROM v",
    )
)
def robust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = baseline.baseline_row(detect.train(derived.requests(spark, sf_dir)))
    z = lambda m: baseline.robust_z(F.col(m), F.col(f"median_{m}"), F.col(f"mad_{m}"))
    rows = _metrics(spark, sf_dir).join(F.broadcast(base)).select(*KEY, z("explore_ratio").alias("explore_z"), z("depth_score").alias("depth_z"), z("fanout_8").alias("fanout_z"))
    return rows.select(*KEY, _r("explore_z"), _r("depth_z"), _r("fanout_z"), baseline.is_anomalous(F.col("depth_z")).alias("depth_anomalous"))


@query(oracle.sql([oracle.REQ, oracle.METRICS, oracle.TRAIN, oracle.POSTERIOR], f"SELECT error_count, total_requests, {_rs('mean', 'exceeds')} FROM po"))
def error_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = _metrics(spark, sf_dir)
    base = materialise(baseline.baseline_row(detect.train(derived.requests(spark, sf_dir))), "baseline")
    rows = baseline.posterior_table(metrics, base).join(F.broadcast(base))
    mean = baseline.posterior_mean(F.col("error_count"), F.col("total_requests"), F.col("alpha"), F.col("beta"))
    return rows.select("error_count", "total_requests", F.round(mean, oracle.R).alias("mean"), _r("exceeds"))


@query(
    oracle.sql(
        [oracle.REQ, oracle.METRICS, oracle.TRAIN, oracle.POSTERIOR, oracle.QUANTILES],
        "SELECT error_count, total_requests, round(any_value(exceeds), 6) AS exceeds, round(max((lo + hi) / 2) FILTER (side = 'low'), 6) AS low, round(max((lo + hi) / 2) FILTER (side = 'high'), 6) AS high FROM bq JOIN po USING (error_count, total_requests) WHERE bq.n = 40 GROUP BY ALL",
    )
)
def error_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = materialise(baseline.baseline_row(detect.train(derived.requests(spark, sf_dir))), "baseline")
    rows = baseline.posterior_table(_metrics(spark, sf_dir), base, interval=0.95)
    return rows.select("error_count", "total_requests", _r("exceeds"), _r("low"), _r("high"))


# --- rates and persistence ---------------------------------------------------------------------


@query(
    oracle.sql(
        [oracle.REQ, oracle.METRICS, oracle.RATES],
        f"SELECT entity_type, entity_value, w, session, {_rs('rate', 'ewma', 'std', 'deviation', 'p_tail', 's_burst')}, p_tail < 1e-6 AS anomalous FROM (SELECT *, abs(rate - ewma) AS deviation, 100 * sqrt(1 - p_tail) AS s_burst FROM rt)",
    )
)
def rate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates.rate_state(_totals(spark, sf_dir))
    return rows.select(*KEY, "session", *[_r(n) for n in ("rate", "ewma", "std", "deviation", "p_tail", "s_burst")], "anomalous")


_CUSUM = [
    "cu AS (SELECT *, sum((rate - ewma) / greatest(std, 1e-6) - 2) OVER s AS p FROM re WINDOW s AS (PARTITION BY entity_type, entity_value, session ORDER BY w ROWS UNBOUNDED PRECEDING))",
    "cv AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY entity_type, entity_value, session ORDER BY w ROWS UNBOUNDED PRECEDING)) AS cusum FROM cu)",
]


@query(
    oracle.sql(
        [oracle.REQ, oracle.METRICS, oracle.RATES, *_CUSUM],
        f"SELECT entity_type, entity_value, w, {_rs('cusum')}, cusum > 5 AS alert, round(least(100, 100 * cusum / 5), 6) AS cusum_score FROM cv",
    )
)
def rate_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates.cusum(rates.rate_state(_totals(spark, sf_dir)))
    return rows.select(*KEY, _r("cusum"), "alert", _r("cusum_score"))


@query(
    oracle.sql(
        [
            oracle.REQ, "a AS (SELECT DISTINCT entity_type, entity_value, w FROM ent WHERE entity_type <> 'cidr')", "g AS (SELECT unnest(range(0, 36)) AS tick)",
            "l AS (SELECT tick, entity_type, entity_value, max(w) AS w FROM a JOIN g ON w <= tick GROUP BY ALL)",
        ],
        "SELECT tick AS w, entity_type, count(*) AS tracked FROM l WHERE 12 * ceil((w + 13) / 12) > tick AND tick <= (SELECT max(w) FROM a) GROUP BY ALL",
    )
)
def tracked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.tracked(entities.by_entity(_grain(spark, sf_dir)))


@query(
    oracle.sql(
        [
            oracle.REQ, "q AS (SELECT entity_type, entity_value, w, count(*) FILTER (status >= 400) / count(*) >= 0.05 AS had_signal FROM ent GROUP BY ALL)",
            "i AS (SELECT *, sum((NOT had_signal)::INT) OVER (PARTITION BY entity_type, entity_value ORDER BY w) AS island FROM q)",
            "j AS (SELECT *, sum(had_signal::INT) OVER (PARTITION BY entity_type, entity_value, island ORDER BY w) AS run FROM i)",
        ],
        "SELECT entity_type, entity_value, w, had_signal, coalesce(lag(run) OVER (PARTITION BY entity_type, entity_value ORDER BY w), 0) AS streak, sum(had_signal::INT) OVER (PARTITION BY entity_type, entity_value ORDER BY w) AS total FROM j",
    )
)
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir).select(*KEY, (F.col("error_rate") >= 0.05).alias("had_signal"))
    return persistence.streaks(rows)


# --- signals, decisions, reports ---------------------------------------------------------------

_SIGNALS = ["max_z", "s_err", "s_explore", "s_hammer", "s_burst", "s_spread", "s_dominance", "d_volume", "d_new"]
_ALL = [oracle.REQ, oracle.METRICS, oracle.TRAIN, oracle.POSTERIOR, oracle.RATES, oracle.STATE, oracle.NEW, oracle.SIGNALS]


def _signals(spark: SparkSession, sf_dir: str, hammer: int = 50) -> DataFrame:
    cfg = replace(DEFAULT, n_hammer_min=hammer)
    rows = derived.requests(spark, sf_dir)
    grain = materialise(detect.grain_of(rows, cfg), "grain")
    return detect.base_signals(grain, materialise(detect.train(rows, cfg), "baseline"), cfg)


@query(oracle.sql(_ALL, f"SELECT entity_type, entity_value, w, {_rs(*_SIGNALS)} FROM s2", 50))
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select(*KEY, *[_r(n) for n in _SIGNALS])


_DECIDED = "SELECT w, t0 + (w + 1) * INTERVAL 300 SECOND AS \"when\", entity_type, entity_value, round(score, 6) AS score, duration_sec, streak, round(s_err, 6) AS s_err, round(s_persist, 6) AS s_persist, round(d_new, 6) AS new_content, 'block' AS recommended_action FROM dc, span"


def _decision_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "w", "when", "entity_type", "entity_value", _r("score"), "duration_sec", "streak", F.round("signals.error_posterior.score", oracle.R).alias("s_err"), F.round("signals.persistence.score", oracle.R).alias("s_persist"),
        F.round("dampeners.new_content", oracle.R).alias("new_content"), "recommended_action",
    )


@query(oracle.sql([*_ALL, oracle.DECIDE, oracle.STREAKS], _DECIDED, 50))
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with a hammering minimum that suits small logs."""
    return _decision_columns(detect.detect(derived.requests(spark, sf_dir), replace(DEFAULT, n_hammer_min=50)))


@query(oracle.sql([*_ALL, oracle.DECIDE, oracle.STREAKS], _DECIDED, 500))
def decisions_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with the method's own settings."""
    return _decision_columns(detect.detect(derived.requests(spark, sf_dir)))


@query(
    oracle.sql(
        [*_ALL, oracle.DECIDE, oracle.STREAKS, oracle.EXPLAINED],
        "SELECT w, entity_type, entity_value, CASE WHEN reasons = '' THEN 'no significant anomalies' ELSE reasons END || CASE WHEN notes = '' THEN '' ELSE ' | Dampeners: ' || notes END AS explanation FROM ex", 50,
    )
)
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.detect(derived.requests(spark, sf_dir), replace(DEFAULT, n_hammer_min=50))
    return rows.select("w", "entity_type", "entity_value", "explanation")


@query(oracle.sql([oracle.PATH_REQ, *_ALL[1:], oracle.DECIDE, oracle.STREAKS], _DECIDED, 50))
def path_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on paths and referrers, which are entities on request: a lower threshold and soft durations."""
    return _decision_columns(detect.detect(derived.requests(spark, sf_dir), replace(DEFAULT, n_hammer_min=50), types=("path", "ref")))


@query(
    oracle.sql(
        [*_ALL, oracle.DECIDE, oracle.STREAKS],
        "SELECT row_number() OVER (ORDER BY w, CASE entity_type WHEN 'cidr' THEN 0 WHEN 'ip' THEN 1 ELSE 2 END, first_seen, entity_value) - 1 AS place, w, entity_type, entity_value FROM dc", 50,
    )
)
def decision_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions in the order of a report, with their places in it."""
    rows = report.in_order(detect.detect(derived.requests(spark, sf_dir), replace(DEFAULT, n_hammer_min=50))).select("w", "entity_type", "entity_value")
    return report.with_places(rows)


@query(
    oracle.sql(
        [*_ALL, oracle.DECIDE, oracle.STREAKS],
        "SELECT strftime(t0 + (w + 1) * INTERVAL 300 SECOND, '%Y-%m-%d') AS day, entity_type, entity_value, w, round(score, 2) AS score, duration_sec, round(s_hammer, 6) AS s_hammer, round(d_volume, 6) AS volume, 'block' AS recommended_action FROM dc, span", 50,
    )
)
def written_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions written as JSON lines by day and entity type, and read back from the files."""
    path = new_folder(spark, "decisions")
    logs.write_decisions(detect.detect(derived.requests(spark, sf_dir), replace(DEFAULT, n_hammer_min=50)), path)
    back = spark.read.json(path)
    return back.select(
        F.col("day").cast("string").alias("day"), "entity_type", "entity_value", "w", "score", F.col("duration_sec").cast("int").alias("duration_sec"), F.round("signals.hammering.score", oracle.R).alias("s_hammer"),
        F.round("dampeners.volume", oracle.R).alias("volume"), "recommended_action",
    )


@query(
    oracle.sql(
        [*_ALL, oracle.DECIDE, oracle.STREAKS, "ts_ AS (SELECT entity_type, entity_value, max(score) AS max_score, avg(score) AS avg_score, count(*) AS num_windows, max(duration_sec) AS max_duration, min(w) AS first_w FROM dc GROUP BY ALL)", "tp AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY max_score DESC, first_w, entity_value) AS place FROM ts_)"],
        f"SELECT entity_type, entity_value, {_rs('max_score', 'avg_score')}, num_windows, max_duration, place FROM tp WHERE place <= 10",
        50,
    )
)
def top_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.top_offenders(detect.detect(derived.requests(spark, sf_dir), replace(DEFAULT, n_hammer_min=50)))
    return rows.select("entity_type", "entity_value", _r("max_score"), _r("avg_score"), "num_windows", "max_duration", "place")


# --- streaming ---------------------------------------------------------------------------------


@query(oracle.sql([oracle.REQ], "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, ip, count(*) AS n, count(*) FILTER (status >= 400) AS errors FROM r GROUP BY ALL"))
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.run_window_counts(derived.requests(spark, sf_dir)).filter("ip is not null")


@query(
    oracle.sql(
        [oracle.REQ, "l AS (SELECT *, CAST(epoch(ts) AS BIGINT) % 7 = 3 AS late, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM r)", "e AS (SELECT max(ts) AS t FROM l WHERE NOT late)"],
        "SELECT window_start, ip, count(*) AS n, count(*) FILTER (status >= 400) AS errors FROM l, e WHERE NOT late OR window_start + INTERVAL 5 MINUTE > t - INTERVAL 10 MINUTE GROUP BY ALL",
    )
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the log comes last; of it only what the watermark has not passed counts."""
    rows = derived.requests(spark, sf_dir).select("ts", "ip", "status")
    late = F.unix_seconds("ts") % 7 == 3
    return replay.run_late_rows(rows.filter(~late), rows.filter(late))


@query(
    oracle.sql(
        [oracle.REQ, "l AS (SELECT *, CAST(epoch(ts) AS BIGINT) % 7 = 3 AS comes_last, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM r)", "e AS (SELECT max(ts) AS t FROM l WHERE NOT comes_last)",
         "k AS (SELECT *, comes_last AND window_start + INTERVAL 5 MINUTE <= t - INTERVAL 10 MINUTE AS late, CAST(floor(epoch((t - INTERVAL 10 MINUTE) - (window_start + INTERVAL 5 MINUTE)) / 300) AS BIGINT) AS behind FROM l, e)"],
        "SELECT window_start, ip, CASE WHEN late THEN behind END AS windows_late, count(*) AS n, count(*) FILTER (status >= 400) AS errors FROM k GROUP BY ALL",
    )
)
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the log comes last; what is too late for its window is kept apart, so that no request is lost."""
    rows = derived.requests(spark, sf_dir).select("ts", "ip", "status")
    last = F.unix_seconds("ts") % 7 == 3
    return replay.run_counts(rows.filter(~last), rows.filter(last))


@query(
    oracle.sql(
        [oracle.REQ],
        """SELECT coalesce(fmt, '') AS fmt, reject, ip, path, status, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
             SELECT CASE WHEN sec % 2 = 0 THEN 'combined' ELSE 'cdn' END AS fmt, CAST(NULL AS VARCHAR) AS reject, ip, path, status, ts FROM r
             UNION ALL SELECT NULL, CASE WHEN status = 503 THEN 'rotation' WHEN status = 404 THEN 'no match' ELSE 'blank' END, NULL, NULL, NULL, NULL FROM r WHERE sec % 60 = 0
             UNION ALL SELECT 'combined', 'bad timestamp', NULL, NULL, NULL, NULL FROM r WHERE ua IS NULL) GROUP BY ALL""",
    )
)
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of both formats, with lines that hold no request, parsed as they arrive: requests and rejects."""
    good, bad = replay.run_lines(derived.mixed_lines(derived.requests(spark, sf_dir)))
    rows = good.withColumn("reject", F.lit(None).cast("string")).unionByName(bad.select("fmt", "reject"), allowMissingColumns=True)
    return rows.groupBy(F.coalesce("fmt", F.lit("")).alias("fmt"), "reject", "ip", "path", "status").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    oracle.sql(
        [oracle.REQ, oracle.METRICS, oracle.RATES, *_CUSUM],
        f"SELECT entity_type, entity_value, w, min(w) OVER (PARTITION BY entity_type, entity_value, session) AS session_start, {_rs('rate', 'ewma', 'std')}, round(abs(rate - ewma), 6) AS deviation, {_rs('cusum')}, cusum > 5 AS alert FROM cv",
    )
)
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of addresses and agents from keyed streaming state; the same as from the whole log."""
    rows = replay.run_rates(derived.requests(spark, sf_dir))
    return rows.select(*KEY, "session_start", *[_r(n) for n in ("rate", "ewma", "std", "deviation", "cusum")], "alert")


@query(oracle.sql([*_ALL, oracle.DECIDE, oracle.STREAKS], _DECIDED, 50))
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector fed part by part; the same decisions as from the whole log."""
    rows = derived.requests(spark, sf_dir)
    return _decision_columns(replay.run_detector(rows, replace(DEFAULT, n_hammer_min=50)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(derived.requests(spark, sf_dir), replace(DEFAULT, n_hammer_min=50)).drop("first_seen")

"""DuckDB SQL for the registered queries: building blocks as common table expressions, then one query each."""

from __future__ import annotations

from logwarden.config import DEFAULT

DEPTHS = DEFAULT.depths
R = 6  # digits that doubles are rounded to on both sides


def _deepest(path: str) -> str:
    return "CASE " + " ".join(f"WHEN length({path}) >= {d} THEN {d}" for d in reversed(DEPTHS)) + " ELSE 0 END"


REQ = """
li AS (SELECT CAST(l_orderkey AS BIGINT) ok, CAST(l_linenumber AS BIGINT) ln, CAST(l_partkey AS BIGINT) pk, CAST(l_suppkey AS BIGINT) sk, CAST(l_quantity AS INT) q FROM lineitem),
lk AS (SELECT *, (ok*7919 + ln*104729 + pk*31) % 10800 AS sec, (ok*31 + ln*17 + pk*7) % 100 AS k FROM li),
rq AS (SELECT TIMESTAMP '2025-09-25 19:00:00' + sec * INTERVAL 1 SECOND AS ts, sec,
    CASE WHEN k < 45 THEN '203.0.113.' || (pk % 120) WHEN k < 50 THEN '198.51.100.7'
         WHEN sk % 5 = 0 THEN '2a03:2880:f8' || lpad(CAST(sk % 100 AS VARCHAR), 2, '0') || ':c::' || (ln % 2 + 1)
         ELSE '10.' || (sk % 200) || '.' || (sk // 200) || '.' || (ln % 2 + 1) END AS ip,
    CASE WHEN k < 45 THEN '203.0.113.0/24' WHEN k < 50 THEN '198.51.100.0/24'
         WHEN sk % 5 = 0 THEN '2a03:2880:f8' || lpad(CAST(sk % 100 AS VARCHAR), 2, '0') || '::/48'
         ELSE '10.' || (sk % 200) || '.' || (sk // 200) || '.0/24' END AS cidr,
    CASE WHEN k < 45 THEN '/4cHCCP5v8YP_K73rMwVH0iMr' || CASE WHEN pk % 12 = 0 THEN 1 + ok % 3 ELSE 0 END
         WHEN k < 50 THEN '/z' || ok || '-' || ln WHEN sec >= 3600 AND k < 60 THEN '/New01' || (pk % 20)
         ELSE '/p' || (pk % 10) || '/' || (pk % 40) || repeat('x', q) END AS path,
    CASE WHEN k < 45 THEN 301 WHEN k < 50 THEN 404 WHEN q >= 47 THEN 404 WHEN q = 46 THEN 503 ELSE 200 END AS status,
    CASE WHEN k < 45 THEN 'netbot/1.0' WHEN k < 50 THEN NULL ELSE 'Mozilla/5.' || (sk % 20) END AS ua,
    CASE WHEN k >= 50 AND ok % 7 = 0 THEN 'POST' WHEN k >= 50 AND ok % 11 = 0 THEN 'HEAD' ELSE 'GET' END AS verb,
    CASE WHEN (ok + ln) % 3 > 0 THEN 'https://site' || (pk % 15) || '.example/' || ln END AS ref FROM lk),
r AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN '2xx' WHEN status BETWEEN 300 AND 399 THEN '3xx' WHEN status BETWEEN 400 AND 499 THEN '4xx' WHEN status BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END AS status_class FROM rq),
span AS (SELECT min(ts) t0, max(ts) t_max FROM r),
win AS (SELECT r.*, CAST(epoch(ts - t0) AS BIGINT) // 300 AS w FROM r, span WHERE t0 + (CAST(epoch(ts - t0) AS BIGINT) // 300) * INTERVAL 300 SECOND < t_max),
tot AS (SELECT w, count(*) AS window_requests FROM win GROUP BY w),
ent AS (SELECT 'ip' AS entity_type, ip AS entity_value, * FROM win UNION ALL SELECT 'ua', ua, * FROM win WHERE ua IS NOT NULL UNION ALL SELECT 'cidr', cidr, * FROM win)
"""

#: The same with paths and referrers as entities.
PATH_REQ = REQ[: REQ.index("ent AS")] + "ent AS (SELECT 'path' AS entity_type, path AS entity_value, * FROM win UNION ALL SELECT 'ref', ref, * FROM win WHERE ref IS NOT NULL)\n"

PATHS = f"""
pg AS (SELECT entity_type, entity_value, w, path, count(*) AS n, count(*) FILTER (status >= 400) AS errs, {_deepest("path")} AS depth FROM ent GROUP BY ALL),
"""

METRICS = (
    PATHS
    + f"""
ma AS (SELECT entity_type, entity_value, w, count(*) AS total_requests, count(*) FILTER (status_class IN ('4xx','5xx')) AS error_count,
    count(*) FILTER (status_class='2xx') AS status_2xx, count(*) FILTER (status_class='3xx') AS status_3xx, count(*) FILTER (status_class='4xx') AS status_4xx, count(*) FILTER (status_class='5xx') AS status_5xx,
    count(DISTINCT path) AS unique_paths, count(DISTINCT CASE WHEN entity_type IN ('ip', 'cidr') THEN ua END) AS unique_uas, count(DISTINCT CASE WHEN entity_type IN ('ua', 'cidr') THEN ip END) AS unique_ips, count(DISTINCT ref) AS unique_refs,
    min(ts) AS first_seen, max(ts) AS last_seen,
    {", ".join(f"count(DISTINCT CASE WHEN entity_type <> 'cidr' AND length(path) >= {d} THEN substr(path, 1, {d}) END) AS uniq_prefix_{d}" for d in DEPTHS)}
    FROM ent GROUP BY ALL),
mb AS (SELECT entity_type, entity_value, w, max(n) AS top_path_count, arg_max(path, (n, path)) AS top_path, sum(CASE WHEN entity_type = 'cidr' THEN 0 ELSE depth * n END) / sum(n) AS depth_score FROM pg GROUP BY ALL),
m AS (SELECT *, error_count / total_requests AS error_rate, unique_paths / total_requests AS explore_ratio, 1 - unique_paths / total_requests AS path_concentration, top_path_count / total_requests AS top_path_ratio,
    status_3xx / total_requests AS redirect_rate, {", ".join(f"uniq_prefix_{d} / total_requests AS fanout_{d}" for d in DEPTHS)} FROM ma JOIN mb USING (entity_type, entity_value, w)),
"""
)

TRAIN = f"""
tr AS (SELECT r.* FROM r, span WHERE ts <= t0 + INTERVAL 1 HOUR),
te AS (SELECT ip, count(*) AS total_requests, count(*) FILTER (status >= 400) / count(*) AS error_rate, count(DISTINCT path) / count(*) AS explore_ratio, sum({_deepest("path")}) / count(*) AS depth_score,
    {", ".join(f"count(DISTINCT CASE WHEN length(path) >= {d} THEN substr(path, 1, {d}) END) / count(*) AS fanout_{d}" for d in DEPTHS)} FROM tr GROUP BY ip HAVING count(*) >= 30),
tv AS (SELECT 'error_rate' AS metric, error_rate AS value FROM te WHERE error_rate < 0.5 {" ".join(f"UNION ALL SELECT '{n}', {n} FROM te WHERE {n} > 0" for n in ["explore_ratio", "depth_score", *[f"fanout_{d}" for d in DEPTHS]])}),
bm AS (SELECT metric, median(value) AS median, count(*) AS n, avg(value) AS mean, var_pop(value) AS variance FROM tv GROUP BY metric),
bt AS (SELECT bm.metric, any_value(bm.median) AS median, median(abs(value - bm.median)) AS mad, any_value(bm.n) AS n, any_value(mean) AS mean, any_value(variance) AS variance FROM tv JOIN bm USING (metric) GROUP BY bm.metric),
pr AS (SELECT coalesce(max(median) FILTER (metric = 'error_rate'), 0.08) AS theta, max(mean) FILTER (metric = 'error_rate') AS mu, max(variance) FILTER (metric = 'error_rate') AS va FROM bt),
b AS (SELECT theta, CASE WHEN va > 0 AND mu > 0 AND mu < 1 AND mu*(1-mu)/va - 1 > 0 THEN greatest(0.5, least(1000.0, mu * (mu*(1-mu)/va - 1))) ELSE 1.0 END AS alpha,
    CASE WHEN va > 0 AND mu > 0 AND mu < 1 AND mu*(1-mu)/va - 1 > 0 THEN greatest(0.5, least(1000.0, (1-mu) * (mu*(1-mu)/va - 1))) ELSE 1.0 END AS beta FROM pr),
"""

#: 1 - I_x(a, b) by the power series of the incomplete beta function.
POSTERIOR = """
px AS (SELECT DISTINCT error_count AS e, total_requests AS n, alpha + error_count AS a, beta + total_requests - error_count AS bb, theta + 0.10 AS x, alpha, beta FROM m, b),
po AS (SELECT e AS error_count, n AS total_requests, (alpha + e) / (alpha + beta + n) AS mean,
    greatest(0.0, least(1.0, 1 - exp(a * ln(x) + bb * ln(1 - x) - ln(a) - lgamma(a) - lgamma(bb) + lgamma(a + bb)) *
      list_sum(list_transform(range(0, 1500), lambda i: exp(lgamma(a + bb + i) - lgamma(a + bb) - lgamma(a + 1 + i) + lgamma(a + 1) + i * ln(x)))))) AS exceeds FROM px),
"""

RATES = """
ra AS (SELECT entity_type, entity_value, w, total_requests / 300 AS rate, lag(w) OVER (PARTITION BY entity_type, entity_value ORDER BY w) AS lw FROM m WHERE entity_type IN ('ip', 'ua')),
rs AS (SELECT *, sum(CASE WHEN 12 * ceil((lw + 13) / 12) <= w - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_type, entity_value ORDER BY w) AS session FROM ra),
rn AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_value, session ORDER BY w) - 1 AS k FROM rs),
re AS (SELECT *, list_reduce(list(rate) OVER s, lambda e, x: 0.3 * x + 0.7 * e) AS ewma, CASE WHEN k = 0 THEN 0 ELSE stddev_pop(rate) OVER (PARTITION BY entity_type, entity_value, session ORDER BY w ROWS 99 PRECEDING) END AS std
    FROM rn WINDOW s AS (PARTITION BY entity_type, entity_value, session ORDER BY w ROWS UNBOUNDED PRECEDING)),
rt AS (SELECT *, greatest(0.0, least(1.0, 1 - list_sum(list_transform(range(0, CAST(floor(rate) AS BIGINT) + 1), lambda i: exp(i * ln(ewma) - ewma - lgamma(i + 1)))))) AS p_tail FROM re),
"""

STATE = """
pw AS (SELECT substr(path, 1, 6) AS prefix, w, ip, count(*) AS n, count(*) FILTER (status >= 400) AS errs, min(ts) AS ts FROM win WHERE length(path) >= 6 GROUP BY ALL),
pf AS (SELECT prefix, w, count(*) AS new_ips FROM (SELECT prefix, ip, min(w) AS w FROM pw GROUP BY prefix, ip) GROUP BY ALL),
pp AS (SELECT prefix, w, sum(n) AS n, sum(errs) AS errs, min(ts) AS ts FROM pw GROUP BY ALL),
st AS (SELECT w, prefix, min(ts) OVER s AS tofs, coalesce(sum(new_ips) OVER s, 0) AS unique_ips, sum(n) OVER s AS hits, sum(errs) OVER s / sum(n) OVER s AS error_rate
    FROM pp LEFT JOIN pf USING (prefix, w) WINDOW s AS (PARTITION BY prefix ORDER BY w ROWS UNBOUNDED PRECEDING)),
"""

NEW = """
nc AS (SELECT entity_type, entity_value, pg.w, sum(n) AS new_requests FROM pg JOIN st ON pg.w = st.w AND substr(path, 1, 6) = prefix AND length(path) >= 6, span
    WHERE t0 + (pg.w + 1) * INTERVAL 300 SECOND - tofs <= INTERVAL 90 MINUTE AND unique_ips >= 100 AND st.error_rate < 0.20 GROUP BY ALL),
dn AS (SELECT entity_type, entity_value, w, 30.0 * coalesce(new_requests, 0) / total_requests AS d_new FROM m LEFT JOIN nc USING (entity_type, entity_value, w)),
"""


def _z(metric: str) -> str:
    return f"(CASE WHEN (SELECT mad FROM bt WHERE metric='{metric}') >= 1e-9 THEN ({metric} - (SELECT median FROM bt WHERE metric='{metric}')) / (1.4826 * (SELECT mad FROM bt WHERE metric='{metric}')) ELSE 0 END)"


SIGNALS = f"""
zz AS (SELECT *, greatest(0, {_z("explore_ratio")}, {", ".join(f"CASE WHEN fanout_{d} > 0 THEN {_z(f'fanout_{d}')} ELSE 0 END" for d in DEPTHS)}, CASE WHEN {_z("depth_score")} < -3 THEN -{_z("depth_score")} ELSE 0 END) AS max_z FROM m),
s0 AS (SELECT zz.*, window_requests, total_requests / window_requests AS share, po.mean, po.exceeds, theta, rt.p_tail, d_new FROM zz JOIN tot USING (w) JOIN po USING (error_count, total_requests) JOIN dn USING (entity_type, entity_value, w)
    LEFT JOIN rt USING (entity_type, entity_value, w), b),
s1 AS (SELECT *, 100 * greatest(0.0, least(1.0, (mean - theta - 0.10) / 0.20)) * exceeds AS err0,
    100 / (1 + exp(-0.5 * (max_z - 4.0))) AS s_explore,
    CASE WHEN share >= 0.30 AND total_requests >= HAMMER THEN CASE WHEN path_concentration >= 0.99 THEN 100 * greatest(0.0, least(1.0, (path_concentration - CAST(0.99 AS DOUBLE)) / (CAST(1.0 AS DOUBLE) - CAST(0.99 AS DOUBLE))))
              ELSE 100 * greatest(0.0, least(1.0, (top_path_ratio - 0.30) / 0.40)) END
         WHEN total_requests < HAMMER THEN 0.0 ELSE 100 * greatest(0.0, least(1.0, (top_path_ratio - 0.5) / 0.4)) END AS s_hammer,
    CASE WHEN p_tail IS NULL THEN 0.0 ELSE 100 * sqrt(1 - p_tail) END AS s_burst,
    CASE WHEN entity_type = 'ua' AND unique_ips > 200 THEN least(100.0, (unique_ips - 200) / 5.0) WHEN entity_type = 'ip' AND unique_uas >= 5 THEN least(100.0, unique_uas * 10.0) ELSE 0.0 END AS s_spread,
    CASE WHEN share < 0.30 THEN 0.0 ELSE 100 * greatest(0.0, least(1.0, (share - 0.30) / 0.30)) END AS s_dominance,
    CASE WHEN total_requests >= 50 THEN 0.0 ELSE 40 * (1 - total_requests / 50) END AS d_volume FROM s0),
s2 AS (SELECT *, CASE WHEN redirect_rate >= 0.95 AND top_path_ratio >= 0.85 THEN least(100.0, err0 + 50 * least(1.0, redirect_rate * top_path_ratio)) ELSE err0 END AS s_err FROM s1),
"""

DECIDE = """
s3 AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_value ORDER BY w) AS k,
    0.28*s_err + 0.18*s_explore + 0.18*s_hammer + 0.12*s_burst + 0.05*s_spread + 0.06*s_dominance - d_new - d_volume + CASE WHEN s_hammer > 80 AND s_err > 40 THEN 37 ELSE 0 END + CASE WHEN s_dominance > 35 AND s_hammer > 25 THEN 40 ELSE 0 END AS raw,
    (s_err > 20)::INT + (s_explore > 20)::INT + (s_hammer > 20)::INT + (s_burst > 20)::INT + (s_spread > 20)::INT + (s_dominance > 20)::INT AS signals,
    entity_type <> 'path' AND ((s_hammer > 60 AND s_burst > 60) OR (s_dominance > 35 AND s_hammer > 25)) AS sure, CASE entity_type WHEN 'cidr' THEN 50 WHEN 'path' THEN 60 ELSE 75 END AS threshold, CASE entity_type WHEN 'path' THEN 1 ELSE 2 END AS least FROM s2),
s4 AS (SELECT *, (sure OR signals >= least) AND greatest(0, least(100, raw)) >= threshold AS d0, (sure OR signals + 1 >= least) AND greatest(0, least(100, raw + 10)) >= threshold AS d5 FROM s3),
"""

#: Streaks by recursion over each entity's appearances; those for which nothing is ever decided are left out.
STREAKS = """
hot AS (SELECT DISTINCT entity_type, entity_value FROM s4 WHERE d5),
h4 AS (SELECT * FROM s4 JOIN hot USING (entity_type, entity_value)),
rec AS (SELECT entity_type, entity_value, k, 0 AS streak, d0 AS decided FROM h4 WHERE k = 1
    UNION ALL SELECT h.entity_type, h.entity_value, h.k, CASE WHEN rec.decided THEN rec.streak + 1 ELSE 0 END,
      (h.sure OR h.signals + (CASE WHEN rec.decided AND rec.streak + 1 > 1 THEN 1 ELSE 0 END) >= h.least)
        AND greatest(0, least(100, h.raw + 0.10 * CASE WHEN rec.decided THEN least(100, 20.0 * (rec.streak + 1)) ELSE 0 END)) >= h.threshold
    FROM rec JOIN h4 h ON h.entity_type = rec.entity_type AND h.entity_value = rec.entity_value AND h.k = rec.k + 1),
sc AS (SELECT h4.*, streak, decided, least(100.0, 20.0 * streak) AS s_persist, greatest(0.0, least(100.0, raw + 0.10 * least(100.0, 20.0 * streak))) AS score FROM h4 JOIN rec USING (entity_type, entity_value, k)),
dc AS (SELECT *, CAST(trunc(60 * CASE WHEN score < 60 THEN 0 WHEN score < 75 THEN CASE WHEN entity_type IN ('path', 'ref') THEN greatest(15, least(60, 15 + (score - 60) * 3)) ELSE 0 END
    WHEN score < 90 THEN CASE WHEN entity_type IN ('ip', 'ua') THEN greatest(2, least(240, pow(2, (score - 70) / 10.0) * 10)) ELSE 60 END
    ELSE greatest(360, least(1440, pow(2, (score - 80) / 7.0) * 30)) END) AS INT) AS duration_sec FROM sc WHERE decided),
"""


#: Quantiles of the Beta posterior by halving, forty times; more than ten deviations above the mean all the mass lies below.
QUANTILES = """
bq AS (SELECT error_count, total_requests, q.side, q.p, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS n, alpha + error_count AS a, beta + total_requests - error_count AS bb
    FROM (SELECT DISTINCT error_count, total_requests, alpha, beta FROM m, b), (VALUES ('low', 0.025::DOUBLE), ('high', 0.975::DOUBLE)) q(side, p)
    UNION ALL SELECT error_count, total_requests, side, p, CASE WHEN cdf < p THEN x ELSE lo END, CASE WHEN cdf < p THEN hi ELSE x END, n + 1, a, bb FROM (
      SELECT *, CASE WHEN under THEN part ELSE 1 - part END AS cdf FROM (
        SELECT *, CASE WHEN y > u / (u + v) + 10 * sqrt(u * v / (u + v + 1)) / (u + v) THEN 1 ELSE exp(u * ln(y) + v * ln(1 - y) - ln(u) - lgamma(u) - lgamma(v) + lgamma(u + v)) *
          list_sum(list_transform(range(0, 700), lambda i: exp(lgamma(u + v + i) - lgamma(u + v) - lgamma(u + 1 + i) + lgamma(u + 1) + i * ln(y)))) END AS part FROM (
          SELECT *, CASE WHEN under THEN a ELSE bb END AS u, CASE WHEN under THEN bb ELSE a END AS v, CASE WHEN under THEN x ELSE 1 - x END AS y FROM (
            SELECT *, (lo + hi) / 2 AS x, (lo + hi) / 2 <= 0.5 AS under FROM bq WHERE n < 40))))),
"""

EXPLAINED = """
ex AS (SELECT *, concat_ws('; ', CASE WHEN s_err > 20 THEN printf('elevated error rate (S_err=%.1f)', s_err) END, CASE WHEN s_explore > 20 THEN printf('abnormal exploration/scanning (S_explore=%.1f)', s_explore) END,
    CASE WHEN s_hammer > 20 THEN printf('hammering/low-diversity pattern (S_hammer=%.1f)', s_hammer) END, CASE WHEN s_burst > 20 THEN printf('rate anomaly (S_burst=%.1f)', s_burst) END,
    CASE WHEN s_persist > 20 THEN printf('persistent across windows (S_persist=%.1f)', s_persist) END, CASE WHEN s_spread > 20 THEN printf('suspicious spread (S_spread=%.1f)', s_spread) END,
    CASE WHEN s_dominance > 20 THEN printf('traffic dominance (S_dominance=%.1f)', s_dominance) END) AS reasons,
    concat_ws(', ', CASE WHEN d_volume > 10 THEN printf('low volume uncertainty (-%.0f)', d_volume) END, CASE WHEN d_new > 10 THEN printf('new content grace (-%.0f)', d_new) END) AS notes FROM dc),
"""


def sql(blocks: list[str], query: str, hammer: int = 500) -> str:
    body = ",\n".join(x.strip().rstrip(",") for x in blocks)
    start = "WITH RECURSIVE" if any("rec AS" in x or "bq AS" in x for x in blocks) else "WITH"
    return f"{start} {body}\n{query}".replace("HAMMER", str(hammer))

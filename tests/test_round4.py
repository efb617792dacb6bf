"""What the detector need not sort, deal out or store: networks' paths, pairs of clients, entities without a verdict."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from logwarden.config import DetectConfig
from logwarden.functions import network
from logwarden.jobs import detect
from logwarden.operators import entities, prefixes
from logwarden.streaming import detector

PATHS = "entity_type string, entity_value string, w long, path string, n long"


def counted(spark, rows):
    frame = spark.createDataFrame(rows, PATHS).withColumn("depth", F.length("path"))
    return frame.withColumns({c: F.lit(0).cast("long") for c in ("n_2xx", "n_3xx", "n_4xx", "n_5xx", "window_start", "window_end", "first_seen", "last_seen")})


def test_networks_are_added_up_without_sorting(spark):
    made = entities.path_metrics(counted(spark, [("cidr", "c", 0, p, n) for p, n in (("/aa", 2), ("/ab", 3), ("/b" * 9, 3))]))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # what is sorted has been filtered before
    assert plan.count("Window [lag(path") == plan.count("Window [lag(stem") == 1 and "NOT (entity_type" in plan[plan.index("Window [lag(path") :].split("Aggregate")[0]
    r = made.first()
    assert (r["total_requests"], r["unique_paths"], r["top_path"], r["uniq_prefix_2"]) == (8, 3, "/b" * 9, 0)


def test_side_counts_equal_distinct_counts(spark):
    rng = random.Random(21)
    rows = [(rng.randrange(2), f"10.0.{rng.randrange(3)}.{rng.randrange(9)}", rng.choice([None, "a", "b", "c"]), rng.choice([None, "r1", "r2"]), f"/p{rng.randrange(5)}") for _ in range(300)]
    grain = spark.createDataFrame([(*r, r[1].rsplit(".", 1)[0]) for r in rows], "w long, ip string, ua string, ref string, path string, cidr string")
    at = {"w": 0, "ip": 1, "ua": 2, "ref": 3, "path": 4, "cidr": 5}
    rows = [(*r, r[1].rsplit(".", 1)[0]) for r in rows]
    for types in (("ip", "ua", "cidr"), ("path", "ref"), ("ua",)):
        got = {(r["entity_type"], r["entity_value"], r["w"]): (r["unique_uas"], r["unique_ips"], r["unique_refs"]) for r in entities.side_counts(grain, types).collect()}
        for t in types:
            for value, w in {(r[at[t]], r[0]) for r in rows if r[at[t]] is not None}:
                own = [r for r in rows if r[at[t]] == value and r[0] == w]
                many = lambda c: len({r[at[c]] for r in own} - {None})  # noqa: E731, B023
                want = (many("ua") if t in ("ip", "cidr") else 0, many("ip") if t in ("ua", "cidr") else 0, many("ref"))
                assert got.get((t, value, w), (0, 0, 0)) == want


def test_plain_ipv6_is_cut_as_text_with_the_same_result(spark):
    rng = random.Random(22)
    group = lambda: rng.choice(["0", "00", "f8", "2a03", "0db8", "ABCD", "zz", "12345", ""]) if rng.random() < 0.2 else format(rng.randrange(1, 65536), "x")
    ips = {":".join(group() for _ in range(rng.randrange(9))) + rng.choice(["::", "::", ":", ":::"]) + ":".join(group() for _ in range(rng.randrange(9))) for _ in range(3000)}
    frame = spark.createDataFrame([(x,) for x in ips], "ip string")
    assert frame.filter(network._plain_ipv6(F.col("ip"), 3)).count() > 100

    def want(ip, length):
        try:
            return str(ipaddress.ip_network(f"{ip}/{length}", strict=False))
        except ValueError:
            return ip

    for length in (32, 48, 96):
        assert {r["ip"]: r["n"] for r in frame.select("ip", network.network_of(F.col("ip"), 24, length).alias("n")).collect()} == {x: want(x, length) for x in ips}


def test_only_entities_with_a_verdict_are_scored(spark):
    zero = {c: 0.0 for c in ("s_err", "s_explore", "s_burst", "s_spread", "s_cross", "s_dominance", "d_new", "d_volume", "d_legit")}
    rows = [("cidr", "bad", 0, 90.0), ("cidr", "bad", 1, 0.0), ("ip", "good", 0, 0.0), ("ip", "good", 1, 0.0)]
    signals = spark.createDataFrame(rows, "entity_type string, entity_value string, w long, s_hammer double").withColumns({c: F.lit(v) for c, v in zero.items()})
    signals = signals.withColumns({"s_err": F.col("s_hammer"), "s_burst": F.col("s_hammer")})
    kept = detect.suspects(signals, DetectConfig())
    assert sorted((r["entity_value"], r["w"]) for r in kept.collect()) == [("bad", 0), ("bad", 1)]
    whole = detect.score(signals).filter("decided").select("entity_value", "w", "score", "streak").collect()
    assert whole and detect.score(kept).filter("decided").select("entity_value", "w", "score", "streak").collect() == whole


def test_requests_to_new_prefixes_from_common_beginnings(spark):
    """Counts by stem give what counts by path give."""
    rows = [("ip", e, 0, f"/new{k % 7}/{k}" if k % 2 else f"/old/{k}", 1 + k % 3) for e in ("1", "2") for k in range(40)] + [("ip", "1", 0, "/", 9)]
    paths = counted(spark, rows).withColumns({c: F.timestamp_seconds(F.lit(300)) for c in ("window_end",)})
    state = spark.createDataFrame([(0, f"/new{k}/", 200, 0.0) for k in range(7)] + [(0, "/old/0", 5, 0.0)], "w long, prefix string, unique_ips long, error_rate double").withColumn("tofs", F.timestamp_seconds(F.lit(0)))
    key = lambda f: sorted((r["entity_value"], r["new_requests"]) for r in f.collect())
    want = sorted((e, sum(n for _, x, _, p, n in rows if x == e and p.startswith("/new"))) for e in ("1", "2"))
    stems = entities.path_stems(paths).withColumnRenamed("stem", "path")
    assert key(prefixes.new_requests(paths, state)) == key(prefixes.new_requests(stems, state)) == want


def test_streams_keep_dense_state_and_two_versions(spark):
    detector.use_state_store(spark)
    conf = "spark.sql.streaming."
    assert [spark.conf.get(conf + c) for c in ("stateStore.compression.codec", "stateStore.rocksdb.compression", "minBatchesToRetain")] == ["zstd", "zstd", "2"]

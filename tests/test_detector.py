"""Windows, entities, prefixes, and the detector end to end."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logwarden.config import DetectConfig
from logwarden.jobs import detect, replay, report
from logwarden.operators import entities, prefixes, rates, windows
from logwarden.sources import logs
from logwarden.streaming import detector

T0 = dt.datetime(2025, 9, 25, 19)
SCHEMA = "ts timestamp, ip string, ua string, ref string, path string, verb string, status int, status_class string"


def log(spark, rows):
    full = [(T0 + dt.timedelta(seconds=s), ip, ua, None, path, "GET", st, f"{st // 100}xx") for s, ip, ua, path, st in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_window_edges(spark):
    at = lambda *secs: sorted(r["w"] for r in windows.assign_windows(log(spark, [(s, "1.1.1.1", None, "/", 200) for s in secs])).collect())
    assert at(0, 299, 300, 601) == [0, 0, 1, 2]
    assert at(0, 299, 600) == [0, 0]
    assert at(5, 5) == []
    assert windows.training_window(log(spark, [(s, "1.1.1.1", None, "/", 200) for s in (0, 3600, 3601)])).count() == 2


def grain(spark, rows, **options):
    return detect.grain_of(log(spark, [*rows, (299, "9.9.9.9", None, "/end", 200)]), DetectConfig(**options))


def test_entity_metrics(spark):
    rows = [(0, "1.1.1.1", "Mozilla", "/path1", 404), (1, "1.1.1.1", "Mozilla", "/path2", 200), (2, "1.1.1.1", "curl", "/path1", 404)]
    m = entities.entity_metrics(grain(spark, rows)).filter("entity_value = '1.1.1.1'").first()
    assert m["error_rate"] == pytest.approx(2 / 3) and m["explore_ratio"] == pytest.approx(2 / 3) and m["top_path_ratio"] == pytest.approx(2 / 3)
    assert m["unique_uas"] == 2 and m["unique_ips"] == 0 and m["top_path"] == "/path1" and m["methods"] == {"GET": 3} and m["depth_score"] == 6


def test_networks_are_sums_of_their_addresses(spark):
    rows = [(k, f"10.0.0.{k % 7}", f"ua{k % 3}", f"/p{k % 11}/abcdefgh", (200, 301, 404, 503)[k % 4]) for k in range(150)]
    every = entities.entity_metrics(grain(spark, rows)).collect()
    net = next(r for r in every if r["entity_value"] == "10.0.0.0/24")
    own = [r for r in every if r["entity_type"] == "ip" and r["entity_value"].startswith("10.")]
    for c in ("total_requests", "error_count", "status_2xx", "status_3xx", "status_4xx", "status_5xx"):
        assert net[c] == sum(r[c] for r in own)
    assert net["unique_ips"] == 7 and net["unique_uas"] == 3 and net["unique_paths"] == 11 and net["depth_score"] == 0 and net["uniq_prefix_2"] == 0
    merged = entities.entity_metrics(grain(spark, rows), DetectConfig(cidr_depth="merged")).filter("entity_type = 'cidr' and entity_value like '10.%'").first()
    assert merged["depth_score"] > 0 and merged["uniq_prefix_4"] > 0
    about = entities.entity_metrics(grain(spark, rows), approximate=True).filter("entity_type = 'cidr' and entity_value like '10.%'").first()
    assert about["unique_ips"] == 7


def test_missing_agent_counts_elsewhere(spark):
    m = entities.entity_metrics(grain(spark, [(0, "1.1.1.1", None, "/a", 200)])).collect()
    assert {r["entity_type"] for r in m if r["w"] == 0 and r["total_requests"]} == {"ip", "cidr"}


def test_prefixes(spark):
    rows = [(0, "1.1.1.1", "a", "/4cHCCP5v8YP_K73rMwVH0iMr", 200), (1, "1.1.1.1", "b", "/4cHCCP5v8YP_K73rMwVH0iMrA", 404), (2, "2.2.2.2", None, "/4cHCCP5v8YP_K73rMwVH0iMrB", 200)]
    stats = {(r["depth"], r["prefix"]): r for r in prefixes.prefix_stats(log(spark, rows)).collect()}
    s = stats[8, "/4cHCCP5"]
    assert (s["hits"], s["unique_ips"], s["unique_uas"]) == (3, 2, 2) and s["error_rate"] == pytest.approx(1 / 3) and s["tofs"] == T0 and s["status_dist"] == {"2xx": 2, "4xx": 1}
    wanted = spark.createDataFrame([(8, "/4cHCCP5"), (8, "/nothing")], "depth int, prefix string")
    found = {r["prefix"]: r for r in prefixes.prefix_lookup(wanted, prefixes.prefix_stats(log(spark, rows))).collect()}
    assert found["/nothing"]["hits"] == 0 and found["/nothing"]["tofs"] is None and found["/4cHCCP5"]["hits"] == 3


def bot_log(spark):
    rows = [(k * 9 % 7200, f"203.0.113.{k % 100}", "netbot/1.0", "/same" if k % 20 else f"/x{k}", 301) for k in range(4000)]
    rows += [(k * 5 % 7200, f"10.{k % 50}.0.1", f"ua{k % 9}", f"/page/{k % 40}/{'y' * (k % 30)}", 200 if k % 19 else 404) for k in range(4000)]
    return log(spark, rows)


def test_detector_finds_the_network(spark):
    cfg = DetectConfig(n_hammer_min=50, new_min_ips=10_000)
    scored = detect.score(detect.base_signals(detect.grain_of(bot_log(spark), cfg), detect.train(bot_log(spark), cfg), cfg), cfg)
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low and high <= 100
    found = detect.decisions(scored)
    assert {r["entity_value"] for r in found.filter("entity_type = 'cidr'").collect()} == {"203.0.113.0/24"}
    top = report.top_offenders(found, top=1).collect()
    assert all(r["place"] == 1 for r in top) and "203.0.113.0/24" in {r["entity_value"] for r in top}
    ordered = report.in_order(found).collect()
    assert [r["w"] for r in ordered] == sorted(r["w"] for r in ordered)


def test_no_block_without_evidence(spark):
    rows = [(k, "5.5.5.5", None, f"/{k}", 301) for k in range(100)] + [(k, f"6.6.{k % 40}.6", "ua", f"/q{k % 5}", 200) for k in range(400)]
    assert detect.detect(log(spark, [*rows, (400, "7.7.7.7", None, "/", 200)])).filter("entity_type = 'ip'").count() == 0


def test_empty_log(spark):
    assert detect.detect(log(spark, [])).count() == 0


def test_write_decisions(spark, tmp_path):
    cfg = DetectConfig(n_hammer_min=50, new_min_ips=10_000)
    found = detect.detect(bot_log(spark), cfg)
    for fmt in ("json", "parquet"):
        logs.write_decisions(found, f"{tmp_path}/{fmt}", fmt)
        back = spark.read.format(fmt).load(f"{tmp_path}/{fmt}")
        assert back.count() == found.count() and back.filter("round(score, 2) != score").count() == 0


def test_streaming_equals_batch(spark):
    cfg = DetectConfig(n_hammer_min=50, new_min_ips=10_000)
    key = lambda f: sorted((r["w"], r["entity_type"], r["entity_value"], round(r["score"], 8), r["streak"]) for r in f.collect())
    assert key(replay.run_detector(bot_log(spark), cfg)) == key(detect.detect(bot_log(spark), cfg))


def test_streamed_averages_reach_back_without_end(spark):
    """A slow average and a long history over many windows and batches: the stream equals the batch."""
    cfg = DetectConfig(n_hammer_min=20, ewma_alpha=0.02, rate_history=20, thresholds={"ip": 10.0, "ua": 10.0, "cidr": 10.0})
    rows = [(300 * w + k, f"1.1.1.{k % 2}", "ua", f"/page/{k % 3}", 404) for w in range(45) for k in range(30 if w < 10 else 4 + w % 5)]
    frame = log(spark, rows)
    key = lambda f: sorted((r["w"], r["entity_type"], r["entity_value"], round(r["score"], 8), r["streak"]) for r in f.collect())
    want = key(detect.detect(frame, cfg))
    assert want and key(replay.run_detector(frame, cfg, parts=3)) == want


def test_stream_reads_no_more_as_it_goes_on(spark, tmp_path):
    """Every batch has the same traffic of known clients; what it reads of the state does not grow with its number."""
    cfg, t0 = DetectConfig(n_hammer_min=50), T0.replace(tzinfo=dt.UTC).timestamp()
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(k * 2, f"10.0.{k % 60}.{k % 7}", f"ua{k % 5}", f"/page/{k % 40}", 200) for k in range(1800)]
    table = detect.train(log(spark, rows), cfg)
    detector.use_state_store(spark)
    sizes, clients = [], []
    for hour in range(4):
        log(spark, [(s + 3600 * hour, *rest) for s, *rest in rows]).write.mode("append").parquet(source)
        query = detector.start_detector(spark.readStream.schema(SCHEMA).parquet(source), table, t0, out, cfg)
        query.awaitTermination()
        state = [sum(p.stat().st_size for p in (tmp_path / "out" / name).rglob("*.parquet")) for name in detector.STATE]
        sizes.append(sum(state))
        clients.append(sum(o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"] if "transformWithState" in o["operatorName"]))
        assert not (tmp_path / "out" / "seen").exists()
    assert clients[0] > 0 and clients[1] == clients[-1]
    assert max(sizes[1:]) <= 1.25 * sizes[1], sizes


def test_late_rows_are_dropped(spark):
    early, late = log(spark, [(0, "1.1.1.1", None, "/", 200), (7200, "1.1.1.1", None, "/", 200)]), log(spark, [(10, "2.2.2.2", None, "/", 200), (7100, "3.3.3.3", None, "/", 200)])
    got = replay.run_late_rows(early.select("ts", "ip", "status"), late.select("ts", "ip", "status"))
    assert {r["ip"] for r in got.collect()} == {"1.1.1.1", "3.3.3.3"}


def test_streamed_rates_start_anew_after_a_pause(spark):
    rows = [(300 * w + k, "1.1.1.1", "ua" if w < 3 else None, "/", 200) for w in (0, 1, 2, 14, 40, 41) for k in range(1 + 7 * (w % 3))]
    frame = log(spark, [*rows, (300 * 42, "9.9.9.9", None, "/", 200)])
    got = {(r["entity_value"], r["w"]): r for r in replay.run_rates(frame).collect()}
    state = rates.cusum(rates.rate_state(entities.entity_metrics(detect.grain_of(frame)))).collect()
    assert {(r["entity_value"], r["w"]) for r in state} == set(got)
    for r in state:
        own = got[r["entity_value"], r["w"]]
        assert [own[c] for c in ("rate", "ewma", "std", "cusum")] == pytest.approx([r[c] for c in ("rate", "ewma", "std", "cusum")])
    assert got["1.1.1.1", 14]["session_start"] == 0 and got["1.1.1.1", 41]["session_start"] == 40


def test_parse_is_not_repeated(spark):
    lines = spark.createDataFrame([("x",)], "value string")
    plan = logs.requests(logs.parse_lines(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 3 and plan.count("Join") == 0 and "PythonUDF" not in plan

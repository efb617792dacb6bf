"""Golden values of FIXTURES.md for parsing, networks, statistics, scoring and rates."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.config import DEFAULT
from logwarden.functions import network, parsing, scoring, special
from logwarden.operators import baseline, persistence, rates
from logwarden.sources import logs

LINES = [
    '46.42.143.239 - - [25/Sep/2025:19:00:01 +0000] "GET /4cHCCP5v8YP_K73rMwVH0iMr HTTP/1.1" 301 169 "-" "OpenWebReader/0.3a1"',
    '154.249.137.8 - - [25/Sep/2025:19:04:21 +0200] "GET /abc HTTP/1.0" 408 0 "-" "-"',
    "HIT|200|1756631440572|1314|4029805|111.187.127.0|-|https://download.example.org/v3/list.md.minisig|LA|proxy|b8ca|CN",
    "HIT|199|1756631440572|1314|4029805|111.187.127.0|-|https://x.example.org/a;b/c;p=1?q=2#f|LA|proxy|b8ca|CN",
    "HIT|600|1756631440572|1314|4029805|2A03:0:0:1::5|http://r/|https://x.example.org|LA|proxy|b8ca|CN",
    '1.2.3.4 - alice [25/Sep/2025:19:00:01 +0000] "GET / HTTP/1.1" 200 1 "-" "x"',
    '1.2.3.4 - - [25/Sep/2025:19:00:01 +0000] "get / HTTP/1.1" 200 1 "-" "x"',
    "",
    "2025-09-25T19:00:00 host newsyslog[1]: logfile turned over",
    '1.2.3.4 - - [31/Feb/2025:19:00:01 +0000] "GET / HTTP/1.1" 200 1 "-" "x"',
    "HIT|200|1756631440572|1314|4029805|1.1.1.1|-|https://x.example.org/|LA|proxy|b8ca",
    '5.6.7.8 - - [5/sep/2025:09:00:01 +0000] "POST /x?y=1 HTTP/1.1" 200 1 "http://r" "ua" trailing',
]


def test_parse_lines(spark):
    frame = spark.createDataFrame([(n, x) for n, x in enumerate(LINES)], "n int, value string")
    rows = {r["n"]: r for r in logs.parse_lines(frame).collect()}
    assert [rows[n]["reject"] for n in range(len(LINES))] == [None] * 5 + ["no match", "no match", "blank", "rotation", "bad timestamp", "no match", None]
    assert rows[0]["status_class"] == "3xx" and rows[0]["ref"] is None and rows[0]["ua"] == "OpenWebReader/0.3a1" and rows[0]["extras"] == {}
    assert rows[1]["ts"] == dt.datetime(2025, 9, 25, 19, 4, 21) and rows[1]["ua"] is None and rows[1]["status_class"] == "4xx"
    assert rows[2]["path"] == "/v3/list.md.minisig" and rows[2]["verb"] == "GET" and rows[2]["extras"]["country"] == "CN"
    assert rows[2]["ts"] == dt.datetime(2025, 8, 31, 9, 10, 40, 572000)
    assert rows[3]["path"] == "/a;b/c" and rows[3]["status_class"] == "other"
    assert rows[4]["path"] == "/" and rows[4]["status_class"] == "other" and rows[4]["ref"] == "http://r/"
    assert rows[11]["path"] == "/x?y=1" and rows[11]["verb"] == "POST" and rows[11]["ts"] == dt.datetime(2025, 9, 5, 9, 0, 1)
    good = {r["ip"]: r["ip_hex"] for r in logs.requests(logs.parse_lines(frame)).collect()}
    assert good["2a03:0:0:1::5"] == "2a030000000000010000000000000005" and good["46.42.143.239"] == "2e2a8fef".rjust(32, "0")
    assert {r["reject"]: r["n"] for r in logs.load_report(logs.parse_lines(frame)).filter("reject is not null").groupBy("reject").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {"no match": 3, "blank": 1, "rotation": 1, "bad timestamp": 1}


def test_explicit_and_file_formats(spark, tmp_path):
    frame = spark.createDataFrame([(x,) for x in LINES], "value string")
    assert {r["fmt"] for r in logs.parse_lines(frame, "cdn").filter("reject is null").collect()} == {"cdn"}
    (tmp_path / "a.log").write_text("\n".join(["", LINES[2], LINES[0]]))
    (tmp_path / "b.log").write_text("\n".join([LINES[0], LINES[2]]))
    (tmp_path / "c.log").write_text("nothing here")
    lines = logs.read_lines(spark, str(tmp_path))
    found = {r["file"][-5:]: r["fmt"] for r in logs.detect_formats(lines).collect()}
    assert found == {"a.log": "cdn", "b.log": "combined", "c.log": "combined"}
    parsed = logs.parse_lines(lines.join(logs.detect_formats(lines), "file")).filter("reject is null")
    assert sorted((r["file"][-5:], r["fmt"]) for r in parsed.collect()) == [("a.log", "cdn"), ("b.log", "combined")]


def test_networks(spark):
    cases = {
        "192.168.1.100": "192.168.1.0/24", "2a03:2880:f804:c::": "2a03:2880:f804::/48", "93.190.138.45": "93.190.138.0/24", "::1": "::/48", "2A03:0:0:1::5": "2a03::/48",
        "2001:0db8:00f0:1:2:3:4:5": "2001:db8:f0::/48", "0:0:5::1": "0:0:5::/48", "not-an-ip": "not-an-ip", "1::2:3:4:5:6:7": "1:0:2::/48", "01.2.3.4": "01.2.3.4", "256.1.1.1": "256.1.1.1", "no:ip": "no:ip",
    }
    frame = spark.createDataFrame([(x,) for x in [*cases, None]], "ip string")
    rows = network.ip_dimension(frame).collect()
    assert {r["raw"]: r["cidr"] for r in rows} == cases
    assert {r["raw"] for r in rows if r["is_v6"]} == {x for x in cases if ":" in x and x != "no:ip"}
    assert network.ip_dimension(frame, v4_length=20).filter("raw = '192.168.17.100'").count() == 0
    nets = spark.createDataFrame([("10.1.2.3/24",), ("2a03::1/48",), ("x",), (None,)], "cidr string")
    assert {r["raw"]: r["canonical"] for r in network.network_base(nets).collect()} == {"10.1.2.3/24": "10.1.2.0/24", "2a03::1/48": "2a03::/48", "x": "x"}
    odd = spark.createDataFrame([("192.168.17.100",)], "ip string")
    assert network.ip_dimension(odd, v4_length=20).first()["cidr"] == "192.168.16.0/20"


def test_url_paths(spark):
    cases = {"https://h/a;b/c;p=1?q=2#f": "/a;b/c", "https://h": "/", "//h/x": "/x", "/x?y": "/x", "http://h/?q": "/"}
    rows = spark.createDataFrame([(x,) for x in cases], "url string").select("url", parsing.url_path(F.col("url")).alias("p")).collect()
    assert {r["url"]: r["p"] for r in rows} == cases


def prior(spark, values):
    row = spark.createDataFrame([(float(v),) for v in values], "v double").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).select(baseline.prior(F.col("m"), F.col("s")).alias("p")).first()["p"]
    return row["alpha"], row["beta"]


def test_prior_and_posterior(spark):
    a, b = prior(spark, [0.05, 0.08, 0.06, 0.07, 0.09, 0.04])
    assert (a, b) == pytest.approx((13.4791428571, 193.8922857143))
    assert prior(spark, [0.05, 0.08, 0.06]) == pytest.approx((24.0892857143, 356.2678571429))
    assert prior(spark, [0.1, 0.1]) == (1.0, 1.0)
    assert prior(spark, []) == (1.0, 1.0)
    assert (a + 80) / (a + b + 100) == pytest.approx(0.3041243726)
    tail = 1 - special.beta_cdf(np.array([0.18, 0.18, 0.18]), np.array([a + 80, a + 20, 3.0]), np.array([b + 20, b + 80, 9.0]))
    assert tail == pytest.approx([0.9999999263, 0.0002390251, 0.6835525266], abs=1e-9)


def test_beta_and_poisson():
    rng = np.random.default_rng(0)
    x, a, b = rng.uniform(0, 1, 200), rng.uniform(0.5, 900, 200), rng.uniform(0.5, 900, 200)
    assert special.beta_cdf(x, a, b) == pytest.approx(1 - special.beta_cdf(1 - x, b, a), abs=1e-11)
    p = special.beta_quantile(np.array([0.025, 0.5, 0.975]), np.array(4.0), np.array(7.0))
    assert special.beta_cdf(p, np.array(4.0), np.array(7.0)) == pytest.approx([0.025, 0.5, 0.975])
    assert special.poisson_tail(np.array([0.0, 2.0]), np.array([0.5, 0.0])) == pytest.approx([1 - math.exp(-0.5), 1.0])
    exact = 1 - sum(math.exp(k * math.log(900) - 900 - math.lgamma(k + 1)) for k in range(931))
    assert special.poisson_tail(np.array([930.5]), np.array([900.0])) == pytest.approx([exact])


def test_robust_z(spark):
    def z(value, values):
        rows = spark.createDataFrame([("m", float(v)) for v in values], "metric string, value double")
        t = baseline.baseline_table(rows).withColumn("x", F.lit(value))
        return t.select(baseline.robust_z(F.col("x"), F.col("median"), F.col("mad")).alias("z")).first()["z"]

    assert z(0.8, [0.1, 0.12, 0.11, 0.13, 0.09, 0.11]) == pytest.approx(46.5398624039)
    assert z(1.0, [0.1, 0.12]) == pytest.approx(60.0296775934)
    assert z(1.0, [0.1, 0.1]) == 0.0


def series(spark, counts, start=0, step=1):
    rows = [("ip", "x", start + k * step, int(n)) for k, n in enumerate(counts)]
    return spark.createDataFrame(rows, "entity_type string, entity_value string, w long, total_requests long")


def test_first_window_burst(spark):
    for n, expected in ((1, 99.8334721451), (150, 77.8800783071), (300, 85.7763884961), (750, 73.7436855523), (30000, 72.5646055960)):
        assert rates.rate_state(series(spark, [n])).first()["s_burst"] == pytest.approx(expected)


def test_rates_match_sequential_fold(spark):
    state = rates.cusum(rates.rate_state(series(spark, [300, 300, 300, 1500, 1500, 1500]))).orderBy("w").collect()
    assert [r["ewma"] for r in state] == pytest.approx([1, 1, 1, 2.2, 3.04, 3.628])
    assert [r["std"] for r in state] == pytest.approx([0, 0, 0, 1.7320508, 1.9595918, 2])
    assert [r["cusum"] for r in state] == pytest.approx([0] * 6)
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 3000, 300)
    rows = rates.cusum(rates.rate_state(series(spark, counts))).orderBy("w").collect()
    e, s = None, 0.0
    for k, r in enumerate(rows):
        x = counts[k] / 300
        e = x if e is None else 0.3 * x + 0.7 * e
        std = float(np.std(counts[max(0, k - 99) : k + 1] / 300)) if k else 0.0
        s = max(0.0, s + (x - e) / max(std, 1e-6) - 2)
        assert (r["ewma"], r["std"], r["cusum"]) == pytest.approx((e, std, s), abs=1e-9)


def test_idle_sessions(spark):
    """The closed form of the reset against a loop over windows with pruning every 12."""
    for first in range(0, 24, 5):
        for later in range(first + 1, first + 40, 3):
            frame = spark.createDataFrame([("ip", f"{first}-{later}", w, 10) for w in (first, later)], "entity_type string, entity_value string, w long, total_requests long")
            got = rates.sessions(frame).agg(F.max("session")).first()[0] if (first, later) in ((0, 16), (5, 23), (0, 25), (10, 37)) else None
            expected = any(p % 12 == 0 and first + 12 < p for p in range(first + 1, later))
            closed = 12 * math.ceil((first + 13) / 12) <= later - 1
            assert closed == expected
            assert got is None or bool(got) == expected


def test_signals(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(scoring.exploration_signal(F.lit(0.0))) == pytest.approx(11.9202922022)
    assert value(scoring.exploration_signal(F.lit(4.0))) == pytest.approx(50)
    assert value(scoring.exploration_signal(F.lit(5.1))) == pytest.approx(63.4135591008)
    assert value(scoring.persistence_signal(F.lit(3))) == 60 and value(scoring.persistence_signal(F.lit(9))) == 100
    assert value(scoring.spread_signal(F.lit("ua"), F.lit(300), F.lit(0))) == 20 and value(scoring.spread_signal(F.lit("ip"), F.lit(0), F.lit(4))) == 0
    assert value(scoring.hammer_signal(F.lit(499), F.lit(0.9), F.lit(0.9), F.lit(0.9))) == 0
    assert value(scoring.hammer_signal(F.lit(500), F.lit(0.7), F.lit(0.5), F.lit(0.1))) == pytest.approx(50)
    assert value(scoring.volume_dampener(F.lit(25))) == 20


def test_case_score(spark):
    parts = {"s_explore": None, "s_hammer": 0.0, "s_burst": 0.0, "s_persist": 60.0, "s_spread": 0.0, "s_cross": 0.0, "s_dominance": 0.0, "d_new": 0.0, "d_volume": 0.0, "d_legit": 0.0, "entity_type": "ip"}
    frame = spark.range(1).withColumns({k: F.lit(v) for k, v in parts.items() if v is not None})
    frame = frame.withColumn("s_explore", scoring.exploration_signal(F.lit(5.1))).withColumn("s_err", scoring.error_signal(F.lit(0.62), F.lit(0.997), F.lit(0.08)))
    row = frame.select(scoring.final_score().alias("score"), scoring.consensus().alias("ok"), scoring.explanation().alias("why")).first()
    assert row["score"] == pytest.approx(45.3304406382) and row["ok"]
    assert row["why"] == "elevated error rate (S_err=99.7); abnormal exploration/scanning (S_explore=63.4); persistent across windows (S_persist=60.0)"


def test_durations(spark):
    scores = [55.0, 60.0, 70.0, 75.0, 80.0, 89.99, 90.0, 100.0]
    want = {"ip": [0, 0, 0, 848, 1200, 2398, 21600, 21600], "ua": [0, 0, 0, 848, 1200, 2398, 21600, 21600], "cidr": [0, 0, 0, 3600, 3600, 3600, 21600, 21600], "path": [0, 900, 2700, 3600, 3600, 3600, 21600, 21600]}
    frame = spark.createDataFrame([(k, s) for k in want for s in scores], "kind string, s double")
    got = {(r["kind"], r["s"]): r["d"] for r in frame.withColumn("d", scoring.duration(F.col("s"), F.col("kind"))).collect()}
    assert got == {(k, s): d for k in want for s, d in zip(scores, want[k], strict=True)}


def test_feedback_matches_full_fold(spark):
    """The prefilter of the streak feedback against folding every entity in order."""
    rng = np.random.default_rng(2)
    rows = []
    for e in range(60):
        for w in sorted(rng.choice(40, rng.integers(1, 20), replace=False).tolist()):
            at = int(rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 6, 6]))
            rows.append(("ip", f"e{e}", w, [k >= at for k in range(6)]))
    frame = spark.createDataFrame(rows, "entity_type string, entity_value string, w long, verdicts array<boolean>")
    got = {(r["entity_value"], r["w"]): (r["streak"], r["decided"]) for r in persistence.feedback(frame).collect()}
    run: dict[str, int] = {}
    want = {}
    for _, e, w, v in sorted(rows, key=lambda r: (r[1], r[2])):
        n = run.get(e, 0)
        want[e, w] = (n, v[min(n, 5)])
        run[e] = n + 1 if v[min(n, 5)] else 0
    assert got == want


def test_config_weights():
    w = DEFAULT.weights
    assert w.err + w.explore + w.hammer + w.burst + w.persist + w.spread + w.cross + w.dominance == pytest.approx(1.0)

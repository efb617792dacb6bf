"""Lines and late rows as streams."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from logwarden.config import DEFAULT
from logwarden.jobs import derived, detect, registry, replay
from logwarden.operators import entities
from logwarden.sources import logs
from logwarden.sources.scratch import folders, scratch_dir, temporary_tables
from logwarden.streaming import late, lines

T0 = dt.datetime(2025, 9, 25, 19)


def combined(k):
    return f'10.0.0.{k % 9} - - [25/Sep/2025:19:{k % 60:02d}:00 +0000] "GET /p{k} HTTP/1.1" 200 1 "-" "ua"'


def cdn(k):
    return f"HIT|200|{1758826800000 + k * 1000}|1|1|10.1.0.{k % 9}|-|https://h/c{k}|LA|ua|id{k}|CN"


def write(folder, name, rows):
    (folder / name).write_text("\n".join(rows) + "\n")


def key(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("by_file", [False, True])
def test_stream_of_lines_equals_batch_also_after_a_failure(spark, tmp_path, monkeypatch, by_file):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    write(source, "a.log", ["", *[combined(k) for k in range(40)], "2025-09-25T20:00:00 host newsyslog[1]: logfile turned over", cdn(1)])
    write(source, "b.log", [*[cdn(k) for k in range(30)], "nonsense", combined(99), "  "])
    stream = lambda: lines.stream_lines(spark, str(source), 1)
    # a batch fails once, between its two tables
    real, calls = logs.requests, []

    def failing(parsed):
        calls.append(1)
        if len(calls) == 2:
            real(parsed).write.mode("overwrite").parquet(f"{out}/requests/batch=1")
            raise RuntimeError("executor lost")
        return real(parsed)

    monkeypatch.setattr(logs, "requests", failing)
    with pytest.raises(Exception, match="executor lost"):
        lines.start_parsing(stream(), out, by_file).awaitTermination()
    lines.start_parsing(stream(), out, by_file).awaitTermination()
    write(source, "c.log", [cdn(k) for k in range(100, 120)])
    lines.start_parsing(stream(), out, by_file).awaitTermination()
    monkeypatch.setattr(logs, "requests", real)
    whole = logs.read_lines(spark, str(source))
    whole = whole.join(logs.detect_formats(whole), "file") if by_file else whole
    parsed = logs.parse_lines(whole)
    got, bad = lines.parsed_requests(spark, out), lines.rejected_lines(spark, out)
    assert key(got) == key(logs.requests(parsed))
    assert key(bad.select("value", "fmt", "reject")) == key(parsed.filter("reject is not null").select("value", "fmt", "reject"))
    assert got.count() + bad.count() == whole.count() and bad.count() == (6 if by_file else 4)


def rows(spark, secs, ip):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), ip, 404 if s % 2 else 200) for s in secs], "ts timestamp, ip string, status int")


def test_late_rows_are_kept(spark):
    early, last = rows(spark, [0, 10, 299, 300, 7200, 7201], "1.1.1.1"), rows(spark, [5, 6300, 6599, 6600, 7100], "2.2.2.2")
    got = {(int((r["window_start"] - T0).total_seconds()), r["ip"]): (r["windows_late"], r["n"], r["errors"]) for r in replay.run_counts(early, last).collect()}
    # the bound is 7201 - 600 = 6601: windows that end at 6600 or before are late
    assert got == {
        (0, "1.1.1.1"): (None, 3, 1), (300, "1.1.1.1"): (None, 1, 0), (7200, "1.1.1.1"): (None, 2, 1),
        (0, "2.2.2.2"): (21, 1, 1), (6300, "2.2.2.2"): (0, 2, 1), (6600, "2.2.2.2"): (None, 1, 0), (6900, "2.2.2.2"): (None, 1, 0),
    }


def test_counts_keep_every_row_once_whatever_the_order(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema, total = None, 0
    for secs in ([4000, 4100], [0, 10, 8000], [3000, 7900, 7300], [], [20_000], [19_900, 100]):
        frame = rows(spark, secs, "1.1.1.1").unionByName(spark.createDataFrame([(None, "no time", 200)], "ts timestamp, ip string, status int").limit(int(len(secs) == 3)))
        schema, total = frame.schema, total + frame.count()
        frame.write.mode("append").parquet(source)
        late.start_counts(spark.readStream.schema(schema).parquet(source), out).awaitTermination()
    open_ = late.last_version(spark, out, late.STATE, 1 << 40)[1]["open"]
    done = late.counted(spark, out)
    assert done.agg(F.sum("n")).first()[0] + open_.agg(F.sum("n")).first()[0] == total
    assert done.filter("window_start is null").count() == 2 and done.groupBy("window_start", "ip", "windows_late").count().filter("count > 1 and window_start is not null and windows_late is null").count() == 0


def test_streams_and_jobs_leave_nothing_in_the_shared_folder(spark, tmp_path):
    """What queries write, the folders of streams included, goes with the scope; a stream's report of decisions stays."""
    sf = "/root/testdata/sf0.001"
    before = set(folders(spark, scratch_dir(spark)))
    with temporary_tables():
        for name in ("file_formats", "written_decisions", "method_counts", "stream_window_counts"):
            registry.queries()[name](spark, sf).collect()
        decided = replay.run_detector(derived.requests(spark, sf), replace(DEFAULT, n_hammer_min=50), report=f"{tmp_path}/report")
        kept = sorted(decided.select("entity_type", "entity_value", "w", F.round("score", 2)).collect())
        assert set(folders(spark, scratch_dir(spark))) > before
    assert set(folders(spark, scratch_dir(spark))) == before
    assert kept and sorted(spark.read.json(f"{tmp_path}/report").select("entity_type", "entity_value", "w", "score").collect()) == kept


def test_verbs_as_rows_and_clients_without_any(spark):
    """Made-up verbs are rows, not one map; a client without agent, referrer and verb keeps its row."""
    given = [(0, "1.1.1.1", f"V{k}", "ua") for k in range(300)] + [(0, "1.1.1.1", "GET", "ua")] * 2 + [(0, "9.9.9.9", None, None)]
    log = spark.createDataFrame([(T0, ip, ua, None, "/a", verb, 200, "2xx") for _, ip, verb, ua in given], "ts timestamp, ip string, ua string, ref string, path string, verb string, status int, status_class string")
    log = log.unionByName(replay.marker(log, int(T0.timestamp() * 1e6) + 400_000_000, spark))
    grain = detect.grain_of(log)
    counts = {r["verb"]: r["n"] for r in entities.method_counts(entities.by_entity(grain)).filter("entity_value = '1.1.1.1'").collect()}
    assert len(counts) == 301 and counts["GET"] == 2
    plain = {r["entity_value"]: (r["total_requests"], r["unique_uas"], r["unique_refs"]) for r in entities.entity_metrics(grain, types=("ip",), methods=False).collect()}
    assert plain == {"1.1.1.1": (302, 1, 0), "9.9.9.9": (1, 0, 0)}

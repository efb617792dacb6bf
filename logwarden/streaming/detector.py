"""The detector on a stream: closed windows are scored on tables that hold what earlier windows left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULT, DetectConfig
from logwarden.jobs import detect
from logwarden.operators import entities, prefixes, rates
from logwarden.sources import logs
from logwarden.sources.scratch import materialise, temporary_tables
from logwarden.streaming.clients import with_new_clients
from logwarden.streaming.rates import DELAY
from logwarden.streaming.versions import drop_versions, last_version, write_version

#: The state tables, of which a batch with closed windows writes a new version; the last one tells that all are whole.
STATE = {
    "recent": "entity_type string, entity_value string, w long, total_requests long, known_ewma double",
    "totals": "prefix string, w long, n long, errors long, ts timestamp, new_ips long",
    "runs": "entity_type string, entity_value string, run long",
}
#: Settings of keyed state: kept by RocksDB, whose changes are what a batch writes, in a dense codec. Of
#: versions the last two stay, for a batch that is repeated.
STORE = {
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_state_store(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in RocksDB, as keyed state needs.

    Set once and left so: streams that are started at the same time do not undo each other's setting.
    """
    for name, value in STORE.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)


def grain_counts(requests: DataFrame, anchor_sec: int = 0, delay: str = DELAY, window_sec: int = 300) -> DataFrame:
    """The detector's grain as a streaming aggregate; windows start ``anchor_sec`` past full multiples."""
    win = F.window("ts", f"{window_sec} seconds", f"{window_sec} seconds", f"{anchor_sec} seconds")
    rows = requests.withWatermark("ts", delay).groupBy(win.alias("win"), "ip", "ua", "ref", "path", "verb", "status_class")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def _carry_on(before: detect.Before, grain: DataFrame, scored: DataFrame, cfg: DetectConfig) -> dict[str, DataFrame]:
    """The state tables after the windows of ``grain``.

    ``recent`` keeps, of entities that a pruning would still find, as many windows as deviations reach
    back to and the average after the last of them; ``runs`` those entities whose last window was decided.
    """
    key, n = list(rates.KEY), cfg.idle_windows
    own = Window.partitionBy(*key).orderBy(F.col("w").desc())
    latest = scored.agg(F.max("w").alias("latest"))
    counts = scored.filter(F.col("entity_type").isin("ip", "ua")).select(*key, "w", "total_requests", F.col("ewma").alias("known_ewma")).unionByName(before.recent)
    counts = counts.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= max(1, cfg.rate_history))
    counts = counts.withColumn("__last", F.max("w").over(Window.partitionBy(*key))).join(F.broadcast(latest)).filter(F.coalesce(F.col("__last") + 2 * n + 1 > F.col("latest"), F.lit(True)))
    per = prefixes.prefix_windows(prefixes.prefix_clients(grain, cfg), before.new_clients).unionByName(before.totals)
    totals = per.groupBy("prefix").agg(F.max("w").alias("w"), F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.min("ts").alias("ts"), F.sum("new_ips").alias("new_ips"))
    last = scored.withColumn("__n", F.row_number().over(own)).filter("__n = 1").select(*key, F.when(F.col("decided"), F.col("streak") + 1).otherwise(0).cast("long").alias("run"))
    runs = last.unionByName(before.runs.join(last, key, "left_anti")).filter("run > 0")
    return {"recent": counts.select(*key, "w", "total_requests", "known_ewma"), "totals": totals, "runs": runs}


def start_detector(requests: DataFrame, table: DataFrame, t0: float, path: str, cfg: DetectConfig = DEFAULT, delay: str = DELAY, report: str | None = None):
    """Start the streaming detector; returns the query. Needs use_state_store() first.

    Windows that closed arrive as counts, through keyed state that knows every prefix's clients and
    is asked about the batch's own only. They are scored on the state tables of the last batch that
    had any: recent windows of every entity not yet idle, the sums of every prefix, and runs of
    decisions. No request, count or client is read twice, and a batch without a closed window reads
    and writes no table. Decisions and state are stored under the batch's number, so a repeated
    batch replaces its own output; of versions, the one before stays as well, for a batch that is
    repeated. Folders: path/decisions, path/recent, path/totals, path/runs, path/state. With
    ``report`` decisions are also written there as logs.write_decisions() does, by batch.
    """
    sec = cfg.window_sec

    def closed(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with temporary_tables():
            rows = materialise(batch, "closed")
            grain = rows.filter("n is not null").drop("prefix", "new_ips")
            if grain.isEmpty():
                return
            grain = entities.add_network(grain, cfg)
            last, state = last_version(spark, path, STATE, number)
            new = rows.filter("new_ips is not null").groupBy("prefix", "w").agg(F.sum("new_ips").alias("new_ips"))
            before = detect.Before(**state, new_clients=new)
            scored = materialise(detect.score(detect.base_signals(grain, table, cfg, before=before), cfg, before.runs), "scored")
            detect.decisions(scored).write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")
            if report:
                made = spark.read.parquet(f"{path}/decisions/batch={number}")
                logs.write_decisions(made, f"{report}/batch={number}", mode="overwrite")
            write_version(path, number, _carry_on(before, grain, scored, cfg))
            drop_versions(spark, path, STATE, (last, number))

    counts = grain_counts(requests, int(t0) % sec, delay, sec)
    start, end = F.col("win.start"), F.col("win.end")
    rows = counts.withColumns({"window_start": start, "window_end": end, "w": F.round((F.unix_micros(start) / 1e6 - t0) / sec).cast("long")}).drop("win")
    return with_new_clients(rows, cfg).writeStream.foreachBatch(closed).outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()

"""The batch detector: baseline, then signals, streaks and decisions for every entity and window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULT, DetectConfig
from logwarden.functions import scoring
from logwarden.operators import baseline, entities, persistence, prefixes, rates, windows
from logwarden.sources.scratch import broadcast_if_small, materialise

KEY = entities.KEY
#: Pairs of counts, and baselines of such rows, up to which a table is broadcast.
FEW = 1_000_000


def grain_of(requests: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """Requests as counts by window, client and path: what all later steps read."""
    return entities.add_network(entities.request_grain(windows.assign_windows(requests, cfg=cfg)), cfg)


def train(requests: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """The baseline table, a few rows."""
    return baseline.baseline_table(baseline.metric_values(baseline.training_entities(windows.training_window(requests, cfg), cfg), cfg))


@dataclass(frozen=True)
class Before:
    """What earlier windows leave behind, and how many clients of prefixes are new to them: see streaming.detector.STATE."""

    recent: DataFrame
    totals: DataFrame
    runs: DataFrame
    new_clients: DataFrame


def base_signals(grain: DataFrame, table: DataFrame, cfg: DetectConfig = DEFAULT, types: tuple[str, ...] = entities.TYPES, before: Before | None = None) -> DataFrame:
    """Per entity and window: metrics and every signal and dampener that needs no earlier decision.

    grain: that of all windows, or of some later ones and what ``before`` holds of those before them.
    """
    # signals name no path
    stems = materialise(entities.path_stems(entities.path_grain(entities.by_entity(grain, types), cfg), cfg).drop("top"), "stems")
    counts = stems.groupBy(*KEY).agg(F.sum("n").alias("total_requests"))
    burst = rates.rate_state(counts if before is None else counts.unionByName(before.recent, allowMissingColumns=True), cfg).select(*KEY, "s_burst", "ewma")
    per = prefixes.prefix_windows(prefixes.prefix_clients(grain, cfg), before.new_clients if before else None)
    state = prefixes.running_state(per if before is None else per.unionByName(before.totals))
    new = prefixes.new_requests(stems.withColumnRenamed("stem", "path"), state, cfg)
    # all meet by entity and window before anything is stored: wide rows are dealt out once
    metrics = entities.entity_metrics(grain, cfg, types, stems=stems, methods=False).join(burst, KEY, "left").join(new, KEY, "left")
    metrics = materialise(metrics.withColumn("d_new", prefixes.new_share()).drop("new_requests"), "metrics")
    base = baseline.baseline_row(table, cfg)
    rows = metrics.join(F.broadcast(entities.window_totals(grain)), "w").join(F.broadcast(base))
    # most entities share a few pairs of counts, such as no error in one request
    rows = rows.join(broadcast_if_small(baseline.posterior_table(metrics, base, cfg), "posterior", FEW), ["error_count", "total_requests"])
    n, top, share = F.col("total_requests"), F.col("top_path_ratio"), F.col("total_requests") / F.col("window_requests")
    z = lambda m: baseline.robust_z(F.col(m), F.col(f"median_{m}"), F.col(f"mad_{m}"))
    fans = [F.when(F.col(f"fanout_{d}") > 0, z(f"fanout_{d}")).otherwise(0.0) for d in cfg.depths]
    max_z = F.greatest(F.lit(0.0), z("explore_ratio"), *fans, F.when(z("depth_score") < -3, -z("depth_score")).otherwise(0.0))
    mean = baseline.posterior_mean(F.col("error_count"), n, F.col("alpha"), F.col("beta"))
    err = scoring.error_signal(mean, F.col("exceeds"), F.col("theta"), cfg)
    rows = rows.withColumn("share", share).withColumn("max_z", max_z).withColumns(
        {
            "s_err": scoring.redirect_boost(err, F.col("redirect_rate"), top),
            "s_explore": scoring.exploration_signal(F.col("max_z")),
            "s_hammer": scoring.hammer_signal(n, top, F.col("path_concentration"), F.col("share"), cfg),
            "s_burst": F.coalesce("s_burst", F.lit(0.0)),
            "s_spread": scoring.spread_signal(F.col("entity_type"), F.col("unique_ips"), F.col("unique_uas")),
            "s_cross": F.lit(0.0),
            "s_dominance": scoring.dominance_signal(F.col("share"), cfg),
            "d_volume": scoring.volume_dampener(n, cfg),
            "d_legit": F.lit(0.0),
        }
    )
    dropped = ["theta", "alpha", "beta", *[c for c in base.columns if c.startswith(("median_", "mad_"))]]
    return rows.drop(*dropped)


def verdicts(cfg: DetectConfig = DEFAULT) -> list[Column]:
    """Whether signals decide at a streak of 0 to persistence.FULL."""
    at = [F.lit(20.0 * k) for k in range(persistence.FULL + 1)]
    return [scoring.consensus(cfg, p) & (scoring.final_score(cfg, p) >= scoring.threshold(F.col("entity_type"), cfg)) for p in at]


def suspects(signals: DataFrame, cfg: DetectConfig = DEFAULT) -> DataFrame:
    """The signals of entities for which some window decides at some streak; for others nothing is ever decided."""
    own = list(persistence.KEY)
    # stored before it is filtered: as a condition, a verdict would be spelled out as often as it is named
    any_ = materialise(signals.select(*own, F.array_contains(F.array(*verdicts(cfg)), True).alias("any")), "verdicts")
    some = any_.filter("any").select(*own).distinct()
    return signals.join(broadcast_if_small(some, "suspects", FEW), own, "left_semi")


def score(signals: DataFrame, cfg: DetectConfig = DEFAULT, runs: DataFrame | None = None) -> DataFrame:
    """Add streak, s_persist, score, consensus and decided; decisions feed back through streaks."""
    rows = signals.withColumn("verdicts", F.array(*verdicts(cfg)))
    # stored once: the streaks and the scores both read it
    rows = persistence.feedback(materialise(rows, "verdicts"), before=runs).drop("verdicts")
    rows = rows.withColumn("s_persist", scoring.persistence_signal(F.col("streak")))
    return rows.withColumn("score", scoring.final_score(cfg)).withColumn("consensus", scoring.consensus(cfg))


def decisions(scored: DataFrame) -> DataFrame:
    """Block decisions with nested signals and dampeners, a duration and an explanation."""
    rows = scored.filter("decided")
    part = lambda score, *names: F.struct(*[F.col(n) for n in names], F.col(score).alias("score"))
    nested = F.struct(
        part("s_err", "error_rate", "error_count", "total_requests").alias("error_posterior"),
        part("s_explore", "explore_ratio", "unique_paths").alias("exploration"),
        part("s_hammer", "top_path_ratio", "path_concentration", "redirect_rate").alias("hammering"),
        part("s_dominance").alias("dominance"), part("s_burst").alias("burst"), part("s_persist").alias("persistence"),
        part("s_spread", "unique_ips", "unique_uas").alias("spread"),
    )
    return rows.select(
        "w", F.col("window_end").alias("when"), "entity_type", "entity_value", "score", F.lit("block").alias("recommended_action"),
        scoring.duration(F.col("score"), F.col("entity_type")).alias("duration_sec"), nested.alias("signals"),
        F.struct(F.col("d_volume").alias("volume"), F.col("d_new").alias("new_content"), F.col("d_legit").alias("legit_ua")).alias("dampeners"),
        scoring.explanation().alias("explanation"), "streak", "first_seen",
    )


def detect(requests: DataFrame, cfg: DetectConfig = DEFAULT, types: tuple[str, ...] = entities.TYPES) -> DataFrame:
    """Train on the first hour, score all windows, return the decisions."""
    grain = materialise(grain_of(requests, cfg), "grain")
    table = materialise(train(requests, cfg), "baseline")
    return decisions(score(suspects(base_signals(grain, table, cfg, types), cfg), cfg))

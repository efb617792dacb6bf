"""Settings of the detector. The defaults are those of the published method."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    err: float = 0.28
    explore: float = 0.18
    hammer: float = 0.18
    burst: float = 0.12
    persist: float = 0.10
    spread: float = 0.05
    cross: float = 0.03
    dominance: float = 0.06


@dataclass(frozen=True)
class DetectConfig:
    window_sec: int = 300
    training_sec: int = 3600
    depths: tuple[int, ...] = (2, 4, 6, 8, 16, 32, 64)
    ipv4_prefix: int = 24
    ipv6_prefix: int = 48
    #: Least requests: of a decision without damping, of the hammering signal, of a training entity.
    n_min: int = 50
    n_hammer_min: int = 500
    n_train_min: int = 30
    delta_error: float = 0.10
    fallback_error_rate: float = 0.08
    anomaly_z: float = 4.0
    rate_tail_p: float = 1e-6
    ewma_alpha: float = 0.3
    rate_history: int = 100
    cusum_k: float = 2.0
    cusum_h: float = 5.0
    burst_gamma: float = 0.5
    idle_windows: int = 12
    grace_minutes: int = 90
    new_min_ips: int = 100
    new_max_error: float = 0.20
    new_depth: int = 6
    dominance: float = 0.30
    dominance_full: float = 0.60
    hammer_full: float = 0.70
    thresholds: dict[str, float] = field(default_factory=lambda: {"path": 60.0, "ip": 75.0, "ua": 75.0, "cidr": 50.0})
    default_threshold: float = 75.0
    min_signals: int = 2
    weights: Weights = Weights()
    #: "reference": networks have no prefixes and depth 0; "merged": those of their addresses.
    cidr_depth: str = "reference"
    #: "current": the rate is judged by an average that includes it; "previous": by the one before.
    burst_uses: str = "current"


DEFAULT = DetectConfig()

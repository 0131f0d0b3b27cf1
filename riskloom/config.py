"""Immutable rule and model parameters.

Every threshold the rules and models use lives here so that a caller can
score with other settings without touching operator code.
"""

from __future__ import annotations

from dataclasses import dataclass, field


# Fixed values that must equal the published rule set.
# Rapid repeat: 1 to 7 calendar days; spike: ratio 3 with at least 2 prior
# orders; points: same-day 2, rapid 1, spike 3, state 2, city 1;
# High from score 4, Medium from 1 to 3; multi-signal from 2 flags.
RAPID_MIN_DAYS = 1
RAPID_MAX_DAYS = 7
SPIKE_RATIO = 3
SPIKE_MIN_PRIOR = 2
POINTS_SAME_DAY = 2
POINTS_RAPID = 1
POINTS_SPIKE = 3
POINTS_STATE = 2
POINTS_CITY = 1
HIGH_FROM = 4
MEDIUM_FROM = 1
MULTI_SIGNAL_FROM = 2

# Fixed labels used in reports (natural order).
LEVEL_HIGH = "High"
LEVEL_MEDIUM = "Medium"
LEVEL_LOW = "Low"
REASON_SAME_DAY = "Same-day repeat"
REASON_RAPID = "Rapid repeat (1-7 days)"
REASON_SPIKE = "Amount spike"
REASON_STATE = "State/province mismatch"
REASON_CITY = "City mismatch"
REASON_NONE = "No risk indicators"


@dataclass(frozen=True)
class RiskConfig:
    rapid_min_days: int = RAPID_MIN_DAYS
    rapid_max_days: int = RAPID_MAX_DAYS
    spike_ratio: float = SPIKE_RATIO
    spike_min_prior: int = SPIKE_MIN_PRIOR
    points_same_day: int = POINTS_SAME_DAY
    points_rapid: int = POINTS_RAPID
    points_spike: int = POINTS_SPIKE
    points_state: int = POINTS_STATE
    points_city: int = POINTS_CITY
    high_from: int = HIGH_FROM
    medium_from: int = MEDIUM_FROM
    multi_signal_from: int = MULTI_SIGNAL_FROM
    # Partitions of the range exchange behind the customer history scan;
    # None means spark.sql.shuffle.partitions.
    history_partitions: int | None = None


@dataclass(frozen=True)
class ForestConfig:
    # Fixed values of the published model run: 300 trees, automatic
    # contamination (offset -0.5), seed 42, sub-sample min(256, n).
    n_trees: int = 300
    max_samples: int = 256
    seed: int = 42
    offset: float = -0.5
    # Expected candidate rows per tree before the exact psi smallest hashes
    # are kept (oversampling factor against short trees).
    oversample: float = 2.0
    top_shares: tuple = field(default=(0.99, 0.95, 0.90))

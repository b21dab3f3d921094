"""Rule expressions over the measures of one client window."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens import fixed_values as fixed


@dataclass(frozen=True)
class Thresholds:
    """Limits of the window rules; every comparison is strict except the score bands."""

    spike_requests: int = fixed.SPIKE_REQUESTS
    error_rate: float = fixed.HIGH_ERROR_RATE
    endpoints: int = fixed.SCAN_ENDPOINTS
    high_score: float = fixed.HIGH_SCORE
    medium_score: float = fixed.MEDIUM_SCORE
    score_requests: int = fixed.SPIKE_REQUESTS
    weights: dict[str, float] = field(default_factory=lambda: dict(fixed.SCORE_WEIGHTS))


def anomaly_type(limits: Thresholds) -> Column:
    """First rule that holds names the window."""
    rules = [
        ("server_error", F.col("fatal_count") > 0),
        ("traffic_spike", F.col("request_count") > limits.spike_requests),
        ("high_error_rate", F.col("error_rate") > limits.error_rate),
        ("scanning", F.col("unique_endpoints") > limits.endpoints),
        ("bot_traffic", F.col("bot_requests") > 0),
    ]
    (name, holds), *others = rules
    chain = reduce(lambda chosen, rule: chosen.when(rule[1], rule[0]), others, F.when(holds, name))
    return chain.otherwise("normal")


def raw_score(limits: Thresholds) -> Column:
    """Weighted sum of the severity signals, before the cap at 1."""
    smoothed = F.col("request_count") + 1
    signals = {
        "fatal": F.col("fatal_count") / smoothed,
        "medium": F.col("medium_count") / smoothed,
        "error_rate": F.col("error_rate"),
        "volume": F.col("request_count") / limits.score_requests,
    }
    return reduce(add, (signal * limits.weights[name] for name, signal in signals.items()))


def capped(value: Column, limit: float = 1.0) -> Column:
    """``value`` cut at ``limit``; null stays null."""
    return F.when(value > limit, limit).otherwise(value)


def severity(score: Column, limits: Thresholds) -> Column:
    return (
        F.when(score >= limits.high_score, "high")
        .when(score >= limits.medium_score, "medium")
        .otherwise("low")
    )

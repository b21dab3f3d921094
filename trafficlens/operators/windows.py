"""Per-client time windows and the rules on them."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions import rules
from trafficlens.functions.rules import Thresholds

_LENGTHS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def window_counts(
    enriched: DataFrame,
    duration: str = "1 minute",
    slide: str | None = None,
    key: str = "ip",
    approximate: float | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Request measures per client and time window; rows without a timestamp have no window.

    Tumbling windows by default, sliding ones with ``slide``. The exact distinct
    endpoint count first merges equal (client, window, endpoint) rows inside each
    task and spreads them by all three columns, so one client that sends most of
    the traffic is still shared out by its endpoints. ``approximate`` is the
    relative error of a mergeable sketch instead (see ``pane_sketches``), which saves that
    exchange. ``start`` and ``end``
    keep the requests from one instant up to another; the range reaches a stored table's
    scan.
    """
    timed = enriched
    if start is not None:
        timed = timed.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        timed = timed.filter(F.col("timestamp") < F.lit(end).cast("timestamp"))
    if approximate is not None and slide is None:
        return _with_rates(_measures(_tumbling_sketches(timed, duration, key, approximate), key), key)
    if approximate is not None:
        pane = math.gcd(_seconds(duration), _seconds(slide or duration))
        return from_sketches(pane_sketches(timed, f"{pane} seconds", key, approximate), duration, slide, key)
    if slide is not None:
        counts = _sliding_counts(timed, duration, slide, key)
    else:
        level = F.col("error_severity")
        counts = timed.groupBy(key, F.window("timestamp", duration, slide)).agg(
            F.count("*").alias("request_count"),
            F.sum("is_error").alias("error_count"),
            F.avg("bytes").alias("avg_bytes"),
            F.count_distinct("endpoint").alias("unique_endpoints"),
            F.sum("is_bot").alias("bot_requests"),
            F.sum("is_off_hours").alias("off_hours_requests"),
            F.count_if(level == "fatal").alias("fatal_count"),
            F.count_if(level == "medium").alias("medium_count"),
            F.count_if(level == "low").alias("low_count"),
        )
    return _with_rates(counts, key)


def _with_rates(counts: DataFrame, key: str) -> DataFrame:
    measures = [c for c in counts.columns if c not in (key, "window")]
    return counts.select(
        key,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *measures,
        (F.col("error_count") / F.col("request_count")).alias("error_rate"),
    )


def _seconds(duration: str) -> int:
    """Length of an interval such as "1 day 6 hours"."""
    parts = re.findall(r"(\d+)\s*(second|minute|hour|day|week)s?", duration)
    if not parts or re.sub(r"(\d+)\s*(second|minute|hour|day|week)s?|\s", "", duration):
        raise ValueError(f"not a length in seconds to weeks: {duration!r}")
    return sum(int(n) * _LENGTHS[unit] for n, unit in parts)


def _sums() -> dict[str, Column]:
    """What is summed over requests, and again over sums."""
    level = F.col("error_severity")
    return {
        "request_count": F.count("*"),
        "error_count": F.sum("is_error"),
        "bot_requests": F.sum("is_bot"),
        "off_hours_requests": F.sum("is_off_hours"),
        "fatal_count": F.count_if(level == "fatal"),
        "medium_count": F.count_if(level == "medium"),
        "low_count": F.count_if(level == "low"),
        "bytes_sum": F.sum("bytes"),
        "bytes_known": F.count("bytes"),
    }


def _sketch_size(error: float) -> int:
    """The log of the buckets of a sketch whose unions keep to the error (one deviation)."""
    return max(4, min(21, math.ceil(math.log2((1.04 / error) ** 2))))


def pane_sketches(
    enriched: DataFrame, pane: str = "1 minute", key: str = "ip", error: float = 0.02
) -> DataFrame:
    """(key, begin, sums, endpoints): per client and pane what windows of any length merge.

    ``endpoints`` is a distinct-count sketch of bounded size; store this table once and
    hours, days and sliding windows come from it without the requests. A sketch holds few
    endpoints exactly.
    """
    sketch = F.hll_sketch_agg("endpoint", _sketch_size(error)).alias("endpoints")
    sums = [total.alias(name) for name, total in _sums().items()]
    panes = enriched.groupBy(key, F.window("timestamp", pane).alias("pane")).agg(*sums, sketch)
    return panes.select(key, F.col("pane.start").alias("begin"), *_sums(), "endpoints")


def from_sketches(panes: DataFrame, duration: str, slide: str | None = None, key: str = "ip") -> DataFrame:
    """Window measures from stored panes; window length and slide have to be multiples of a pane."""
    totals = [F.sum(name).alias(name) for name in _sums()]
    counts = panes.groupBy(key, F.window("begin", duration, slide)).agg(
        *totals, F.hll_sketch_estimate(F.hll_union_agg("endpoints")).alias("unique_endpoints")
    )
    return _with_rates(_measures(counts, key), key)


def _tumbling_sketches(timed: DataFrame, duration: str, key: str, error: float) -> DataFrame:
    """As from panes as long as the windows, but summed once; a union, because it is estimated otherwise."""
    sketch = F.hll_sketch_agg("endpoint", _sketch_size(error))
    sums = [total.alias(name) for name, total in _sums().items()]
    return timed.groupBy(key, F.window("timestamp", f"{_seconds(duration)} seconds")).agg(
        *sums, F.hll_sketch_estimate(F.hll_union(sketch, sketch)).alias("unique_endpoints")
    )


def _sliding_counts(timed: DataFrame, duration: str, slide: str, key: str) -> DataFrame:
    """Requests are summed once per pane, the longest step that window length and slide
    are multiples of; only panes are copied into the windows that hold them."""
    pane = math.gcd(_seconds(duration), _seconds(slide))
    sums = _sums()
    panes = timed.groupBy(key, "endpoint", F.window("timestamp", f"{pane} seconds").alias("pane")).agg(
        *(total.alias(name) for name, total in sums.items())
    )
    totals = [F.sum(name).alias(name) for name in sums]
    begin = panes.select(key, "endpoint", F.col("pane.start").alias("begin"), *sums)
    of_endpoint = begin.groupBy(key, "endpoint", F.window("begin", duration, slide)).agg(*totals)
    counts = of_endpoint.groupBy(key, "window").agg(
        *totals, F.count("endpoint").alias("unique_endpoints")
    )
    return _measures(counts, key)


def _measures(counts: DataFrame, key: str) -> DataFrame:
    return counts.select(
        key,
        "window",
        "request_count",
        "error_count",
        F.try_divide(F.col("bytes_sum").cast("double"), "bytes_known").alias("avg_bytes"),
        "unique_endpoints",
        "bot_requests",
        "off_hours_requests",
        "fatal_count",
        "medium_count",
        "low_count",
    )


def apply_rules(counts: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Add anomaly type, severity score and severity to window measures."""
    scored = counts.select(
        "*",
        rules.anomaly_type(limits).alias("anomaly_type"),
        rules.raw_score(limits).alias("severity_score"),
    ).withColumn("severity_score", rules.capped(F.col("severity_score")))
    return scored.withColumn("severity", rules.severity(F.col("severity_score"), limits))


def client_windows(
    enriched: DataFrame,
    limits: Thresholds = Thresholds(),
    duration: str = "1 minute",
    slide: str | None = None,
    key: str = "ip",
    approximate: float | None = None,
) -> DataFrame:
    """Window measures with the rules applied."""
    return apply_rules(window_counts(enriched, duration, slide, key, approximate), limits)

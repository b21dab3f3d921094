"""Window measures, rules and their limits."""

import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trafficlens.functions.rules import Thresholds
from trafficlens.operators import windows as ops
from trafficlens.operators.clean import clean
from trafficlens.operators.enrich import enrich, request_profile
from trafficlens.operators.histogram import histogram, histograms
from trafficlens.operators.parse import parse_combined
from trafficlens.operators.windows import apply_rules, client_windows, window_counts
from trafficlens.plans import reports
from trafficlens.sources.text import lines_per_file


def requests(spark, rows):
    """Rows of (ip, seconds, endpoint, status, agent)."""
    start = datetime.datetime(2024, 1, 1, 12)
    texts = [
        f'{ip} - - [{(start + datetime.timedelta(seconds=s)):%d/%b/%Y:%H:%M:%S} +0000] '
        f'"GET {endpoint} HTTP/1.1" {status} 100 "-" "{agent}" "-"'
        for ip, s, endpoint, status, agent in rows
    ]
    return enrich(clean(parse_combined(spark.createDataFrame([(t,) for t in texts], "value string"))))


def measures(**changed):
    base = dict(
        request_count=1, error_count=0, unique_endpoints=1, bot_requests=0, fatal_count=0,
        medium_count=0, error_rate=0.0,
    )
    return {**base, **changed}


@pytest.mark.parametrize(
    "changed,label",
    [
        ({}, "normal"),
        ({"bot_requests": 1}, "bot_traffic"),
        ({"unique_endpoints": 30, "bot_requests": 1}, "bot_traffic"),
        ({"unique_endpoints": 31, "bot_requests": 1}, "scanning"),
        ({"error_rate": 0.3}, "normal"),
        ({"error_rate": 0.31, "unique_endpoints": 31}, "high_error_rate"),
        ({"request_count": 200}, "normal"),
        ({"request_count": 201, "error_rate": 0.9}, "traffic_spike"),
        ({"fatal_count": 1, "request_count": 500}, "server_error"),
    ],
)
def test_first_rule_wins(spark, changed, label):
    assert apply_rules(spark.createDataFrame([measures(**changed)])).first().anomaly_type == label


def test_scores_and_bands(spark):
    def row(n):
        return measures(request_count=n, fatal_count=n, error_count=n, error_rate=1.0)

    rows = {
        r.request_count: r
        for r in apply_rules(spark.createDataFrame([row(n) for n in (1, 137, 138, 400, 2000)])).collect()
    }
    assert rows[1].severity_score == pytest.approx(0.40075) and rows[1].severity == "medium"
    assert rows[137].severity == "medium" and rows[138].severity == "high"
    assert rows[400].severity_score < 1.0 and rows[2000].severity_score == 1.0


def test_null_score_stays_null(spark):
    df = spark.createDataFrame([measures(error_rate=None)], "request_count int, error_count int, "
        "unique_endpoints int, bot_requests int, fatal_count int, medium_count int, error_rate double")
    row = apply_rules(df).first()
    assert row.severity_score is None and row.severity == "low"


def test_limits_are_parameters(spark):
    df = spark.createDataFrame([measures(request_count=4)])
    assert apply_rules(df, Thresholds(spike_requests=3)).first().anomaly_type == "traffic_spike"


def test_window_edges(spark):
    df = requests(spark, [("a", 59, "/", 200, "x"), ("a", 60, "/", 200, "x"), ("a", 119, "/1", 500, "bot")])
    rows = window_counts(df).orderBy("window_start").collect()
    assert [r.request_count for r in rows] == [1, 2]
    second = rows[1]
    assert (second.unique_endpoints, second.fatal_count, second.bot_requests) == (2, 1, 1)
    assert second.error_rate == 0.5 and second.avg_bytes == 100.0
    assert second.window_end - second.window_start == datetime.timedelta(minutes=1)


def test_hot_client_counts_exactly(spark):
    """One client with a third of the rows in one window, most on one endpoint."""
    rows = [("hot", i % 60, "/" if i % 3 else f"/{i}", 200, "x") for i in range(3000)]
    rows += [(f"c{i % 50}", i % 600, "/", 404, "x") for i in range(6000)]
    found = client_windows(requests(spark, rows))
    hot = found.filter("ip = 'hot'").first()
    assert hot.request_count == 3000 and hot.unique_endpoints == 1001
    assert hot.anomaly_type == "traffic_spike"
    assert found.agg(F.sum("request_count")).first()[0] == 9000


def test_window_plan_spreads_a_hot_client(spark):
    plan = window_counts(requests(spark, [("a", 1, "/", 200, "x")]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and any("endpoint" in line for line in exchanges)
    assert "Generate explode" in text and text.count("try_to_timestamp") == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(
        st.tuples(st.sampled_from("ab"), st.integers(0, 300), st.sampled_from(["/", "/x", "/y"]),
                  st.sampled_from([200, 301, 404, 403, 500, 418]), st.sampled_from(["bot", "m"])),
        min_size=1, max_size=40,
    )
)
def test_windows_against_plain_python(spark, rows):
    groups = {}
    for ip, s, endpoint, status, agent in rows:
        groups.setdefault((ip, s // 60), []).append((endpoint, status, agent))
    found = {
        (r.ip, r.window_start.minute): (
            r.request_count, r.error_count, r.unique_endpoints, r.bot_requests,
            r.fatal_count, r.medium_count, r.low_count,
        )
        for r in window_counts(requests(spark, rows)).collect()
    }
    assert found == {
        key: (
            len(g), sum(s >= 400 for _, s, _ in g), len({e for e, _, _ in g}),
            sum(a == "bot" for *_, a in g), sum(s == 500 for _, s, _ in g),
            sum(s == 403 for _, s, _ in g), sum(s == 404 for _, s, _ in g),
        )
        for key, g in groups.items()
    }


@pytest.mark.parametrize("seed,bins", [(1, 40), (2, 7), (3, 50)])
def test_histogram_as_numpy(spark, seed, bins):
    values = np.random.default_rng(seed).choice([0.1, 0.2, 0.3, 0.7, 1.0, 2.5, 3.3], 500)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    counts, edges = np.histogram(values, bins)
    rows = histogram(df, "v", bins).orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[-1].bin_end == edges[-1]


@pytest.mark.parametrize("values", [[2.0, 2.0], []])
def test_histogram_of_one_value_or_none(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts, edges = np.histogram(values, 4)
    rows = histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] == edges[:-1].tolist()


def test_profile_gives_the_same_reports(spark):
    rows = [(f"c{i % 7}", i * 977 % 90000, "/", (200, 404, 500, 301)[i % 4], ("m", "bot")[i % 5 == 0])
            for i in range(300)]
    df = requests(spark, rows).cache()
    profile = request_profile(df).cache()
    for report in (
        reports.status_codes, reports.status_classes, reports.bot_share, reports.sources,
        reports.methods, reports.requests_by_hour, reports.requests_by_weekday,
        reports.error_rate_by_hour, reports.off_hours_share, reports.error_severities,
        reports.errors_by_source, reports.peak_error_hours, reports.quality,
    ):
        assert sorted(map(str, report(df).collect())) == sorted(map(str, report(profile).collect()))
    totals = reports.client_totals(df)
    assert reports.rank_clients(totals).collect() == reports.top_clients(df).collect()
    assert reports.rank_clients(totals, "errors").collect() == reports.top_error_clients(df).collect()


def test_top_k_ties_are_settled_by_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "ip string")
    assert [r.ip for r in reports.top_clients(df, 2).collect()] == ["c", "a"]


def test_error_pivot_with_one_class_only(spark):
    row = reports.errors_by_source(requests(spark, [("a", 1, "/", 200, "x")])).first()
    assert (row.normal, row.error) == (1, 0)


def test_empty_files_are_listed(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    (tmp_path / "b c.log").write_text("")
    (tmp_path / "d e.log").write_text("three")
    rows = {r.file.rsplit("/", 1)[1]: r.lines for r in lines_per_file(spark, f"{tmp_path}/*.log").collect()}
    assert rows == {"a.log": 2, "b%20c.log": 0, "d%20e.log": 1}


def test_sketches_merge_within_their_error(spark):
    """Hours from minutes, overlapping, with many endpoints: sums exact, distinct counts near."""
    n = 60_000
    seconds = F.col("id") % 7200
    rows = spark.range(n).select(
        F.lit("10.0.0.1").alias("ip"),
        F.timestamp_seconds(1704067200 + seconds).alias("timestamp"),
        F.concat(F.lit("/"), (F.col("id") * 7919 % 20011).cast("string")).alias("endpoint"),
        F.col("id").alias("bytes"),
        F.lit(0).alias("is_error"), F.lit(0).alias("is_bot"), F.lit(0).alias("is_off_hours"),
        F.lit("none").alias("error_severity"),
    )
    panes = ops.pane_sketches(rows, "1 minute", error=0.02)
    merged = {r.window_start: r for r in ops.from_sketches(panes, "1 hour", "20 minutes").collect()}
    exact = {r.window_start: r for r in ops.window_counts(rows, "1 hour", "20 minutes").collect()}
    assert merged.keys() == exact.keys() and len(exact) == 8
    for at, own in exact.items():
        assert merged[at].request_count == own.request_count
        assert merged[at].avg_bytes == pytest.approx(own.avg_bytes)
        assert abs(merged[at].unique_endpoints - own.unique_endpoints) <= 4 * 0.02 * own.unique_endpoints
    direct = {r.window_start: r.unique_endpoints for r in ops.window_counts(rows, "1 hour", "20 minutes", approximate=0.02).collect()}
    assert direct == {at: r.unique_endpoints for at, r in merged.items()}


def test_tumbling_sketches_are_those_of_panes(spark):
    """One exchange, and the figures that stored panes of that length give."""
    rows = spark.range(9000).select(
        F.concat(F.lit("10.0.0."), (F.col("id") % 3).cast("string")).alias("ip"),
        F.when(F.col("id") % 50 > 0, F.timestamp_seconds(1704067200 + F.col("id"))).alias("timestamp"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("/"), (F.col("id") * 31 % 1009).cast("string"))).alias("endpoint"),
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("bytes"),
        F.lit(0).alias("is_error"), F.lit(1).alias("is_bot"), F.lit(0).alias("is_off_hours"),
        F.lit("low").alias("error_severity"),
    )
    direct = ops.window_counts(rows, "1 hour", approximate=0.05)
    assert direct._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    merged = ops.from_sketches(ops.pane_sketches(rows, "3600 seconds", error=0.05), "1 hour")
    assert direct.columns == merged.columns and direct.count() == 9
    assert sorted(direct.collect()) == sorted(merged.collect())


def test_all_histograms_come_from_one_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(float(a), int(b), None) for a, b in zip(rng.normal(size=500), rng.integers(0, 9, 500))]
    spark.createDataFrame(rows, "a double, b int, c double").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = histograms(stored, {"a": 7, "b": 4, "c": 2})
    got = {}
    for r in found.orderBy("column", "bin").collect():
        got.setdefault(r["column"], []).append(r["count"])
    for i, (name, bins) in enumerate((("a", 7), ("b", 4))):
        assert got[name] == np.histogram([r[i] for r in rows], bins)[0].tolist()
    assert got["c"] == [0, 0]
    together = found.groupBy().agg(F.sum("count"))
    assert together.collect()[0][0] == 1000
    final = together._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final

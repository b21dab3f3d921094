"""What the physical plans must not contain, whatever the size of the log."""

import pytest

import __spark_entry__ as entry
from contract import tables
from trafficlens.operators.histogram import histogram
from trafficlens.operators.windows import client_windows, window_counts
from trafficlens.plans import reports

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
# built without running jobs
LAZY = sorted(n for n in QUERIES if n[0] in "bcdefgh" or n in ("j11_run_stats", "k03_sliding_windows"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


@pytest.mark.parametrize("name", ["e01_minute_windows", "h01_status_codes", "e08_quality"])
def test_each_log_is_read_and_matched_once(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert text.count("FileScan") == 2 and text.count("regexp_replace") == 2


def test_windows_have_two_exchanges_or_one(spark):
    rows = tables.enriched(spark, SF_DIR)
    assert plan(window_counts(rows)).count("Exchange hashpartitioning") == 2
    assert plan(window_counts(rows, approximate=0.05)).count("Exchange hashpartitioning") == 1


def test_rules_add_no_exchange(spark):
    rows = tables.enriched(spark, SF_DIR)
    assert plan(client_windows(rows)).count("Exchange") == plan(window_counts(rows)).count("Exchange")


def test_top_k_sorts_inside_the_tasks(spark):
    text = plan(reports.top_clients(tables.access(spark, SF_DIR)))
    assert "TakeOrderedAndProject" in text


def test_stored_tables_are_pruned(spark, tmp_path):
    tables.enriched(spark, SF_DIR).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    scanned = plan(reports.top_error_clients(rows)).split("ReadSchema: ")[1].split(">")[0]
    assert scanned == "struct<ip:string,is_error:int"
    assert "EqualTo(is_error,1)" in plan(reports.top_error_clients(rows))
    scanned = plan(window_counts(rows)).split("ReadSchema: ")[1].split(">")[0]
    assert "user_agent" not in scanned and "method" not in scanned
    scanned = plan(histogram(rows, "bytes", 5)).split("ReadSchema: ")[1].split(">")[0]
    assert scanned == "struct<bytes:bigint"


def test_split_needs_no_exchange(spark):
    text = plan(QUERIES["i05_hash_split"](spark, SF_DIR))
    windows = plan(QUERIES["f03_severity"](spark, SF_DIR))
    assert text.count("Exchange") == windows.count("Exchange")


def test_time_range_reaches_the_scan(spark, tmp_path):
    """Windows over stored rows read only the row groups of their range."""
    path = str(tmp_path / "requests")
    tables.enriched(spark, SF_DIR).write.parquet(path)
    stored = spark.read.parquet(path)
    text = plan(window_counts(stored, start="2024-01-05 00:00:00", end="2024-01-06 00:00:00"))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed
    assert "IsNotNull(timestamp)" in plan(window_counts(stored)).split("PushedFilters")[1]

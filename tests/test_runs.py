"""Whole runs: batch to files, stream against batch, scratch folder."""

import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from contract import tables
from trafficlens.__main__ import main
from trafficlens.operators.clean import clean
from trafficlens.operators.enrich import enrich
from trafficlens.operators.parse import parse_common
from trafficlens.operators.windows import client_windows
from trafficlens.plans import access, batch, reports
from trafficlens.plans.access import access_rows
from trafficlens.plans.server import read_typed_server
from trafficlens.schema import ACCESS_SCHEMA, SERVER_SCHEMA, check_schema, null_violations
from trafficlens.sources.text import read_lines, stream_lines
from trafficlens.sources.workspace import scratch_path
from trafficlens.streaming import windows as streaming

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    for name, lines in zip(("common", "combined"), tables.by_source(spark, SF_DIR)):
        lines.repartition(3).write.text(f"{root}/{name}")
    return f"{root}/common", f"{root}/combined"


def test_batch_run(spark, folders, tmp_path):
    made, trained = batch.run(spark, *folders, str(tmp_path), train=False)
    assert trained is None
    rows = access_rows(*(read_lines(spark, f) for f in folders))
    assert made.requests.count() == rows.count()
    assert made.profile.agg(F.sum("requests")).first()[0] == rows.count()
    expected = client_windows(enrich(rows))
    assert made.windows.count() == expected.count()
    written = {p.name for p in (tmp_path / "reports").iterdir()}
    assert written == set(batch.report_tables(made))
    back = spark.read.option("header", True).csv(f"{tmp_path}/reports/top_clients")
    assert [tuple(r) for r in back.collect()] == [
        (r.ip, str(r["count"])) for r in reports.top_clients(rows).collect()
    ]


def test_batch_run_on_one_format_and_server_logs(spark, folders, tmp_path):
    server, out = str(tmp_path / "s"), str(tmp_path / "out")
    tables.server_lines(spark, SF_DIR).write.partitionBy("event_type").text(server)
    made, _ = batch.run(spark, None, folders[1], out, train=False, server_path=f"{server}/*")
    lines = read_lines(spark, folders[1])
    assert made.requests.count() + made.rejected.count() == lines.count()
    assert made.rejected.count() > 0
    # counted while writing, the same as counted afterwards; rejects lie in files of their own
    want = null_violations(made.requests.select(*ACCESS_SCHEMA.names))
    assert sorted(made.conformance.collect()) == sorted(want.collect())
    plan = made.requests._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "PartitionFilters: [isnotnull(accepted" in plan and "rejected_line" not in plan
    assert spark.read.parquet(f"{out}/server").count() == tables.events(spark, SF_DIR).count()
    files = spark.read.option("header", True).csv(f"{out}/reports/server_lines_per_file")
    assert files.agg(F.sum("lines")).first()[0] == tables.events(spark, SF_DIR).count()
    with pytest.raises(Exception, match="(?i)already exists"):
        batch.run(spark, None, folders[1], out, train=False)


@pytest.mark.parametrize("slide", [None, "12 hours"])
def test_stream_equals_batch_on_closed_windows(spark, folders, tmp_path, slide):
    settings = dict(limits=tables.DAY_LIMITS, duration="1 day", slide=slide)
    rows = enrich(access_rows(*(read_lines(spark, f) for f in folders)))
    live = enrich(access_rows(*(stream_lines(spark, f) for f in folders)))
    windows = streaming.stream_client_windows(live, **settings)
    out = str(tmp_path / "out")
    streaming.start(windows, out, str(tmp_path / "state"), once=True).awaitTermination()
    last = min(
        r.last for r in rows.groupBy("source").agg(F.max("timestamp").alias("last")).collect()
    )
    closed = client_windows(rows, **settings).filter(
        F.col("window_end") <= F.lit(last - datetime.timedelta(minutes=10))
    )
    emitted = spark.read.parquet(out)
    assert emitted.count() == closed.count() > 0
    rounded = lambda df: df.withColumn("severity_score", F.round("severity_score", 9))
    assert rounded(emitted).exceptAll(rounded(closed)).count() == 0


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    folder, out, state, notes, noted = (
        str(tmp_path / n) for n in ("in", "out", "state", "notes", "noted")
    )

    def deliver(day, n):
        line = f'1.1.1.1 - - [{day:02d}/Jan/2024:10:00:00 +0000] "GET /{n} HTTP/1.1" 200 1'
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(folder)

    def work_off():
        live = enrich(clean(parse_common(stream_lines(spark, folder))))
        counts = streaming.stream_window_counts(live)
        streaming.start(counts, out, state, once=True).awaitTermination()
        streaming.note_late_rows(live, notes, noted, once=True).awaitTermination()
        figures = streaming.late_row_notes(spark, notes).agg(F.sum("rows"), F.sum("late_rows"))
        return tuple(figures.first())

    deliver(1, 1)
    deliver(1, 2)
    work_off()
    deliver(5, 3)
    work_off()
    deliver(9, 4)
    assert work_off() == (4, 0)
    deliver(2, 5)  # behind the watermark
    assert work_off() == work_off() == (5, 1)  # nothing counts twice
    rows = {r.window_start.day: r for r in spark.read.parquet(out).collect()}
    assert rows[1].request_count == 2 and rows[1].unique_endpoints == 2
    assert 2 not in rows


def test_command_line(spark, folders, tmp_path, capsys):
    common, combined = folders
    main(["--common", common, "--combined", combined, "--out", str(tmp_path), "--window", "1 day",
          "--no-models"])
    assert "total_windows" in capsys.readouterr().out
    assert {"requests", "windows", "reports"} <= {p.name for p in tmp_path.iterdir()}


def test_server_logs(spark, tmp_path):
    tables.server_lines(spark, SF_DIR).write.partitionBy("event_type").text(str(tmp_path / "s"))
    typed = read_typed_server(spark, str(tmp_path / "s" / "*"))
    check_schema(typed, SERVER_SCHEMA)
    assert typed.count() == tables.events(spark, SF_DIR).count()
    assert typed.filter("timestamp IS NULL").count() == typed.filter("stack_trace IS NOT NULL").count()


def session_with(**settings):
    names = {key.replace("_", "."): value for key, value in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: names.get(key, default)))


def test_scratch_folder_comes_from_the_session(spark):
    named = session_with(spark_master="spark://x", spark_checkpoint_dir="hdfs://n/shared/")
    assert scratch_path(named, "x").startswith("hdfs://n/shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(session_with(spark_master="spark://x"), "x")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize("files", [1, 4])
def test_window_job_accounts_for_every_row(spark, tmp_path, files):
    """Read, emitted, open and dropped rows of the job itself, over restarts and idle runs."""
    lines, out, checkpoint, ledger = (str(tmp_path / n) for n in ("lines", "out", "checkpoint", "ledger"))
    line = '10.0.0.{} - - [{:02d}/Jan/2024:12:{:02d}:00 +0000] "GET /a/{} HTTP/1.1" 200 5'

    def deliver(name, day, n):
        rows = [(line.format(i % 3, day, i % 60, i % 7),) for i in range(n)] + [("not a line",)]
        spark.createDataFrame(rows, "value string").repartition(4).write.text(f"{lines}/batch={name}")

    def run():
        arriving = enrich(clean(parse_common(stream_lines(spark, lines, max_files_per_trigger=files))))
        windows = streaming.stream_client_windows(streaming.observed(arriving), duration="1 day")
        streaming.run_counted(windows, out, checkpoint, ledger)
        return tuple(streaming.dropped_rows(spark, out, checkpoint, ledger).first())

    deliver("1", 20, 40)
    assert run() == (40, 0, 40, 0)
    deliver("2", 22, 30)
    read, emitted, still_open, dropped = run()
    assert (read, dropped) == (70, 0) and emitted + still_open == 70 and still_open >= 30
    assert run() == (read, emitted, still_open, 0)  # nothing new
    deliver("3", 2, 25)  # far behind
    deliver("4", 22, 10)  # in time
    read, emitted, still_open, dropped = run()
    assert (read, dropped) == (105, 25) and emitted + still_open == 80
    told = streaming.read_ledger(spark, ledger).agg(F.sum("rows"), F.sum("state_rows_dropped") > 0).first()
    assert tuple(told) == (105, True)


def test_every_line_is_parsed_once(spark):
    """Routed rows are the accepted and the rejected ones, from one match a line."""
    lines = tables.lines(spark, SF_DIR)
    common, combined = (lines.filter(F.col("source") == n).select("value") for n in ("access_log", "web_server_log"))
    routed = access.routed_rows(common, combined)
    kept = routed.filter("accepted").drop(*access.ROUTED)
    assert sorted(map(str, kept.collect())) == sorted(map(str, access_rows(common, combined).collect()))
    left = routed.filter("NOT accepted").select(F.col("rejected_line").alias("value"), "source")
    assert sorted(left.collect()) == sorted(access.rejected_lines(common, combined).collect())
    plan = routed._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert plan.count("regexp_replace") == 2  # one for each format

"""Lines that are easy to get wrong."""

import datetime

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import parse
from trafficlens.operators.clean import clean, quality
from trafficlens.operators.enrich import enrich
from trafficlens.plans.access import access_rows, rejected_lines
from trafficlens.schema import ACCESS_SCHEMA, check_schema, null_violations

HEAD = "1.2.3.4 - - [15/Jul/2009:15:50:35 -0700] "
GOOD = {
    "plain": HEAD + '"GET /a HTTP/1.1" 200 10',
    "no bytes": HEAD + '"GET /a HTTP/1.1" 200 -',
    "big": HEAD + '"GET /a HTTP/1.1" 200 3000000000',
    "bad time": '1.2.3.4 - - [99/Foo/2009:15:50:35 -0700] "GET /a HTTP/1.1" 200 1',
    "separator": HEAD + '"GET /a\u0001b HTTP/1.1" 200 1',
    "bad bytes": HEAD + '"GET /a HTTP/1.1" 200 12x',
    "more": HEAD + '"GET /a HTTP/1.1" 200 5 "-" "JavaScript-client" "-"',
}
BAD = [
    HEAD + '"GET /" 403 202',
    HEAD + '"-" 408 -',
    HEAD + '"GET /a b HTTP/1.1" 200 5',
    "",
    "garbage",
]


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


@pytest.fixture(params=["true", "false"], ids=["ansi", "no-ansi"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_good_lines_survive_and_bad_ones_do_not(spark, ansi):
    every = lines(spark, [*GOOD.values(), *BAD])
    kept = clean(parse.parse_common(every))
    assert kept.count() == len(GOOD)
    assert sorted(r.value for r in parse.quarantine(every, parse.COMMON).collect()) == sorted(BAD)
    # cached between parsing and cleaning: no reliance on the optimizer's rule order
    cached = parse.parse_common(every).cache()
    assert clean(cached).exceptAll(kept).count() == 0
    cached.unpersist()


def test_null_line_is_quarantined(spark):
    every = spark.createDataFrame([(None,), (GOOD["plain"],)], "value string")
    assert parse.parse_lines(every, parse.COMMON).count() == 1
    assert [r.value for r in parse.quarantine(every, parse.COMMON).collect()] == [None]


def test_values(spark, ansi):
    rows = {
        name: clean(parse.parse_common(lines(spark, [text]))).first() for name, text in GOOD.items()
    }
    assert rows["no bytes"].bytes == 0
    assert rows["big"].bytes == 3_000_000_000
    assert rows["bad bytes"].bytes is None
    assert rows["bad time"].timestamp is None
    assert rows["separator"].endpoint == "/a\u0001b"
    assert rows["plain"].timestamp == datetime.datetime(2009, 7, 15, 22, 50, 35)
    assert rows["more"].user_agent is None and rows["more"].is_bot == 0


def test_offsets_name_the_same_instant(spark):
    texts = [
        f'1.1.1.1 - - [{t}] "GET / HTTP/1.1" 200 1'
        for t in ("22/Jan/2019:00:26:14 +0000", "22/Jan/2019:03:56:14 +0330",
                  "21/Jan/2019:17:26:14 -0700")
    ]
    times = {r.timestamp for r in clean(parse.parse_common(lines(spark, texts))).collect()}
    assert times == {datetime.datetime(2019, 1, 22, 0, 26, 14)}


def test_combined(spark):
    every = lines(spark, [GOOD["more"], GOOD["plain"], HEAD + '"GET /a HTTP/1.1" 200 5 "-" "" "-"'])
    kept = clean(parse.parse_combined(every))
    assert {(r.user_agent, r.is_bot) for r in kept.collect()} == {("JavaScript-client", 1), ("", 0)}
    assert parse.quarantine(every, parse.COMBINED).count() == 1


@pytest.mark.parametrize(
    "agent,bot",
    [("Googlebot/2.1", 1), ("python-requests/2", 1), ("Go-http-client", 1), ("CURL/8", 1),
     ("AhrefsBot", 1), ("Mozilla/5.0", 0), ("python", 0), ("", 0)],
)
def test_bot_words(spark, agent, bot):
    text = HEAD + f'"GET /a HTTP/1.1" 200 5 "-" "{agent}" "-"'
    assert clean(parse.parse_combined(lines(spark, [text]))).first().is_bot == bot


def test_single_pass_equals_group_by_group(spark):
    """The same fields as one plain regexp_extract per group."""
    texts = [*GOOD.values(), *BAD, HEAD + '"GET /x$1 HTTP/1.1" 404 1 "a" "b\\c" "d" tail']
    every = lines(spark, texts)
    for fmt in (parse.COMMON, parse.COMBINED):
        plain = every.select(*[
            F.regexp_extract("value", fmt.pattern, i).alias(name)
            for i, name in enumerate(fmt.groups, 1) if name
        ]).filter("ip != ''")
        single = parse.parse_lines(every, fmt)
        assert single.exceptAll(plain).count() == 0 and plain.exceptAll(single).count() == 0


def test_one_match_per_line_in_the_plan(spark):
    plan = clean(parse.parse_combined(lines(spark, BAD)))._jdf.queryExecution().executedPlan()
    assert plan.toString().count("regexp_replace") == 1


def test_severity_status_and_hours(spark):
    texts = [
        f'1.1.1.1 - - [22/Jan/2019:{h:02d}:00:00 +0000] "GET / HTTP/1.1" {status} 1'
        for h, status in ((7, 418), (8, 505), (22, 499), (23, 503), (0, 404), (12, 302))
    ]
    rows = enrich(clean(parse.parse_common(lines(spark, texts)))).orderBy("timestamp").collect()
    assert [(r.hour_of_day, r.is_off_hours) for r in rows] == [
        (0, 1), (7, 1), (8, 0), (12, 0), (22, 0), (23, 1)
    ]
    by_status = {r.status_code: (r.is_error, r.error_severity, r.status_class) for r in rows}
    assert by_status == {
        418: (1, "none", "4xx"), 505: (1, "none", "5xx"), 499: (1, "medium", "4xx"),
        503: (1, "fatal", "5xx"), 404: (1, "low", "4xx"), 302: (0, "none", "3xx"),
    }
    assert rows[0].day_of_week == 3  # a Tuesday


def test_zone_is_a_parameter(spark):
    row = clean(parse.parse_common(lines(spark, [GOOD["plain"]])))
    assert enrich(row).first().hour_of_day == 22
    assert enrich(row, zone="America/Los_Angeles").first().hour_of_day == 15


def test_unknown_time_is_not_off_hours(spark):
    row = enrich(clean(parse.parse_common(lines(spark, [GOOD["bad time"]])))).first()
    assert row.hour_of_day is None and row.is_off_hours == 0


def test_good_and_rejected_are_the_input(spark):
    common, combined = lines(spark, [*GOOD.values(), *BAD]), lines(spark, [*GOOD.values(), *BAD])
    kept, lost = access_rows(common, combined), rejected_lines(common, combined)
    assert kept.count() + lost.count() == 2 * (len(GOOD) + len(BAD))


def test_quality_of_nothing(spark):
    row = quality(clean(parse.parse_common(lines(spark, BAD)))).first()
    assert row.total_rows == 0 and row.bot_pct is None


def test_schema_check(spark):
    good = clean(parse.parse_common(lines(spark, GOOD.values())))
    check_schema(good, strict=True)
    with pytest.raises(ValueError, match="missing"):
        check_schema(good.drop("ip"))
    with pytest.warns(UserWarning, match="extra"):
        check_schema(good.withColumn("other", F.lit(1)))
    with pytest.raises(ValueError, match="types"):
        check_schema(good.withColumn("bytes", F.col("bytes").cast("int")), strict=True)
    nulls = {r["column"]: r["violations"] for r in null_violations(good).collect()}
    assert nulls["timestamp"] == 1 and nulls["user_agent"] == 0
    assert set(nulls) == set(ACCESS_SCHEMA.names)


def test_server_lines(spark):
    head = "2015-10-17 15:37:28,981 ERROR [main] org.apache.hadoop.X: "
    texts = [
        head + "java.io.IOException: container_14_01 of attempt_1445_m_2 failed: late",
        "\tat org.apache.X.run(X.java:10)",
        "2015-10-17 15:37:28,981 INFO ContainerLauncher - launch failed",
    ]
    parsed = parse.parse_server(lines(spark, texts))
    rows = {r.raw_log: r for r in parsed.collect()}
    first = rows[texts[0]]
    assert (first.log_level, first.thread, first.component) == ("ERROR", "main", "org.apache.hadoop.X")
    assert first.message.endswith("failed: late")
    for text in texts[1:]:
        assert (rows[text].timestamp, rows[text].message) == ("", "")
    typed = {r.stack_trace or "line": r for r in parse.server_fields(parsed).collect()}
    line = typed["line"]
    assert line.timestamp == datetime.datetime(2015, 10, 17, 15, 37, 28, 981000)
    assert (line.exception_type, line.container_id, line.attempt_id) == (
        "IOException", "container_14_01", "attempt_1445_m_2"
    )
    assert typed[texts[1]].timestamp is None


def test_newlines_are_no_match(spark):
    """A value that merely splits into as many pieces as a record is no record."""
    from trafficlens.operators import parse

    good = '1.2.3.4 - - [22/Jan/2019:03:56:14 +0330] "GET /a{} HTTP/1.1" 200 5'
    values = ["a\nb\nc\nd\ne\nf", "\na\nb\nc\nd\ne\nf", good.format(""), good.format("\nb"), None, ""]
    lines = spark.createDataFrame([(v,) for v in values], "value string")
    kept = parse.parse_lines(lines.select("value", lines.value.alias("line")), parse.COMMON)
    left = [r.value for r in parse.quarantine(lines, parse.COMMON).collect()]
    matching = [v for v in values if v and parse_matches(spark, v)]
    assert sorted(r.line for r in kept.collect()) == sorted(matching)
    assert sorted(left, key=str) == sorted((v for v in values if v not in matching), key=str)
    assert good.format("") in matching


def parse_matches(spark, value):
    from trafficlens import fixed_values as fixed

    row = spark.createDataFrame([(value,)], "v string").selectExpr("v")
    return row.filter(row.v.rlike(fixed.COMMON_LOG_PATTERN)).count() == 1


def test_hours_on_both_sides_of_clock_changes(spark):
    """Session zones with clock changes do not move the hours of another zone."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    from pyspark.sql import functions as F

    from trafficlens.functions.requests import local_time

    starts = [datetime(2024, 3, 10, 4), datetime(2024, 11, 3, 4), datetime(2024, 3, 31, 0), datetime(2024, 10, 27, 0)]
    instants = [(t + timedelta(minutes=30 * i)).replace(tzinfo=timezone.utc) for t in starts for i in range(8)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", session)
            seconds = spark.createDataFrame([(int(t.timestamp()),) for t in instants], "s long")
            for zone in ("UTC", "Europe/Berlin", "America/New_York"):
                hour = F.hour(local_time(F.timestamp_seconds("s"), zone)).alias("h")
                got = [r.h for r in seconds.select(hour).collect()]
                assert got == [t.astimezone(ZoneInfo(zone)).hour for t in instants], (session, zone)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

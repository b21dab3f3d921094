"""Log lines to string columns.

One regular-expression match per line: a matching line is rewritten as its groups
joined by newlines. The rewritten line is shorter than the line, as the pattern's own
characters outnumber the newlines, so a value matched if and only if it changed; a
value that merely holds newlines did not. Where a group holds a newline itself, the
groups of that value are extracted one by one. ``explode`` over a one-element array
keeps the optimizer from copying an expression into the filter and into every output
column, and stays inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens import fixed_values as fixed
from trafficlens.functions import requests as rq

_SEPARATOR = "\n"


@dataclass(frozen=True)
class LogFormat:
    """A line pattern and the name of each of its groups; None drops the group."""

    pattern: str
    groups: tuple[str | None, ...]
    anchored: bool = True

    @property
    def columns(self) -> list[str]:
        return [name for name in self.groups if name is not None]


COMMON = LogFormat(
    fixed.COMMON_LOG_PATTERN,
    ("ip", "timestamp_raw", "method", "endpoint", "status_raw", "bytes_raw"),
)
COMBINED = LogFormat(
    fixed.COMBINED_LOG_PATTERN,
    ("ip", "timestamp_raw", "method", "endpoint", "status_raw", "bytes_raw", None, "user_agent"),
)
SERVER = LogFormat(
    fixed.SERVER_LOG_PATTERN,
    ("timestamp", "log_level", "thread", "component", "message"),
    anchored=False,
)


def _with_groups(lines: DataFrame, fmt: LogFormat, column: str) -> DataFrame:
    """Add ``_groups``: one string per group, or null when nothing matched."""
    before = "" if fmt.anchored else "^(?s:.*?)"
    whole_line = f"{before}{fmt.pattern}(?s:.*)"
    joined = _SEPARATOR.join(f"${i}" for i in range(1, len(fmt.groups) + 1))
    rewritten = F.regexp_replace(F.col(column), whole_line, joined)
    once = lines.select("*", F.explode(F.array(rewritten)).alias("_line"))
    pieces = F.split(F.col("_line"), _SEPARATOR)
    one_by_one = F.array(
        *(F.regexp_extract(F.col(column), whole_line, i + 1) for i in range(len(fmt.groups)))
    )
    groups = F.when(
        F.col("_line") != F.col(column),
        F.when(F.size(pieces) == len(fmt.groups), pieces).otherwise(one_by_one),
    )
    return once.select(
        *(F.col(c) for c in lines.columns), F.explode(F.array(groups)).alias("_groups")
    )


def _matched() -> Column:
    return F.col("_groups").isNotNull()


def _pick(fmt: LogFormat) -> list[Column]:
    return [
        F.col("_groups")[i].alias(name) for i, name in enumerate(fmt.groups) if name is not None
    ]


def parse_lines(lines: DataFrame, fmt: LogFormat, column: str = "value") -> DataFrame:
    """Rows of the matching lines; other columns of ``lines`` are carried along."""
    carried = [F.col(c) for c in lines.columns if c != column]
    return _with_groups(lines, fmt, column).filter(_matched()).select(*carried, *_pick(fmt))


def quarantine(lines: DataFrame, fmt: LogFormat, column: str = "value") -> DataFrame:
    """Exactly the lines that ``parse_lines`` leaves out, null lines included."""
    return _with_groups(lines, fmt, column).filter(~_matched()).drop("_groups")


def route(lines: DataFrame, fmt: LogFormat, column: str = "value") -> DataFrame:
    """Every line once: ``accepted``, the fields of a matching line, the text of another.

    What ``parse_lines`` and ``quarantine`` give apart, from one match per line.
    """
    rejected = F.when(~_matched(), F.col(column)).alias("rejected_line")
    return _with_groups(lines.select(column), fmt, column).select(
        _matched().alias("accepted"), rejected, *_pick(fmt)
    )


def parse_common(lines: DataFrame, source: str = fixed.ACCESS_SOURCE) -> DataFrame:
    """Common Log Format: no user agent, so never a bot."""
    return as_common(parse_lines(lines.select("value"), COMMON), source)


def as_common(fields: DataFrame, source: str = fixed.ACCESS_SOURCE) -> DataFrame:
    return fields.select(
        "*",
        F.lit(None).cast("string").alias("user_agent"),
        F.lit(0).alias("is_bot"),
        F.lit(source).alias("source"),
    )


def parse_combined(
    lines: DataFrame,
    source: str = fixed.WEB_SERVER_SOURCE,
    bot_keywords: tuple[str, ...] = fixed.BOT_KEYWORDS,
) -> DataFrame:
    """Combined Log Format: Common plus user agent; the referrer is not kept."""
    return as_combined(parse_lines(lines.select("value"), COMBINED), source, bot_keywords)


def as_combined(
    fields: DataFrame,
    source: str = fixed.WEB_SERVER_SOURCE,
    bot_keywords: tuple[str, ...] = fixed.BOT_KEYWORDS,
) -> DataFrame:
    return fields.select(
        "*",
        rq.bot_flag(F.col("user_agent"), bot_keywords).alias("is_bot"),
        F.lit(source).alias("source"),
    )


def parse_server(lines: DataFrame, column: str = "value") -> DataFrame:
    """Application-server lines; lines without a match stay, with empty fields."""
    carried = [F.col(c) for c in lines.columns if c != column]
    groups = F.col("_groups")
    fields = [
        F.when(F.col(column).isNull(), F.lit(None))
        .when(_matched(), groups[i])
        .otherwise("")
        .alias(name)
        for i, name in enumerate(SERVER.groups)
    ]
    return _with_groups(lines, SERVER, column).select(
        *carried, *fields, F.col(column).alias("raw_log")
    )


def server_fields(parsed: DataFrame, system: str = "yarn") -> DataFrame:
    """Typed server-log rows: real timestamp, plus ids and exception named in the message.

    ``stack_trace`` is the text of a continuation line; it stays on its own row,
    because lines of a distributed text scan carry no order to stitch them by.
    """
    raw, message = F.col("raw_log"), F.col("message")

    def found(pattern: str) -> Column:
        text = F.when(message != "", message).otherwise(raw)
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    return parsed.select(
        rq.zoned_timestamp(F.col("timestamp"), fixed.SERVER_TIME_FORMAT).alias("timestamp"),
        "log_level",
        F.lit(system).alias("system"),
        "component",
        "message",
        found(fixed.EXCEPTION_PATTERN).alias("exception_type"),
        F.when(F.col("timestamp") == "", raw).alias("stack_trace"),
        found(fixed.CONTAINER_PATTERN).alias("container_id"),
        found(fixed.ATTEMPT_PATTERN).alias("attempt_id"),
    )

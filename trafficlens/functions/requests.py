"""Per-request column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens import fixed_values as fixed


def zoned_timestamp(raw: Column, fmt: str = fixed.ACCESS_TIME_FORMAT) -> Column:
    """Instant of a log timestamp; null when it cannot be read."""
    return F.try_to_timestamp(raw, F.lit(fmt))


def byte_count(raw: Column) -> Column:
    """``-`` means no body and counts as 0; anything unreadable is null."""
    return F.when(raw == "-", F.lit(0).cast("bigint")).otherwise(raw.try_cast("bigint"))


def status_number(raw: Column) -> Column:
    return raw.try_cast("int")


def error_flag(status: Column) -> Column:
    return F.when(status >= 400, 1).otherwise(0)


def status_class(status: Column) -> Column:
    """1xx..5xx by hundreds; everything from 500 up, and null, is 5xx."""
    bands = F
    for hundreds in (1, 2, 3, 4):
        bands = bands.when(status < (hundreds + 1) * 100, f"{hundreds}xx")
    return bands.otherwise("5xx")


def bot_flag(user_agent: Column, keywords: Iterable[str] = fixed.BOT_KEYWORDS) -> Column:
    """1 when any keyword occurs anywhere in the lower-cased user agent.

    Plain substring searches cost a fraction of one regular expression with all the
    words; a word that contains another one adds nothing and is not searched.
    """
    words = set(keywords)
    shortest = sorted(w for w in words if not any(o != w and o in w for o in words))
    text = F.lower(user_agent)
    found = reduce(or_, (F.contains(text, F.lit(word)) for word in shortest), F.lit(False))
    return F.when(found, 1).otherwise(0)


def error_severity(
    status: Column, codes: Mapping[str, tuple[int, ...]] = fixed.SEVERITY_CODES
) -> Column:
    (first, members), *others = codes.items()
    levels = F.when(status.isin(*members), first)
    for level, members in others:
        levels = levels.when(status.isin(*members), level)
    return levels.otherwise("none")


def local_time(timestamp: Column, zone: str | None = None) -> Column:
    """Wall-clock time in ``zone``, or in the session time zone when None.

    It is computed from the instant, so it holds on both sides of clock changes of
    either zone.
    """
    if zone is None:
        return timestamp
    seconds = F.unix_micros(timestamp).cast("decimal(20,0)") / 1_000_000
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    utc = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def off_hours_flag(hour: Column, business_hours: tuple[int, int] = fixed.BUSINESS_HOURS) -> Column:
    """1 outside the business hours; an unknown hour counts as inside."""
    first, last = business_hours
    return F.when(~hour.between(first, last), 1).otherwise(0)


def lookup(key: Column, names: Mapping[int, str]) -> Column:
    """Name of a small integer code, null for codes without a name."""
    (first, name), *others = names.items()
    named = F.when(key == first, name)
    for code, name in others:
        named = named.when(key == code, name)
    return named.otherwise(F.lit(None).cast("string"))


def rank_in(value: Column, order: Iterable[str]) -> Column:
    """Position of ``value`` in a fixed category order, 0 outside it."""
    return F.array_position(F.array(*[F.lit(name) for name in order]), value)

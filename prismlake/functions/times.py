"""Instants are milliseconds since 1970; months are in UTC, days in a zone of the caller's."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def effective_ts(captured: str = "captured_at", modified: str = "file_modified_at") -> Column:
    """When a file counts as taken: captured, else modified."""
    return F.coalesce(F.col(captured), F.col(modified))


def at(ms: Column) -> Column:
    """A timestamp of whole seconds; fractions are dropped toward zero."""
    return F.timestamp_seconds((ms - ms % 1000) / 1000)


def in_utc(ms: Column, pattern: str) -> Column:
    """A UTC text of an instant, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at(ms), F.current_timezone()), pattern)


def month(ms: Column) -> Column:
    return in_utc(ms, "yyyy-MM")


def day(ms: Column, zone: str = "UTC") -> Column:
    """The day of an instant in a zone, as text."""
    utc = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    return F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd")


def month_bounds(month_: str) -> tuple[int, int]:
    """First and last millisecond of a month, in UTC."""
    y, m = map(int, month_.split("-"))
    first = datetime(y, m, 1, tzinfo=timezone.utc)
    after = datetime(y + m // 12, m % 12 + 1, 1, tzinfo=timezone.utc)
    return int(first.timestamp() * 1000), int(after.timestamp() * 1000) - 1


def preset(name: str, as_of: date, zone: str = "UTC") -> tuple[int | None, int | None]:
    """From and to of a date preset: all, last_30_days, this_year or last_year; days are those of `zone`."""
    tz = ZoneInfo(zone)
    start = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=tz).timestamp() * 1000)
    if name == "all":
        return None, None
    if name == "last_30_days":
        return start(as_of - timedelta(days=30)), None
    if name in ("this_year", "last_year"):
        y = as_of.year - (name == "last_year")
        return start(date(y, 1, 1)), start(date(y + 1, 1, 1)) - 1
    raise ValueError(f"no preset {name}")

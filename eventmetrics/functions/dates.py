"""Time ranges, buckets and ISO text. All time is UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# Bucket widths and series metrics a caller may ask for.
INTERVALS = ("minute", "hour", "day", "week", "month")
METRICS = ("page_views", "unique_visitors", "bounce_rate", "avg_session_duration")
DEFAULT_RANGE = timedelta(days=30)

MICROS = 1_000_000


def check_interval(interval: str) -> str:
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {', '.join(INTERVALS)}: {interval!r}")
    return interval


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}: {metric!r}")
    return metric


def utc(moment: datetime) -> datetime:
    """A naive bound is taken as UTC, an aware one is converted."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def resolve_range(
    start: datetime | None, end: datetime | None, as_of: datetime
) -> tuple[datetime, datetime]:
    end = utc(end) if end is not None else utc(as_of)
    start = utc(start) if start is not None else end - DEFAULT_RANGE
    return start, end


def auto_interval(lookback_hours: float) -> str:
    return "hour" if lookback_hours <= 24 else "day"


def moment(value: datetime | Column) -> Column:
    """A timestamp column from a Python datetime (naive means UTC)."""
    if isinstance(value, Column):
        return value
    return F.lit(utc(value))


def bucket(interval: str, ts: str = "timestamp") -> Column:
    return F.date_trunc(check_interval(interval), F.col(ts))


def micros_between(first: Column, last: Column) -> Column:
    return F.unix_micros(last) - F.unix_micros(first)


def mean_seconds(micros: Column, count: Column) -> Column:
    """Mean of durations in seconds, from their sum in whole microseconds: one division, one rounding."""
    return micros.cast("double") / F.nullif((count * MICROS).cast("double"), F.lit(0.0))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to timestamp, NULL when it is not one; no zone means UTC."""
    trimmed = F.trim(text)
    # A cast alone would also take a bare year or a bare time of day.
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), trimmed.try_cast("timestamp"))


def iso_text(ts: Column) -> Column:
    """``2024-01-31T00:00:00+00:00``, with microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.when(F.unix_micros(ts) % MICROS != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(whole, micros, F.lit("+00:00"))


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def month_of(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def partition_name(month: Column) -> Column:
    return F.date_format(month, "'events_y'yyyy'm'MM")

"""Tenant totals: views, visitors, sessions, errors, and their change between periods."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from eventmetrics.functions.dates import mean_seconds, micros_between, moment, utc
from eventmetrics.functions.numbers import percent, percent_change
from eventmetrics.functions.payload import is_error, is_page_view, with_identity
from eventmetrics.operators.scope import scope

OVERVIEW_METRICS = ("page_views", "unique_visitors", "bounce_rate", "avg_session_duration")


def keyed_rows(events: DataFrame, by: list[str]) -> DataFrame:
    """One row per (``by``, session) and one per (``by``, visitor), from one scan.

    Session metrics and distinct visitors need different keys. Grouping sets
    give both in one pass with one shuffle, and the map-side partial
    aggregation keeps that shuffle at the number of sessions and visitors, no
    matter how many events a single one of them has.

    ``is_session`` tells the two kinds apart. Rows without a session or
    visitor id form a NULL key, which counts for views but is no session.
    """
    return (
        with_identity(events)
        .groupingSets(
            [[*by, "session_id"], [*by, "visitor_id"]], *by, "session_id", "visitor_id"
        )
        .agg(
            (F.grouping("session_id") == 0).alias("is_session"),
            F.count(F.lit(1)).alias("events"),
            F.count_if(is_page_view()).alias("page_views"),
            F.count_if(is_error()).alias("errors"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        )
    )


def totals(when: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates over ``keyed_rows`` giving all tenant metrics, optionally for some rows only."""
    when = F.lit(True) if when is None else when
    visitor = when & ~F.col("is_session")
    session = when & F.col("is_session") & F.col("session_id").isNotNull()
    bounced = session & (F.col("events") == 1)
    duration = micros_between(F.col("first_ts"), F.col("last_ts"))

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(visitor, F.col(column))), F.lit(0)).cast("bigint")

    return [
        total("page_views").alias(f"{prefix}page_views"),
        F.count_if(visitor & F.col("visitor_id").isNotNull()).alias(f"{prefix}unique_visitors"),
        percent(F.count_if(bounced), F.count_if(session)).alias(f"{prefix}bounce_rate"),
        F.coalesce(
            mean_seconds(F.sum(F.when(session, duration)), F.count_if(session)), F.lit(0.0)
        ).alias(f"{prefix}avg_session_duration"),
    ]


def _all_orgs(result: DataFrame, orgs: DataFrame | None) -> DataFrame:
    """Also list tenants without any event, with zeros."""
    if orgs is None:
        return result
    listed = orgs.select("organization_id").distinct()
    return listed.join(result, "organization_id", "left").fillna(0)


def overview(
    events: DataFrame, start: datetime, end: datetime, orgs: DataFrame | None = None
) -> DataFrame:
    rows = keyed_rows(scope(events, start, end), ["organization_id"])
    return _all_orgs(rows.groupBy("organization_id").agg(*totals()), orgs)


def with_changes(pairs: DataFrame) -> DataFrame:
    """Turn ``cur_*`` and ``prior_*`` columns into values and ``*_change`` columns."""
    keys = [c for c in pairs.columns if not c.startswith(("cur_", "prior_"))]
    return pairs.select(
        *keys,
        *[F.col(f"cur_{m}").alias(m) for m in OVERVIEW_METRICS],
        *[
            percent_change(F.col(f"cur_{m}"), F.col(f"prior_{m}")).alias(f"{m}_change")
            for m in OVERVIEW_METRICS
        ],
    )


def period_tags(start: Column) -> Column:
    """Periods of an event between prior start and end; one at exactly ``start`` is in both."""
    ts = F.col("timestamp")
    both = F.array(F.lit("cur"), F.lit("prior"))
    return F.when(ts == start, both).otherwise(
        F.array(F.when(ts > start, F.lit("cur")).otherwise(F.lit("prior")))
    )


def overview_delta(
    events: DataFrame, start: datetime, end: datetime, orgs: DataFrame | None = None
) -> DataFrame:
    """Totals with their change against the period of equal length before ``start``.

    Both periods come from one scan; each event is tagged with its period(s).
    """
    start, end = utc(start), utc(end)
    prior_start = start - (end - start)
    tagged = with_identity(scope(events, prior_start, end)).withColumn(
        "period", F.explode(period_tags(moment(start)))
    )
    pairs = (
        keyed_rows(tagged, ["organization_id", "period"])
        .groupBy("organization_id")
        .agg(
            *totals(F.col("period") == "cur", "cur_"),
            *totals(F.col("period") == "prior", "prior_"),
        )
    )
    return _all_orgs(with_changes(pairs), orgs)


def errors(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Error count and error rate per tenant."""
    failed = F.count_if(is_error())
    return (
        scope(events, start, end)
        .groupBy("organization_id")
        .agg(failed.alias("error_count"), percent(failed, F.count(F.lit(1))).alias("error_rate"))
    )


def event_frequency(events: DataFrame) -> DataFrame:
    """Rows per tenant and event name, most frequent first."""
    return (
        events.groupBy("organization_id", "event_name")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy("organization_id", F.desc("event_count"), "event_name")
    )

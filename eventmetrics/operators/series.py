"""Bucketed time series, moving averages and chart shapes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmetrics.functions.dates import METRICS, bucket, check_metric, mean_seconds, micros_between
from eventmetrics.functions.numbers import percent
from eventmetrics.functions.payload import is_page_view, with_identity
from eventmetrics.operators.overview import keyed_rows, totals
from eventmetrics.operators.scope import scope


def moving_average(series: DataFrame, window: int = 7, by: tuple[str, ...] = ("organization_id",)) -> DataFrame:
    """Average of the last ``window`` rows per series; missing buckets are not filled in.

    Runs on aggregated points, so a partition holds one row per bucket of time.
    """
    frame = (
        Window.partitionBy(*by).orderBy("bucket").rowsBetween(-max(0, window - 1), Window.currentRow)
    )
    return series.withColumn("moving_average", F.avg("value").over(frame))


def _points(events: DataFrame, metric: str) -> DataFrame:
    keys = ["organization_id", "bucket"]
    if metric == "page_views":
        return events.groupBy(*keys).agg(F.count_if(is_page_view()).cast("double").alias("value"))
    events = with_identity(events)
    if metric == "unique_visitors":
        return events.groupBy(*keys).agg(
            F.count_distinct("visitor_id").cast("double").alias("value")
        )
    sessions = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy(*keys, "session_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        )
    )
    value: Column
    if metric == "bounce_rate":
        value = percent(F.count_if(F.col("events") == 1), F.count(F.lit(1)))
    else:
        value = mean_seconds(F.sum(micros_between(F.col("first_ts"), F.col("last_ts"))), F.count(F.lit(1)))
    return sessions.groupBy(*keys).agg(value.alias("value"))


def timeseries(
    events: DataFrame,
    metric: str,
    interval: str,
    start: datetime,
    end: datetime,
    window: int = 7,
) -> DataFrame:
    """One metric per tenant and bucket with its moving average.

    Buckets without events are absent, as are buckets without sessions for the
    two session metrics. A session crossing buckets counts in each of them.
    """
    check_metric(metric)
    bucketed = scope(events, start, end).withColumn("bucket", bucket(interval))
    return moving_average(_points(bucketed, metric), window)


def all_metric_points(events: DataFrame, by: list[str]) -> DataFrame:
    """All four metrics of each ``by`` group as rows (``by``, metric, value), from one scan.

    ``events`` must already carry the ``by`` columns.
    """
    rows = keyed_rows(events, by)
    with_sessions = F.count_if(F.col("is_session") & F.col("session_id").isNotNull())
    wide = rows.groupBy(*by).agg(*totals(), with_sessions.alias("sessions"))
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in METRICS
        ]
    )
    needs_session = F.col("metric").isin("bounce_rate", "avg_session_duration")
    return (
        wide.select(*by, "sessions", F.inline(pairs))
        .filter(~needs_session | (F.col("sessions") > 0))
        .drop("sessions")
    )


def chart_of(
    events: DataFrame, metric_a: str, metric_b: str, interval: str, start: datetime, end: datetime
) -> DataFrame:
    """Two metrics side by side from one scan; a bucket that one of them lacks gets 0 for it."""
    keys = ["organization_id", "bucket"]
    for metric in (metric_a, metric_b):
        check_metric(metric)
    bucketed = scope(events, start, end).withColumn("bucket", bucket(interval))
    # Points come out dealt by the same keys, so bringing them together moves nothing.
    return (
        all_metric_points(bucketed, keys)
        .filter(F.col("metric").isin(metric_a, metric_b))
        .groupBy(*keys)
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m)
                for m in dict.fromkeys((metric_a, metric_b))
            ]
        )
    )


def chart_merge(
    series_a: DataFrame, series_b: DataFrame, name_a: str, name_b: str
) -> DataFrame:
    """Two series side by side; a bucket present in only one of them gets 0 for the other."""
    keys = ["organization_id", "bucket"]
    return (
        series_a.select(*keys, F.col("value").alias(name_a))
        .join(series_b.select(*keys, F.col("value").alias(name_b)), keys, "full_outer")
        .fillna(0.0, subset=[name_a, name_b])
        .orderBy(*keys)
    )


def _from_end(series: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Position from the end, number of points and largest value of each series."""
    whole = Window.partitionBy(*by)
    return series.withColumns(
        {
            "_back": F.row_number().over(whole.orderBy(F.desc("bucket"))),
            "_points": F.count(F.lit(1)).over(whole),
            "_top": F.max("value").over(whole),
        }
    )


def _ord(k: int) -> Column:
    return (F.least(F.lit(k), F.col("_points")) - F.col("_back") + 1).cast("bigint")


def _height() -> Column:
    scale = F.when(F.col("_top") == 0, F.lit(1.0)).otherwise(F.col("_top"))
    return F.floor(F.col("value") / scale * 100.0).cast("bigint")


def tail_points(series: DataFrame, k: int = 8, by: tuple[str, ...] = ("organization_id",)) -> DataFrame:
    """The last ``k`` points of each series, oldest first in ``ord``."""
    kept = _from_end(series, by).filter(F.col("_back") <= k)
    return kept.withColumn("ord", _ord(k)).drop("_back", "_points", "_top")


def bar_heights(series: DataFrame, k: int = 12, by: tuple[str, ...] = ("organization_id",)) -> DataFrame:
    """The last ``k`` points with a height in whole percent of the largest of all points."""
    kept = _from_end(series, by).filter(F.col("_back") <= k)
    return kept.withColumns({"ord": _ord(k), "height": _height()}).drop("_back", "_points", "_top")


def chart_rows(
    series: DataFrame, by: tuple[str, ...], points: int, bars: int, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Tail points and bars of each series as rows (``keep``, ``section``, ord, bucket, value, height)."""
    numbered = _from_end(series, by).filter(F.col("_back") <= max(points, bars))
    none = F.lit(None).cast("bigint")
    shapes = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("_back") <= k,
                    F.struct(F.lit(name).alias("section"), _ord(k).alias("ord"), height.alias("height")),
                )
                for name, k, height in (("point", points, none), ("bar", bars, _height()))
            ]
        )
    )
    return numbered.select(*by, *keep, "bucket", "value", F.inline(shapes))

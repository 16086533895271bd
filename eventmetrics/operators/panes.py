"""Partial states of one minute: what later questions need of its events.

A pane has one row per session and one per visitor of a tenant and minute, as
``overview.keyed_rows`` gives them: counts, and the first and last moment. Rows
of equal keys combine by adding counts and widening the span, so a minute may
be written in parts, whenever its events come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventmetrics.operators.overview import keyed_rows

KEYS = ["organization_id", "minute", "on_edge"]


def panes(events: DataFrame) -> DataFrame:
    """One pane per tenant and minute. Events at the very start of a minute are kept apart (``on_edge``).

    A range that ends with a whole minute, end included, takes that instant of
    the minute after.
    """
    minute = F.date_trunc("minute", F.col("timestamp"))
    placed = events.withColumns({"minute": minute, "on_edge": F.col("timestamp") == minute})
    return keyed_rows(placed, KEYS)


def combined(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of panes that fall in the same group, as one per session and visitor."""
    return rows.groupBy(*by, "is_session", "session_id", "visitor_id").agg(
        *[F.sum(c).alias(c) for c in ("events", "page_views", "errors")],
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def write_panes(rows: DataFrame, path: str, batch: int) -> None:
    """Panes of one batch of arrivals, by day; a batch that is run again replaces its folder."""
    dated = rows.withColumn("pane_day", F.to_date("minute"))
    dated.write.partitionBy("pane_day").mode("overwrite").parquet(f"{path}/batch={batch}")

"""Row selection: tenant, time range, soft deletes, paging, public shares, joins to config tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmetrics.functions.dates import moment, month_of

# Rows of a few short columns: some tens of megabytes.
MAX_SMALL_ROWS = 500_000


def between(events: DataFrame, low: Column, high: Column) -> DataFrame:
    """Events of ``[low, high]``, both ends included.

    A stored table is split by month; the month bounds are stated as well
    because a filter on ``timestamp`` alone does not prune its folders.
    """
    kept = events.filter(F.col("timestamp").between(low, high))
    if "event_month" in events.columns:
        kept = kept.filter(F.col("event_month").between(month_of(low), month_of(high)))
    return kept


def scope(events: DataFrame, start: datetime, end: datetime, org: str | None = None) -> DataFrame:
    """Events of a range, of one tenant or of all."""
    kept = between(events, moment(start), moment(end))
    return kept if org is None else kept.filter(F.col("organization_id") == org)


def active(table: DataFrame, include_deleted: bool = False) -> DataFrame:
    return table if include_deleted else table.filter(~F.col("is_deleted"))


def page(table: DataFrame, *order: Column, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of a listing. The order must be total, or pages may overlap."""
    return table.orderBy(*order).offset(skip).limit(limit)


def page_per_org(table: DataFrame, *order: Column, skip: int = 0, limit: int = 100) -> DataFrame:
    """The same page for every tenant at once, with its position ``ord``.

    The rank filter lets Spark keep only ``skip + limit`` rows per tenant and
    task before the shuffle, so a large tenant does not fill one task.
    """
    rank = F.row_number().over(Window.partitionBy("organization_id").orderBy(*order))
    ranked = table.withColumn("ord", rank).filter(F.col("ord") <= skip + limit)
    return ranked.filter(F.col("ord") > skip).withColumn("ord", F.col("ord").cast("bigint"))


def shared_scope(dashboards: DataFrame, token: str) -> DataFrame:
    return active(dashboards).filter(F.col("is_public") & (F.col("share_token") == token))


def shared_events(events: DataFrame, dashboards: DataFrame, token: str) -> DataFrame:
    """Events of the tenant behind a public share token; none for a wrong token.

    A token belongs to one dashboard, so its tenant is looked up first and
    reaches the scan of the events as a literal.
    """
    owners = shared_scope(dashboards, token).select("organization_id").distinct().limit(2).collect()
    if len(owners) > 1:
        raise ValueError("the share token belongs to dashboards of several tenants")
    return events.filter(F.col("organization_id") == owners[0][0] if owners else F.lit(False))


def small_side(table: DataFrame, rows: int, max_rows: int = MAX_SMALL_ROWS) -> DataFrame:
    """Hint a broadcast of a derived table whose counted size is small.

    Spark estimates a derived table by its inputs, often far too large, and
    would then shuffle all events for the join.
    ``rows`` is a counted upper bound; a larger table gets no hint, and the
    join then shuffles with skew splitting.
    """
    return F.broadcast(table) if rows <= max_rows else table

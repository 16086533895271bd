"""Counts by payload property."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmetrics.functions.numbers import percent
from eventmetrics.functions.payload import prop
from eventmetrics.operators.scope import scope

UNKNOWN = "unknown"
MAX_LIMIT = 100


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}: {limit}")
    return limit


def label_counts(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Rows per (``by``, label), and per ``by`` alone as ``is_total``, from one scan; ``weight``: rows that one stands for."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return rows.groupingSets([[*by, "label"], by], *by, "label").agg(
        (F.grouping("label") == 1).alias("is_total"), total.alias("count")
    )


def top_labels(counts: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The ``limit`` most frequent labels per group with their share of all rows.

    A property may have as many labels as there are events, so nothing here
    gathers a whole group in one task: the rank filter prunes to a few rows
    per task before its shuffle, and the total is one of these rows, ranked
    first, instead of a sum over a window.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy(F.desc("is_total"), F.desc("count"), F.asc("label"))
    top = counts.withColumn("_rank", F.row_number().over(order)).filter(
        F.col("_rank") <= limit + 1
    )
    total = F.max(F.when(F.col("is_total"), F.col("count"))).over(group)
    return (
        top.withColumn("_total", total)
        .filter(~F.col("is_total"))
        .select(
            *by,
            (F.col("_rank") - 1).cast("bigint").alias("ord"),
            "label",
            "count",
            percent(F.col("count"), F.col("_total")).alias("percentage"),
        )
    )


def label_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(UNKNOWN))


def breakdown(
    events: DataFrame, key: str, start: datetime, end: datetime, limit: int = 10
) -> DataFrame:
    """Top values of one payload property per tenant."""
    check_limit(limit)
    labelled = scope(events, start, end).select("organization_id", label_of(prop(key)).alias("label"))
    return top_labels(label_counts(labelled, ["organization_id"]), ["organization_id"], limit)


def top_share(top: DataFrame, by: tuple[str, ...] = ("organization_id",)) -> DataFrame:
    """Share of each returned row among the returned rows only, 1 decimal."""
    returned = F.sum("count").over(Window.partitionBy(*by))
    return top.withColumn("share", F.round(percent(F.col("count"), returned), 1))

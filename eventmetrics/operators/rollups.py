"""Minute rollups with visitor sketches: any bucket or range without the events.

Distinct visitors do not add up, but their sketches do. A rollup row holds a
tenant's counts of one minute and a HyperLogLog sketch of its visitors; rows of
the same minute, hour or range combine by sums and the union of sketches. The
estimate of ``2 ** SKETCH_BITS`` registers has a standard error of
1.04 / sqrt(2 ** SKETCH_BITS), under 1 %; ``ERROR_BOUND`` is four times that.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventmetrics.functions.dates import bucket, moment, month_of
from eventmetrics.functions.numbers import percent
from eventmetrics.functions.payload import is_error, is_page_view, with_identity

SKETCH_BITS = 14
ERROR_BOUND = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)
COUNTS = ("events", "page_views", "error_count")


def minute_rollup(events: DataFrame) -> DataFrame:
    """(organization_id, minute, counts, visitors): one scan, one row per tenant and minute."""
    return (
        with_identity(events)
        .groupBy("organization_id", bucket("minute").alias("minute"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(is_page_view()).alias("page_views"),
            F.count_if(is_error()).alias("error_count"),
            F.hll_sketch_agg("visitor_id", F.lit(SKETCH_BITS)).alias("visitors"),
        )
    )


def _added() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in COUNTS], F.hll_union_agg("visitors").alias("visitors")]


def rolled_up(rollup: DataFrame, interval: str) -> DataFrame:
    """Rollup rows of a wider bucket; the result rolls up further."""
    return rollup.groupBy("organization_id", bucket(interval, "minute").alias("minute")).agg(*_added())


def estimates(rollup: DataFrame) -> DataFrame:
    """Counts, error rate and estimated visitors of rollup rows."""
    return rollup.withColumns(
        {
            "unique_visitors": F.hll_sketch_estimate("visitors"),
            "error_rate": percent(F.col("error_count"), F.col("events")),
        }
    ).drop("visitors")


def bucket_estimates(rollup: DataFrame, interval: str) -> DataFrame:
    return estimates(rolled_up(rollup, interval)).withColumnRenamed("minute", "bucket")


def range_estimates(rollup: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same for (organization_id, range_start, range_end) rows, ends excluded, cut at whole minutes.

    Ranges may overlap; a minute is read once and joins the ranges it lies in.
    """
    minute = F.col("minute")
    inside = rollup.join(ranges, "organization_id").where(
        (minute >= F.date_trunc("minute", F.col("range_start"))) & (minute < F.date_trunc("minute", F.col("range_end")))
    )
    return estimates(inside.groupBy("organization_id", "range_start", "range_end").agg(*_added()))


def write_rollup(rollup: DataFrame, path: str, batch: int) -> None:
    """The rollup of one batch of events, by month. Minutes that several batches touch add up when read."""
    dated = rollup.withColumn("rollup_month", month_of(F.col("minute")))
    dated.hint("rebalance", "rollup_month").write.partitionBy("rollup_month").mode("overwrite").parquet(
        f"{path}/batch={batch}"
    )


def read_rollup(
    spark: SparkSession, path: str, start: datetime | Column | None = None, end: datetime | Column | None = None
) -> DataFrame:
    """Stored rollup rows, of ``[start, end)`` where given; whole months outside are not read."""
    rows = spark.read.parquet(path)
    if start is not None:
        low = moment(start)
        rows = rows.where((F.col("minute") >= low) & (F.col("rollup_month") >= month_of(low)))
    if end is not None:
        high = moment(end)
        rows = rows.where((F.col("minute") < high) & (F.col("rollup_month") <= month_of(high)))
    return rows.drop("batch", "rollup_month")

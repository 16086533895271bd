"""Bucketed metrics kept up to date while events arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from eventmetrics.functions.dates import bucket, month_of
from eventmetrics.functions.numbers import percent
from eventmetrics.operators.overview import keyed_rows, totals

KEYS = ["organization_id", "bucket"]
VALUES = (
    "page_views",
    "unique_visitors",
    "bounce_rate",
    "avg_session_duration",
    "error_count",
    "error_rate",
)


def bucket_metrics(bucketed: DataFrame) -> DataFrame:
    """All metrics per tenant and ``bucket``, from one scan."""
    visitor = ~F.col("is_session")
    failed = F.sum(F.when(visitor, F.col("errors")).otherwise(0))
    seen = F.sum(F.when(visitor, F.col("events")).otherwise(0))
    return (
        keyed_rows(bucketed, KEYS)
        .groupBy(*KEYS)
        .agg(*totals(), failed.cast("bigint").alias("error_count"), percent(failed, seen).alias("error_rate"))
        .select(*KEYS, *VALUES)
    )


def touched_buckets(batch: DataFrame, interval: str) -> DataFrame:
    """Tenants and buckets that a batch of events adds to, with the first and last moment of its rows."""
    return (
        batch.withColumn("bucket", bucket(interval))
        .groupBy(*KEYS)
        .agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    )


def recomputed(stored: DataFrame, touched: DataFrame, interval: str) -> DataFrame:
    """Metrics of the touched buckets over everything stored.

    The outer bounds reach the scan, as months too where the store is split by
    month; the semi join drops the buckets in between that got nothing.
    """
    low, high = touched.agg(
        F.min("bucket"), F.max(F.col("bucket") + F.expr(f"interval 1 {interval}"))
    ).first()
    if low is None:
        return bucket_metrics(stored.filter("false").withColumn("bucket", bucket(interval)))
    inside = stored.filter((F.col("timestamp") >= F.lit(low)) & (F.col("timestamp") < F.lit(high)))
    if "event_month" in stored.columns:
        first, last = (month_of(F.lit(moment)) for moment in (low, high))
        inside = inside.filter(F.col("event_month").between(first, last))
    bucketed = inside.withColumn("bucket", bucket(interval))
    return bucket_metrics(bucketed.join(touched.select(*KEYS), KEYS, "left_semi"))


def start_metrics(
    events: DataFrame,
    load_stored: Callable[[SparkSession], DataFrame],
    interval: str,
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Keep exact metrics of every bucket that has events, open and late ones included.

    ``events`` only says which buckets changed; their values are computed from
    the store, which must already hold the rows of the stream. A bucket is the
    same however rows are cut into batches and whenever they come. Each batch
    writes its buckets to a folder of its number, replaced if it is run again;
    ``read_metrics`` takes the newest value of each.
    """

    def run(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        touched_path = f"{path}/touched/slot={version % 2}"
        touched_buckets(batch, interval).write.mode("overwrite").parquet(touched_path)
        touched = spark.read.parquet(touched_path)
        fresh = recomputed(load_stored(spark), touched, interval)
        fresh.write.mode("overwrite").parquet(f"{path}/buckets/batch={version}")

    return (
        events.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The newest value of each tenant and bucket."""
    written = spark.read.parquet(f"{path}/buckets")
    newest = F.max_by(F.struct(*VALUES), "batch").alias("newest")
    return written.groupBy(*KEYS).agg(newest).select(*KEYS, "newest.*")


def compact_metrics(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest values as batch -1 below ``target``, for a query that goes on there."""
    read_metrics(spark, path).write.mode("overwrite").parquet(f"{target}/buckets/batch=-1")

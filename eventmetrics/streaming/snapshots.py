"""Small state tables kept by ``foreachBatch`` queries.

Batch N reads the snapshot of batch N - 1 and overwrites the oldest of a few
folders. A batch that is run again after a failure therefore finds its input
untouched and replaces only its own output. The number of the newest complete
snapshot is published after it is written; readers go by that number and never
touch the folder that is being replaced.
"""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

SLOTS = 4
TRIES, PAUSE_SECONDS = 5, 0.2


def _slot(path: str, version: int) -> str:
    return f"{path}/slot={version % SLOTS}"


def write_snapshot(table: DataFrame, path: str, version: int) -> None:
    numbered = table.withColumn("version", F.lit(version).cast("bigint"))
    numbered.write.mode("overwrite").parquet(_slot(path, version))
    number = table.sparkSession.range(1).select(F.lit(version).cast("bigint").alias("version"))
    number.coalesce(1).write.mode("overwrite").parquet(_slot(f"{path}-published", version))


def read_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    table = spark.read.parquet(_slot(path, version))
    return table.filter(F.col("version") == version).drop("version")


def _published(spark: SparkSession, path: str) -> int:
    """The newest published number; read again if its oldest file is replaced meanwhile."""
    for left in reversed(range(TRIES)):
        try:
            numbers = spark.read.schema("version bigint").parquet(f"{path}-published")
            return numbers.agg(F.max("version")).first()[0]
        except PySparkException:
            if not left:
                raise
            time.sleep(PAUSE_SECONDS)
    raise AssertionError


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path, _published(spark, path))

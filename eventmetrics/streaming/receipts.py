"""Receipts of micro-batches: what Spark observed while it wrote them.

Accepted and refused rows are counted by the job that writes them, on the
streaming frame itself, and reach a listener with the progress of each
micro-batch; no other job runs and no written row is read again.
"""

from __future__ import annotations

import json
from threading import Event

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

RECEIPT = "ingest_receipt"
OBSERVED = "query_id string, batch bigint, accepted bigint, rejected bigint, first_us bigint, last_us bigint"
ACCEPTED, REJECTED = "accepted", "rejected"


def receipted(checked: DataFrame, name: str = RECEIPT) -> DataFrame:
    """``checked`` rows (``timestamp``, ``reason``), counted per micro-batch under ``name``; bounds are of accepted ones."""
    kept = F.col("reason").isNull()
    return checked.observe(
        name,
        F.count_if(kept).alias("accepted"),
        F.count_if(~kept).alias("rejected"),
        F.unix_micros(F.min(F.when(kept, F.col("timestamp")))).alias("first_us"),
        F.unix_micros(F.max(F.when(kept, F.col("timestamp")))).alias("last_us"),
    )


class ReceiptListener(StreamingQueryListener):
    """Writes one small file for each micro-batch that had rows, named by its query and number.

    A micro-batch that is run again writes the same name, so it has one receipt.
    Files are written by the driver through Spark's file system, to any folder
    the cluster can reach. Progress is reported after a batch is committed, so a
    driver lost between the two leaves out that receipt; ``store.ingest_receipts``
    counts the written rows anew.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = RECEIPT) -> None:
        self._spark, self._path, self._name = spark, path, name
        self._ended: dict[str, Event] = {}

    def _end(self, run: str) -> Event:
        return self._ended.setdefault(run, Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(self._name)
        if found is None or not found.accepted + found.rejected:
            return
        line = {"query_id": str(progress.id), "batch": progress.batchId, **found.asDict()}
        self._put(f"{self._path}/{progress.id}-{progress.batchId}.json", json.dumps(line) + "\n")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def _put(self, name: str, text: str) -> None:
        jvm, context = self._spark._jvm, self._spark.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(name)
        stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> bool:
        """Have all receipts of an ended query arrived? Reports come a moment after its end."""
        return self._end(str(query.runId)).wait(seconds)


def start_receipted(
    checked: DataFrame, path: str, checkpoint: str, receipts: str, name: str = RECEIPT, **trigger
) -> tuple[StreamingQuery, ReceiptListener]:
    """Append checked rows to ``path/verdict=accepted`` and ``path/verdict=rejected``, with receipts.

    The file sink names the files of each committed micro-batch in its log, and
    readers of ``path`` go by it: rows of a batch that was cut off and run again
    are read once.
    """
    spark = checked.sparkSession
    listener = ReceiptListener(spark, receipts, name)
    spark.streams.addListener(listener)
    verdict = F.when(F.col("reason").isNull(), ACCEPTED).otherwise(REJECTED)
    query = (
        receipted(checked, name)
        .withColumn("verdict", verdict)
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("verdict")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
    return query, listener


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """All receipts so far: query_id, batch, accepted, rejected, and first and last accepted timestamp."""
    return spark.read.schema(OBSERVED).json(path).select(
        "query_id",
        "batch",
        "accepted",
        "rejected",
        F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("last_us").alias("last_ts"),
    )

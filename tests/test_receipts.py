"""Receipts of micro-batches, against the rows that were written."""

from helpers import AS_OF, ago

from pyspark.sql import functions as F

from eventmetrics.session import stream_session
from eventmetrics.sources import store
from eventmetrics.streaming import receipts as rc

LAYOUT = "id long, timestamp timestamp, reason string"


def run(spark, path):
    session = stream_session(spark)
    stream = session.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query, listener = rc.start_receipted(
        stream, f"{path}/out", f"{path}/checkpoint", f"{path}/receipts", availableNow=True
    )
    query.awaitTermination()
    assert listener.wait(query)
    session.streams.removeListener(listener)
    return query


def put(spark, path, rows):
    spark.createDataFrame(rows, LAYOUT).coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_one_receipt_for_each_micro_batch(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, [(1, AS_OF, None), (2, ago(hours=1), None), (3, ago(hours=9), "bad")])
    put(spark, path, [(4, AS_OF, "bad"), (5, AS_OF, "worse")])
    first = run(spark, path)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(str(first.runId))
    # A resumed stream goes on counting; what was committed is not read again.
    put(spark, path, [(6, ago(days=1), None)])
    second = run(spark, path)
    assert first.id == second.id
    got = {r.batch: r for r in rc.read_receipts(spark, f"{path}/receipts").collect()}
    assert {b: (r.accepted, r.rejected) for b, r in got.items()} == {0: (2, 1), 1: (0, 2), 2: (1, 0)}
    assert got[0].last_ts - got[0].first_ts == AS_OF - ago(hours=1)
    assert got[1].first_ts is None and got[1].last_ts is None
    # One job writes a batch; receipts need none.
    assert len(jobs) <= 2
    written = spark.read.parquet(f"{path}/out")
    assert sorted(r.id for r in written.collect()) == [1, 2, 3, 4, 5, 6]
    by_id = F.expr("CASE WHEN id < 4 THEN 0 WHEN id < 6 THEN 1 ELSE 2 END")
    plain = store.ingest_receipts(written.withColumn("batch", by_id), "batch").collect()
    assert {r.batch: (r.accepted, r.rejected) for r in plain} == {b: (r.accepted, r.rejected) for b, r in got.items()}

"""Bucketed metrics from keyed state: a batch reads its own events and nothing older.

Session metrics and distinct visitors are not sums, but their changes are. The
state holds, per tenant, bucket and session or visitor, how many events it has
and when the first and last were; new rows change a session's count, its being
a bounce and its duration by whole numbers. These changes are summed per tenant
and bucket and written, one folder per batch. Metrics are sums over folders,
whatever the order and cut of the input.

Events are added up per key inside each task before they are dealt out to the
state, so a session, visitor or missing id with a third of all events arrives
as a few rows. Keys of one tenant and bucket lie in many tasks.

What is held is kept in slots of keys. A slot of one period (the day of a bucket,
or the bucket itself if that is wider) is one value in the state, an Arrow table
of its sessions and visitors; a batch reads and writes the slots of the periods
that its events fall in, with a few calls for each slot and not for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from eventmetrics.functions.dates import bucket, mean_seconds
from eventmetrics.functions.numbers import percent
from eventmetrics.functions.payload import is_error, is_page_view, with_identity

KEYS = ["organization_id", "bucket"]
SESSION, VISITOR = "s", "v"
PART = "organization_id string, bucket timestamp, kind string, id string"
SUMS = ["events", "page_views", "errors"]
PARTIAL = f"{PART}, events long, page_views long, errors long, first_us long, last_us long"
CHANGES = ["events", "page_views", "errors", "visitors", "sessions", "bounced", "micros"]
CHANGE = "organization_id string, bucket timestamp, " + ", ".join(f"{c} long" for c in CHANGES)
# Slots of one period. Their number is part of a checkpoint; more slots make them smaller.
SLOTS = {"minute": 64, "hour": 64, "day": 64, "week": 256, "month": 1024}
ENTRY = ["organization_id", "bucket_us", "kind", "id"]
SEEN = [*SUMS, "first_us", "last_us"]
HELD = pa.schema(
    [
        *[(c, pa.int64() if c == "bucket_us" else pa.string()) for c in ENTRY],
        *[(c, pa.int64()) for c in ("held", "held_first", "held_last", "seen_ms")],
    ]
)
NEW = pa.schema([*[HELD.field(c) for c in ENTRY], *[(c, pa.int64()) for c in SEEN]])


def keyed_events(events: DataFrame, interval: str) -> DataFrame:
    """Two rows per event, for its session and its visitor; views and errors are counted with the visitor.

    An event without a session has one row. One without a visitor has a row
    without an id, which counts for views and errors only.
    """
    us = F.unix_micros("timestamp")
    zero = F.lit(0).cast("bigint")

    def row(kind: str, key: str, views: Column, errors: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.col(key).alias("id"),
            F.lit(1).cast("bigint").alias("events"),
            views.cast("bigint").alias("page_views"),
            errors.cast("bigint").alias("errors"),
        )

    seen = row(VISITOR, "visitor_id", F.when(is_page_view(), 1).otherwise(0), F.when(is_error(), 1).otherwise(0))
    session = F.when(F.col("session_id").isNotNull(), row(SESSION, "session_id", zero, zero))
    return (
        with_identity(events)
        .select("organization_id", bucket(interval).alias("bucket"), us.alias("us"), F.inline(F.array_compact(F.array(seen, session))))
        .select("organization_id", "bucket", "kind", "id", *SUMS, F.col("us").alias("first_us"), F.col("us").alias("last_us"))
    )


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys as one, batch by batch."""
    keys = ["organization_id", "bucket", "kind", "id"]
    how = [*[(c, "sum") for c in SUMS], ("first_us", "min"), ("last_us", "max")]
    for batch in batches:
        if batch.num_rows:
            summed = pa.Table.from_batches([batch]).group_by(keys).aggregate(how)
            names = [*keys, *[f"{c}_{f}" for c, f in how]]
            yield from summed.select(names).rename_columns(batch.schema.names).cast(batch.schema).to_batches()


def _filled(column: pa.ChunkedArray, value: int = 0) -> np.ndarray:
    return column.fill_null(value).to_numpy()


class Changes(StatefulProcessor):
    """The changes that new rows of the sessions and visitors of one slot make to their buckets."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "entries binary", self.ttl_ms)

    def _before(self, now: int) -> pa.Table:
        if not self.held.exists():
            return HELD.empty_table()
        before = pa.ipc.open_stream(pa.py_buffer(bytes(self.held.get()[0]))).read_all()
        return before.filter(pa.array(_filled(before["seen_ms"]) > now - self.ttl_ms)) if self.ttl_ms else before

    def _keep(self, entries: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(entries)
        self.held.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        new = pa.concat_tables([pa.Table.from_pandas(part[NEW.names], NEW, preserve_index=False) for part in rows])
        both = pa.concat_tables([self._before(now), new], promote_options="default")
        how = {"held": "sum", "held_first": "min", "held_last": "max", "seen_ms": "max"}
        how |= dict.fromkeys(SUMS, "sum") | {"first_us": "min", "last_us": "max"}
        both = both.group_by(ENTRY, use_threads=False).aggregate(list(how.items()))
        both = both.rename_columns([*ENTRY, *how])
        touched = both["events"].is_valid().to_numpy()
        known = both["held"].is_valid().to_numpy()
        is_visitor = both["kind"].to_numpy() == VISITOR
        named = both["id"].is_valid().to_numpy()
        events, views, errors, before = (_filled(both[c]) for c in (*SUMS, "held"))
        old_first, old_last = _filled(both["held_first"]), _filled(both["held_last"])
        most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        # Rows without a time have no span.
        first = np.minimum(_filled(both["first_us"], most), _filled(both["held_first"], most))
        last = np.maximum(_filled(both["last_us"], least), _filled(both["held_last"], least))
        first, last = np.where(first == most, 0, first), np.where(last == least, 0, last)
        after = before + events
        session = touched & ~is_visitor
        change = {
            "events": np.where(is_visitor, events, 0),
            "page_views": np.where(is_visitor, views, 0),
            "errors": np.where(is_visitor, errors, 0),
            "visitors": is_visitor & named & touched & ~known,
            "sessions": session & ~known,
            "bounced": (session & (after == 1)).astype(np.int64) - (session & known & (before == 1)),
            "micros": np.where(session, (last - first) - np.where(known, old_last - old_first, 0), 0),
        }
        entries = [*[both[c] for c in ENTRY], *[pa.array(c) for c in (after, first, last)]]
        entries.append(pa.array(np.where(touched, now, _filled(both["seen_ms"]))))
        self._keep(pa.Table.from_arrays(entries, schema=HELD).filter(pa.array(named)))
        by = pa.table({c: both[c] for c in ENTRY[:2]} | {c: pa.array(v.astype(np.int64)) for c, v in change.items()})
        by = by.filter(pa.array(touched)).group_by(ENTRY[:2], use_threads=False).aggregate([(c, "sum") for c in CHANGES])
        yield by.rename_columns([*ENTRY[:2], *CHANGES]).to_pandas(integer_object_nulls=True)

    def close(self) -> None:
        pass


def bucket_changes(events: DataFrame, interval: str, ttl_ms: int | None = None, slots: int | None = None) -> DataFrame:
    """Stream of changes to buckets, from a stream of events.

    State is kept for good, so any late row is exact. With ``ttl_ms`` a session
    or visitor is forgotten that long after its last row came, and counts anew
    if it comes again. ``slots``: parts of one period's state, ``SLOTS`` by default.
    """
    period = F.col("bucket") if interval in ("week", "month") else F.date_trunc("day", "bucket")
    slot = F.pmod(F.xxhash64("organization_id", "bucket", "kind", "id"), F.lit(slots or SLOTS.get(interval, 64))).cast("int")
    dealt = keyed_events(events, interval).mapInArrow(_added_up, PARTIAL)
    return (
        dealt.select(
            F.unix_micros(period).alias("period_us"), slot.alias("slot"),
            "organization_id", F.unix_micros("bucket").alias("bucket_us"), "kind", "id", *SEEN,
        )
        .groupBy("period_us", "slot")
        .transformWithStateInPandas(
            Changes(ttl_ms),
            outputStructType=CHANGE.replace("bucket timestamp", "bucket_us long"),
            outputMode="Update",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
        .select("organization_id", F.timestamp_micros("bucket_us").alias("bucket"), *CHANGES)
    )


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in CHANGES])


def metrics_of(totals: DataFrame) -> DataFrame:
    """All metrics per tenant and bucket, from summed changes."""
    return totals.select(
        *KEYS,
        "page_views",
        F.col("visitors").alias("unique_visitors"),
        percent(F.col("bounced"), F.col("sessions")).alias("bounce_rate"),
        F.coalesce(mean_seconds(F.col("micros"), F.col("sessions")), F.lit(0.0)).alias("avg_session_duration"),
        F.col("errors").alias("error_count"),
        percent(F.col("errors"), F.col("events")).alias("error_rate"),
    )


def start_bucket_changes(
    events: DataFrame,
    interval: str,
    path: str,
    checkpoint: str,
    ttl_ms: int | None = None,
    slots: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Write each batch's changes below ``path``; ``read_bucket_metrics`` sums them.

    A folder bears its batch's number and is replaced if the batch is run
    again, from the same version of the state.
    """

    def run(batch: DataFrame, version: int) -> None:
        summed(batch).write.mode("overwrite").parquet(f"{path}/changes/batch={version}")

    return (
        bucket_changes(events, interval, ttl_ms, slots)
        .writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def _read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CHANGE}, batch long").parquet(f"{path}/changes")


def read_bucket_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of every tenant and bucket that has events."""
    return metrics_of(summed(_read_changes(spark, path)))


def compact_bucket_changes(spark: SparkSession, path: str, target: str) -> None:
    """All changes summed to one folder (batch -1) below ``target``, for a query that goes on there."""
    summed(_read_changes(spark, path)).write.mode("overwrite").parquet(f"{target}/changes/batch=-1")

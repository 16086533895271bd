"""The live feed of events and alerts: frames, search, tail, counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from eventmetrics.functions.dates import iso_text
from eventmetrics.operators.alerts import alert_frames
from eventmetrics.operators.scope import page_per_org
from eventmetrics.streaming.snapshots import write_snapshot

# Frames kept by a tail, row types of the feed, titles.
TAIL_FRAMES = 200
FEED_TYPES = ("event", "alert", "system")
EVENT_TITLE = "Event Ingested: "

COLUMNS = [
    "organization_id",
    "timestamp",
    "id",
    "type",
    "event_name",
    "rule_name",
    "state",
    "title",
    "frame",
]


def event_feed(events: DataFrame) -> DataFrame:
    """Feed rows of accepted events, batch or stream; ``frame`` is ``{type, data}`` as JSON.

    Only events of the JSON API are announced; do not pass CSV or webhook events.
    """
    data = F.struct(
        "id",
        "organization_id",
        "data_source_id",
        "event_name",
        iso_text(F.col("timestamp")).alias("timestamp"),
        F.try_parse_json("payload").alias("payload"),
    )
    text = F.lit(None).cast("string")
    return events.select(
        "organization_id",
        "timestamp",
        "id",
        F.lit("event").alias("type"),
        "event_name",
        text.alias("rule_name"),
        text.alias("state"),
        F.concat(F.lit(EVENT_TITLE), "event_name").alias("title"),
        F.to_json(F.struct(F.lit("event").alias("type"), data.alias("data"))).alias("frame"),
    )


def alert_feed(history: DataFrame, rules: DataFrame) -> DataFrame:
    """Feed rows of alert transitions."""
    frames = alert_frames(history, rules)
    data = F.from_json(
        "frame", "data struct<rule_id string, rule_name string, state string>"
    ).getField("data")
    return frames.withColumn("_data", data).select(
        "organization_id",
        "timestamp",
        F.col("_data.rule_id").alias("id"),
        F.lit("alert").alias("type"),
        F.lit(None).cast("string").alias("event_name"),
        F.col("_data.rule_name").alias("rule_name"),
        F.col("_data.state").alias("state"),
        F.concat(F.lit("["), F.upper("_data.state"), F.lit("] "), "_data.rule_name").alias("title"),
        "frame",
    )


def feed(events: DataFrame, alerts: DataFrame, org: str | None = None) -> DataFrame:
    """Both kinds under one layout, of all tenants or one."""
    both = event_feed(events).unionByName(alerts, allowMissingColumns=True).select(*COLUMNS)
    return both if org is None else both.filter(F.col("organization_id") == org)


def search(rows: DataFrame, kind: str = "all", query: str = "") -> DataFrame:
    """Rows of one type whose name, state or title contains ``query`` in any letter case."""
    if kind != "all":
        if kind not in FEED_TYPES:
            raise ValueError(f"feed type must be all or one of {', '.join(FEED_TYPES)}: {kind!r}")
        rows = rows.filter(F.col("type") == kind)
    if not query.strip():
        return rows
    wanted = F.lower(F.lit(query))

    def hit(column: str) -> Column:
        return F.coalesce(F.contains(F.lower(F.col(column)), wanted), F.lit(False))

    return rows.filter(hit("event_name") | hit("rule_name") | hit("state") | hit("title"))


def live_tail(rows: DataFrame, frames: int = TAIL_FRAMES) -> DataFrame:
    """The newest ``frames`` rows of each tenant."""
    return page_per_org(rows, F.desc("timestamp"), F.desc("id"), limit=frames).drop("ord")


def running_counts(rows: DataFrame) -> DataFrame:
    """Rows per tenant and type since the start; as a stream use complete or update mode."""
    return rows.groupBy("organization_id", "type").agg(F.count(F.lit(1)).alias("rows"))


class Tail(StatefulProcessor):
    """The newest frames of one tenant."""

    def __init__(self, frames: int, columns: list[str]) -> None:
        self.frames, self.columns = frames, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.us, *[r[c] for c in FRAME]) for r in rows]
        held = list(self.held.get())
        newest = sorted([*held, *new], key=lambda r: (r[0], r[1] or ""), reverse=True)[: self.frames]
        if newest != held:
            self.held.put(newest)
            for row in newest:
                yield Row(organization_id=key[0], us=row[0], **dict(zip(FRAME, row[1:], strict=True)))

    def close(self) -> None:
        pass


FRAME = COLUMNS[2:]
ROW = "us long, " + ", ".join(f"{c} string" for c in FRAME)


def _newest(frames: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All but the newest frames of each tenant left out, batch by batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = pc.sort_indices(batch, [("us", "descending"), ("id", "descending")])
                org = batch.column(0).take(order).to_pandas()
                nth = org.groupby(org, dropna=False, sort=False).cumcount().to_numpy()
                yield batch.take(order.filter(pa.array(nth < frames)))

    return cut


def tails(rows: DataFrame, frames: int = TAIL_FRAMES) -> DataFrame:
    """Stream of the whole tail of each tenant that got a newer frame."""
    plain = rows.select("organization_id", F.unix_micros("timestamp").alias("us"), *FRAME)
    layout = f"organization_id string, {ROW}"
    return (
        plain.mapInArrow(_newest(frames), layout)
        .groupBy("organization_id")
        .transformWithState(Tail(frames, FRAME), outputStructType=layout, outputMode="Update", timeMode="None")
    )


def start_live_tail(
    rows: DataFrame, path: str, checkpoint: str, frames: int = TAIL_FRAMES, **trigger
) -> StreamingQuery:
    """Keep each tenant's tail in state; a batch writes the tails it changed (``read_tail``).

    A batch is cut to its own tail in each task before it meets the state, so a
    tenant with a third of all events sends a few frames, and tenants without
    news cost nothing.
    """

    def store(batch: DataFrame, version: int) -> None:
        rows = batch.withColumn("timestamp", F.timestamp_micros("us")).drop("us")
        rows.write.mode("overwrite").parquet(f"{path}/batch={version}")

    return (
        tails(rows, frames)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def read_tail(spark: SparkSession, path: str) -> DataFrame:
    """Each tenant's tail as the last batch that changed it left it."""
    written = spark.read.parquet(path)
    last = written.groupBy(F.col("organization_id").alias("_org")).agg(F.max("batch").alias("_batch"))
    same = F.col("organization_id").eqNullSafe(F.col("_org")) & (F.col("batch") == F.col("_batch"))
    return written.join(last, same).select(*COLUMNS)


def start_running_counts(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the counters in a snapshot below ``path``."""

    def store(batch: DataFrame, version: int) -> None:
        write_snapshot(batch, path, version)

    return (
        running_counts(rows)
        .writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )

"""The event store: Parquet split by month, and what is known about it."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from eventmetrics.functions.dates import moment, month_of, partition_name, utc
from eventmetrics.functions.payload import with_identity
from eventmetrics.operators.scope import page
from eventmetrics.streaming.snapshots import read_latest, write_snapshot

AHEAD_MONTHS = 3


def stored_form(events: DataFrame) -> DataFrame:
    """Add the month and the identity columns that are stored next to the payload."""
    return with_identity(events).withColumn("event_month", month_of(F.col("timestamp")))


# Folder of the rows that came in no numbered batch.
LOADED = -1


def _batch_path(path: str, batch: int) -> str:
    return f"{path}/ingest_batch={batch}"


def write_events(events: DataFrame, path: str, batch: int | None = None) -> None:
    """Write events below ``path``, one folder per batch and in it one per month.

    ``rebalance`` gathers a month's rows into files of the advisory size: small
    months share a task, and the current month, which has nearly all rows of a
    load, is split over many. Sorting by tenant and time makes the Parquet
    statistics skip row groups for tenant and time filters.

    A numbered batch has its folder to itself, and writing it again replaces
    the folder as a whole, whichever months it had before. Rows without a
    number are appended.
    """
    rows = (
        stored_form(events)
        .hint("rebalance", "event_month")
        .sortWithinPartitions("event_month", "organization_id", "timestamp")
    )
    mode = "append" if batch is None else "overwrite"
    target = _batch_path(path, LOADED if batch is None else batch)
    rows.write.partitionBy("event_month").mode(mode).parquet(target)


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}-compacted"


def _compacted(spark: SparkSession, path: str) -> list[Row]:
    """(event_month, upto, generation) of the months that were compacted, as last published: a row a month."""
    try:
        return read_latest(spark, _manifest(path)).collect()
    except AnalysisException:
        return []


def _generation_batch(generation: int) -> int:
    """Generations lie among the batches under numbers below that of loaded rows."""
    return LOADED - 1 - generation


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stored events, each once.

    Of a compacted month these are its newest generation, rows that were
    loaded without a number, and batches that came since. What the filter
    leaves out is told by folder names, so it is not read.
    """
    stored = spark.read.parquet(path)
    if "ingest_batch" not in stored.columns:
        return stored
    batch, month = F.col("ingest_batch"), F.col("event_month")
    by_state: dict[tuple[int, int], list] = {}
    for row in _compacted(spark, path):
        by_state.setdefault((row.upto, row.generation), []).append(row.event_month)
    others, kept = batch >= LOADED, F.lit(False)
    for (upto, generation), months in by_state.items():
        inside = month.isin(months)
        others = others & ~inside
        kept = kept | (inside & ((batch == _generation_batch(generation)) | (batch == LOADED) | (batch > upto)))
    return stored.filter(others | kept).drop("ingest_batch")


def compact_closed_months(spark: SparkSession, path: str, as_of: datetime, least_batches: int = 8) -> list[date]:
    """Rewrite months before ``as_of``'s that lie in many batches as one folder each; returns these months.

    Only such months are read and written, and none twice unless ``least_batches``
    newer batches have brought late rows. The new folders count from the moment
    the list of compacted months is published; until then, and if the work is
    cut short, readers and a second try see the store as it was. Superseded
    folders may be deleted once no reader that began before is left.
    """
    state = {row.event_month: row for row in _compacted(spark, path)}
    closed = moment(as_of).cast("date")
    parts = (
        spark.read.parquet(path)
        .select("ingest_batch", "event_month")
        .filter((F.col("ingest_batch") > LOADED) & (F.col("event_month") < month_of(closed)))
        .distinct()
        .collect()
    )
    newer: dict[date, list[int]] = {}
    for row in parts:
        if row.event_month not in state or row.ingest_batch > state[row.event_month].upto:
            newer.setdefault(row.event_month, []).append(row.ingest_batch)
    chosen = {month: max(batches) for month, batches in newer.items() if len(batches) >= least_batches}
    if not chosen:
        return []
    generation = max([row.generation for row in state.values()], default=-1) + 1
    # Rows that a load without a number adds meanwhile stay where they are.
    rows = spark.read.parquet(path)
    batch, month = F.col("ingest_batch"), F.col("event_month")
    wanted = F.lit(False)
    for m, upto in chosen.items():
        numbered = (batch > (state[m].upto if m in state else LOADED)) & (batch <= upto)
        if m in state:
            numbered = numbered | (batch == _generation_batch(state[m].generation))
        wanted = wanted | ((month == F.lit(m)) & numbered)
    order = ["event_month", "organization_id", "timestamp"]
    gathered = rows.filter(wanted).drop("ingest_batch").repartitionByRange(*order).sortWithinPartitions(*order)
    gathered.write.partitionBy("event_month").mode("overwrite").parquet(_batch_path(path, _generation_batch(generation)))
    after = {m: (m, row.upto, row.generation) for m, row in state.items()}
    after |= {m: (m, upto, generation) for m, upto in chosen.items()}
    write_snapshot(
        spark.createDataFrame(list(after.values()), "event_month date, upto long, generation long"),
        _manifest(path),
        generation,
    )
    return sorted(chosen)


def compact_events(spark: SparkSession, path: str, target: str) -> None:
    """Rewrite a store of many batches as one folder per month below ``target``.

    Rows are dealt out by month, tenant and time, so each file holds a narrow
    range of them. The old store is left as it is: readers change over when the
    new one is complete.
    """
    order = ["event_month", "organization_id", "timestamp"]
    rows = read_events(spark, path).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.partitionBy("event_month").mode("overwrite").parquet(_batch_path(target, LOADED))


def expected_partitions(
    spark: SparkSession, as_of: datetime, events: DataFrame | None = None, ahead: int = AHEAD_MONTHS
) -> DataFrame:
    """The current month and the next ``ahead`` ones, ``[range_from, range_to)``, with row counts."""
    first = F.trunc(moment(as_of), "MM")
    months = spark.range(1).select(
        F.explode(
            F.sequence(first, F.add_months(first, ahead), F.expr("interval 1 month"))
        ).alias("range_from")
    )
    calendar = months.select(
        partition_name(F.col("range_from")).alias("partition_name"),
        "range_from",
        F.add_months("range_from", 1).alias("range_to"),
    )
    if events is None:
        return calendar.withColumn("row_count", F.lit(0).cast("bigint"))
    counts = partition_counts(events).withColumnRenamed("event_month", "range_from")
    return calendar.join(counts, "range_from", "left").fillna(0, subset=["row_count"])


def split_by_calendar(events: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events inside the provisioned months, and those no partition takes."""
    months = calendar.select(F.col("range_from").alias("_month"))
    inside = month_of(F.col("timestamp")) == F.col("_month")
    accepted = events.join(months, inside, "left_semi")
    rejected = events.join(months, inside, "left_anti")
    return accepted, rejected.withColumn("reason", F.lit("no_partition"))


def partition_counts(events: DataFrame) -> DataFrame:
    """Rows per month."""
    if "event_month" not in events.columns:
        events = events.withColumn("event_month", month_of(F.col("timestamp")))
    return events.groupBy("event_month").agg(F.count(F.lit(1)).alias("row_count"))


def observed(events: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """Count rows and time bounds while the events are written, without another pass."""
    receipt = Observation(name)
    return (
        events.observe(
            receipt,
            F.count(F.lit(1)).alias("processed_records"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        ),
        receipt,
    )


def ingest_receipts(checked: DataFrame, batch: str) -> DataFrame:
    """Accepted and refused rows per batch, by their ``reason``."""
    refused = F.col("reason").isNotNull()
    return checked.groupBy(batch).agg(
        F.count_if(~refused).alias("accepted"), F.count_if(refused).alias("rejected")
    )


def tenant_months(events: DataFrame) -> DataFrame:
    """Rows per tenant and month: what ``events_page`` goes by. Small, and kept next to the store."""
    if "event_month" not in events.columns:
        events = events.withColumn("event_month", month_of(F.col("timestamp")))
    return events.groupBy("organization_id", "event_month").agg(F.count(F.lit(1)).alias("row_count"))


Cursor = tuple[datetime, str]


def events_page(
    events: DataFrame, counts: DataFrame, org: str, after: Cursor | None = None, limit: int = 100
) -> DataFrame:
    """One tenant's events behind a cursor (timestamp, id), newest first; the first page without one.

    ``counts`` (``tenant_months``) says which months hold the page: from the
    cursor's month back until the months below it have ``limit`` rows. Only
    these folders are read, and how deep a page lies does not matter. A row
    that is missing from the counts is not found, so count after each load.
    """
    months = counts.filter(F.col("organization_id") == org)
    if after is not None:
        months = months.filter(F.col("event_month") <= month_of(moment(after[0])))
    # One row per month of one tenant.
    listed = sorted(((r.event_month, r.row_count) for r in months.collect()), reverse=True)
    needed, found = [], 0
    for month, n in listed:
        needed.append(month)
        # The cursor's own month may have nothing left.
        own = after is not None and month == utc(after[0]).date().replace(day=1)
        found += 0 if own else n
        if found >= limit:
            break
    rows = events.filter(F.col("organization_id") == org)
    if not needed:
        return rows.filter("false")
    in_months = F.col("event_month") if "event_month" in events.columns else month_of(F.col("timestamp"))
    rows = rows.filter(in_months.between(F.lit(min(needed)), F.lit(max(needed))))
    if after is not None:
        at, last = moment(after[0]), F.lit(after[1])
        ts = F.col("timestamp")
        rows = rows.filter((ts <= at) & ((ts < at) | (F.col("id") > last)))
    return rows.orderBy(F.desc("timestamp"), F.asc("id")).limit(limit)


def cursor_of(page_rows: DataFrame) -> Cursor | None:
    """The cursor behind the last row of a page; None after the last page."""
    last = page_rows.orderBy(F.asc("timestamp"), F.desc("id")).select(F.unix_micros("timestamp"), "id").first()
    if last is None:
        return None
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=last[0]), last[1]


def list_events(events: DataFrame, org: str, limit: int = 100, skip: int = 0) -> DataFrame:
    """One tenant's events, newest first; ties by id so that pages do not overlap."""
    rows = events.filter(F.col("organization_id") == org)
    return page(rows, F.desc("timestamp"), F.asc("id"), skip=skip, limit=limit)

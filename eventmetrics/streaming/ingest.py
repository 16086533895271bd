"""From raw requests to stored events, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from eventmetrics import schema
from eventmetrics.operators import access as ac
from eventmetrics.sources import events as src
from eventmetrics.sources.store import split_by_calendar, write_events
from eventmetrics.streaming.limits import OVER, SLOTS, limited

Loader = Callable[[SparkSession], DataFrame]

# A body is one event or a list of events.
FIELDS = ("event_name", "timestamp", "payload", "data_source_id")
EVENT_FIELDS = [column.split()[0] for column in schema.EVENTS.split(", ")]
ONE = "struct<" + ", ".join(f"{name}: string" for name in FIELDS) + ">"
BODY = f"array<{ONE}>"


def parsed_body(body: Column) -> Column:
    """The events of a request body; NULL when it is no JSON or has no event.

    ``from_json`` ignores what follows the first value. Put into a list, the
    body must be its only element, and put into an object, its only field: no
    text behind the value satisfies both.
    """
    text = F.regexp_replace(body, r"^\s+|\s+$", "")
    listed = F.concat(F.lit("["), text, F.lit("]"))
    boxed = F.concat(F.lit('{"body":'), text, F.lit("}"))

    def alone(kind: str) -> Column:
        found = F.from_json(listed, f"array<{kind}>")
        in_box = F.from_json(boxed, f"struct<body: {kind}>").getField("body")
        return F.when((F.size(found) == 1) & in_box.isNotNull(), found[0])

    events = F.when(text.startswith("{"), F.array_compact(F.array(alone(ONE)))).when(
        text.startswith("["), alone(BODY)
    )
    return F.when(F.size(events) > 0, events)


def _named_source(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests with ``_foreign``: do their events name a source that their tenant may not use?

    Requests whose events all name one source, or none, are joined to it. Only
    the others are unrolled, so no tenant's sources are gathered anywhere.
    """
    named = F.array_distinct(F.filter(F.transform("_events", lambda e: e.getField("data_source_id")), lambda i: i.isNotNull()))
    usable = (
        ac.usable_sources(sources)
        .select("organization_id", F.col("id").alias("_source"), F.lit(True).alias("_usable"))
        .distinct()
    )
    asked = found.withColumn("_named", F.coalesce(named, F.array().cast("array<string>")))
    few = asked.filter(F.size("_named") < 2).withColumn("_source", F.try_element_at("_named", F.lit(1)))
    single = few.join(usable, ["organization_id", "_source"], "left").withColumn(
        "_foreign", F.col("_source").isNotNull() & F.col("_usable").isNull()
    )
    several = asked.filter(F.size("_named") >= 2)
    missing = (
        several.select("request_id", "organization_id", F.explode("_named").alias("_source"))
        .join(usable, ["organization_id", "_source"], "left_anti")
        .select("request_id", F.lit(True).alias("_missing"))
        .distinct()
    )
    many = several.join(missing, "request_id", "left").withColumn("_foreign", F.col("_missing").isNotNull())
    columns = [*found.columns, "_foreign"]
    return single.select(*columns).unionByName(many.select(*columns))


def process(
    batch: DataFrame,
    api_keys: DataFrame,
    sources: DataFrame,
    limit: int = ac.REQUESTS_PER_MINUTE,
) -> DataFrame:
    """Run all checks on raw requests (``request_id``, ``api_key``, ``received_at``, ``body``).

    Returns one row per event of accepted requests, in the event model, and
    one row per refused request; both carry ``request_id`` and ``reason``,
    refused ones also ``body``. Where the requests carry ``over_limit``
    (``limits.limited``) that decides on the limit, else it is looked up among
    these requests.

    One bad event or source refuses its whole request. That is decided on the
    request's list of events before it is unrolled, so it needs no grouping.
    """
    keyed = ac.key_verdicts(batch, api_keys, F.col("received_at"))
    if OVER in batch.columns:
        refused = F.when(F.col(OVER), F.lit("rate_limited"))
        admitted = keyed.withColumn("reason", F.coalesce("reason", refused)).drop(OVER)
    else:
        admitted = ac.admission_verdicts(keyed, limit)
    opened = admitted.withColumn("_events", F.when(F.col("reason").isNull(), parsed_body(F.col("body"))))
    reasons = F.array_compact(F.transform("_events", lambda e: src.event_reason(e.getField)))
    judged = opened.withColumn(
        "reason",
        F.coalesce(
            "reason", F.when(F.col("_events").isNull(), F.lit("not_json")), F.try_element_at(reasons, F.lit(1))
        ),
    )
    checked = _named_source(judged, sources).withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_foreign"), F.lit("source_not_usable")))
    )
    unrolled = checked.select(
        "*", F.posexplode_outer(F.when(F.col("reason").isNull(), F.col("_events"))).alias("_nth", "_event")
    )
    columns = src.event_columns(
        F.col("_event").getField,
        F.col("organization_id"),
        F.col("received_at"),
        src.hashed_id(F.col("request_id"), F.col("_nth")),
    )
    return unrolled.select(
        *columns,
        "request_id",
        F.when(F.col("reason").isNotNull(), F.col("body")).alias("body"),
        "reason",
    )


def start_ingest(
    raw: DataFrame,
    load_keys: Loader,
    load_sources: Loader,
    path: str,
    checkpoint: str,
    limit: int = ac.REQUESTS_PER_MINUTE,
    load_calendar: Loader | None = None,
    slots: int = SLOTS,
    **trigger,
) -> StreamingQuery:
    """Append accepted events to ``path/events`` and refused ones to ``path/rejected``.

    Limits are counted in state (``limits``, with ``slots`` parts), so the session needs a state
    store that keeps them, as ``session.stream_session`` has. Keys and sources
    are loaded for each micro-batch, so changes take effect. Outcomes are
    written to a staging folder first, so that the checks run once for all
    outputs; ids are hashes of the request and the event's place in it. Every
    output is keyed by the batch number and replaced if a batch is run again.
    With ``load_calendar`` events outside its months are refused.
    """

    def run(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        staging = f"{path}/staging/slot={version % 2}"
        process(batch, load_keys(spark), load_sources(spark)).write.mode("overwrite").parquet(staging)
        outcome = spark.read.parquet(staging)
        accepted = outcome.filter(F.col("reason").isNull())
        refused = outcome.filter(F.col("reason").isNotNull()).select("request_id", "body", "reason")
        if load_calendar is not None:
            accepted, outside = split_by_calendar(accepted, load_calendar(spark))
            refused = refused.unionByName(outside.select("request_id", F.col("payload").alias("body"), "reason"))
        write_events(accepted.select(*EVENT_FIELDS), f"{path}/events", batch=version)
        refused.write.mode("overwrite").parquet(f"{path}/rejected/batch={version}")

    return (
        limited(raw, limit, slots=slots)
        .writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )

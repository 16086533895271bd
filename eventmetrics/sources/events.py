"""Event sources: JSON, CSV and webhook bodies become rows of the event model.

Checks add a ``reason`` column, NULL for good rows, and ``split`` turns that
into ``(accepted, rejected)``. New ids come from ``uuid()``, which gives other
values when a lost task is run again, so write the events once and read them
back.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventmetrics import schema
from eventmetrics.functions.dates import moment, parse_iso
from eventmetrics.functions.payload import last_value, properties
from eventmetrics.operators.scope import active
from eventmetrics.sources.csv_records import read_records

# Column names and defaults of the input formats.
MAX_NAME_LENGTH = 255
CSV_NAME_COLUMNS = ("event_name", "event")
CSV_TIME_COLUMNS = ("timestamp", "time")
WEBHOOK_NAME_PATH = "event"
WEBHOOK_TIME_PATH = "timestamp"
WEBHOOK_DEFAULT_NAME = "webhook_event"

UUID_PATTERN = r"(?i)^[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}$"


def _first_reason(*checks: tuple[Column, str]) -> Column:
    """The label of the first failed check, NULL when none failed."""
    return F.coalesce(*[F.when(failed, F.lit(label)) for failed, label in checks])


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a ``reason``, and the others."""
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    return accepted, checked.filter(F.col("reason").isNotNull())


def _event_columns(
    org: Column, source: Column, name: Column, ts: Column, payload: Column, as_of: Column, id: Column | None = None
) -> list[Column]:
    return [
        (F.uuid() if id is None else id).alias("id"),
        org.alias("organization_id"),
        source.cast("string").alias("data_source_id"),
        name.alias("event_name"),
        ts.alias("timestamp"),
        payload.alias("payload"),
        as_of.cast("timestamp").alias("created_at"),
    ]


def _not_an_object(json: Column) -> Column:
    return ~F.ltrim(json).startswith("{") | F.from_json(json, "map<string,string>").isNull()


def event_reason(field: Callable[[str], Column]) -> Column:
    """Why an event of the JSON source is refused; ``field`` gives its columns by name.

    A name outside 1..255 characters, a bad timestamp or id, or a payload that
    is no object refuses it.
    """
    name, ts = field("event_name"), field("timestamp")
    source, payload = field("data_source_id"), field("payload")
    return _first_reason(
        (F.coalesce(F.length(name), F.lit(0)) == 0, "event_name_missing"),
        (F.length(name) > MAX_NAME_LENGTH, "event_name_too_long"),
        (ts.isNotNull() & parse_iso(ts).isNull(), "bad_timestamp"),
        (~source.rlike(UUID_PATTERN), "bad_data_source_id"),
        (payload.isNotNull() & _not_an_object(payload), "bad_payload"),
    )


def hashed_id(*parts: Column) -> Column:
    """An id in the form of a UUID that depends on ``parts`` alone, so a rerun gives it again."""
    digest = F.md5(F.to_json(F.array(*[part.cast("string") for part in parts])))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def event_columns(
    field: Callable[[str], Column], org: Column, now: Column, id: Column | None = None
) -> list[Column]:
    """Columns of the event model; a missing time becomes ``now``, a missing payload ``{}``."""
    return _event_columns(
        org,
        field("data_source_id"),
        field("event_name"),
        F.coalesce(parse_iso(field("timestamp")), now),
        F.coalesce(field("payload"), F.lit("{}")),
        now,
        id,
    )


def json_to_events(
    raw: DataFrame, org: str | Column, as_of: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """Check and convert rows of ``schema.RAW_EVENTS``; works on a stream as well."""
    corrupt = F.col("_corrupt_record") if "_corrupt_record" in raw.columns else F.lit(None)
    reason = F.when(corrupt.isNotNull(), F.lit("not_json")).otherwise(event_reason(F.col))
    accepted, rejected = split(raw.withColumn("reason", reason))
    org = F.lit(org) if isinstance(org, str) else org
    return accepted.select(*event_columns(F.col, org, moment(as_of))), rejected


def read_json_events(
    spark: SparkSession, path: str, org: str, as_of: datetime, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Events from JSON files, one event or list of events per line.

    ``multi_line`` reads a file as one document; such a file is not split
    between tasks, so large inputs should have one document per line.
    """
    raw = spark.read.schema(schema.RAW_EVENTS).option("multiLine", multi_line).json(path)
    return json_to_events(raw, org, as_of)


def _csv_column(table: DataFrame, names: tuple[str, ...]) -> Column:
    """First non-empty value among the columns present; NULL if there is none."""
    present = [F.nullif(F.col(c), F.lit("")) for c in names if c in table.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def csv_to_events(
    rows: DataFrame, org: str | Column, source: str | Column, as_of: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """Convert rows of text columns; the header names decide their meaning.

    Rows without a name are rejected, a missing or bad time becomes ``as_of``,
    and every other column goes into the payload as text (empty for NULL).
    """
    now = moment(as_of)
    org = F.lit(org) if isinstance(org, str) else org
    source = F.lit(source) if isinstance(source, str) else source
    name = _csv_column(rows, CSV_NAME_COLUMNS)
    ts = F.coalesce(parse_iso(_csv_column(rows, CSV_TIME_COLUMNS)), now)
    rest = [c for c in rows.columns if c not in CSV_NAME_COLUMNS + CSV_TIME_COLUMNS]
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rest]
    payload = F.to_json(F.struct(*texts)) if texts else F.lit("{}")
    reason = _first_reason(
        (name.isNull(), "event_name_missing"), (F.length(name) > MAX_NAME_LENGTH, "event_name_too_long")
    )
    accepted = rows.filter(reason.isNull()).select(*_event_columns(org, source, name, ts, payload, now))
    return accepted, rows.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def csv_records_to_events(
    records: DataFrame, org: str | Column, source: str | Column, as_of: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """``csv_to_events`` for records with header rows of their own (``csv_records.read_records``).

    Of columns with equal names the last counts; missing fields are empty, and
    fields beyond the header are dropped.
    """
    now = moment(as_of)
    org = F.lit(org) if isinstance(org, str) else org
    source = F.lit(source) if isinstance(source, str) else source
    entry = F.transform("names", lambda n, i: F.struct(n.alias("name"), F.coalesce(F.get("fields", i), F.lit("")).alias("value")))
    kept = F.filter(
        entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size("names")), lambda later: later["name"] == e["name"])
    )
    core = CSV_NAME_COLUMNS + CSV_TIME_COLUMNS

    def value_of(name: str) -> Column:
        return F.get(F.filter("_row", lambda e: e["name"] == name), F.lit(0))["value"]

    def first_of(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.nullif(value_of(name), F.lit("")) for name in names])

    rest = F.filter("_row", lambda e: ~e["name"].isin(*core))
    read = records.withColumn("_row", kept).withColumns(
        {
            "_name": first_of(CSV_NAME_COLUMNS),
            "_time": first_of(CSV_TIME_COLUMNS),
            "_payload": F.to_json(F.map_from_entries(rest)),
        }
    )
    reason = _first_reason(
        (F.col("_name").isNull(), "event_name_missing"),
        (F.length("_name") > MAX_NAME_LENGTH, "event_name_too_long"),
    )
    ts = F.coalesce(parse_iso(F.col("_time")), now)
    accepted, rejected = split(read.withColumn("reason", reason))
    columns = _event_columns(org, source, F.col("_name"), ts, F.col("_payload"), now)
    return accepted.select(*columns), rejected.select(*records.columns, "reason")


def read_csv_events(
    spark: SparkSession, path: str, org: str, source: str, as_of: datetime, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Events from CSV files, each read by its own header row, quoted line breaks included.

    A large file is read by many tasks, and any number of different header rows
    may occur. ``strict`` fails on input without a single valid row.
    """
    events, rejected = csv_records_to_events(read_records(spark, path), org, source, as_of)
    if strict and events.isEmpty():
        raise ValueError("the CSV input has no valid event")
    return events, rejected


def read_webhook_events(
    raw: DataFrame, sources: DataFrame, as_of: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """Events from webhook bodies (``source_id``, ``body``) of active webhook sources.

    The source's ``config`` may name the body keys holding name and time; the
    names differ per row, hence the map. The whole body becomes the payload.
    """
    now = moment(as_of)
    usable = active(sources).filter(F.col("is_active") & (F.col("type") == "webhook"))
    known = usable.select(
        F.col("id").alias("source_id"),
        F.col("organization_id"),
        F.coalesce(F.col("config")["event_name_path"], F.lit(WEBHOOK_NAME_PATH)).alias("_name_key"),
        F.coalesce(F.col("config")["timestamp_path"], F.lit(WEBHOOK_TIME_PATH)).alias("_time_key"),
    )
    checked = (
        raw.join(known, "source_id", "left")
        .withColumn("_map", properties("body"))
        .withColumn(
            "reason",
            _first_reason(
                (F.col("organization_id").isNull(), "source_not_found"),
                (F.col("body").isNull() | F.col("_map").isNull(), "not_json"),
                (~F.ltrim(F.col("body")).startswith("{"), "not_json"),
                (F.length(last_value("_map", F.col("_name_key"))) > MAX_NAME_LENGTH, "event_name_too_long"),
            ),
        )
    )
    accepted, rejected = split(checked)
    name = F.coalesce(last_value("_map", F.col("_name_key")), F.lit(WEBHOOK_DEFAULT_NAME))
    ts = F.coalesce(parse_iso(last_value("_map", F.col("_time_key"))), now)
    columns = _event_columns(
        F.col("organization_id"), F.col("source_id"), name, ts, F.col("body"), now
    )
    return accepted.select(*columns), rejected.drop("_map", "_name_key", "_time_key")


def normalise(
    events: DataFrame, as_of: datetime | Column, batch: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Queue records (all text) to typed events.

    Missing id, time and payload get defaults. A bad id or time rejects the
    row, or with ``batch`` the whole batch it came in.
    """
    now = moment(as_of)
    parsed = parse_iso(F.col("timestamp"))
    ids = ("id", "organization_id", "data_source_id")
    checked = events.withColumn(
        "reason",
        _first_reason(
            (F.col("timestamp").isNotNull() & parsed.isNull(), "bad_timestamp"),
            *[(~F.col(c).rlike(UUID_PATTERN), f"bad_{c}") for c in ids],
            (F.length("event_name") > MAX_NAME_LENGTH, "event_name_too_long"),
        ),
    )
    accepted, rejected = split(whole_batches(checked, batch) if batch else checked)
    empty = F.col("payload").isNull() | F.trim("payload").isin("", "null", "[]", '""', "0", "false")
    columns = _event_columns(
        F.col("organization_id"),
        F.col("data_source_id"),
        F.col("event_name"),
        F.coalesce(parsed, now),
        F.when(empty, F.lit("{}")).otherwise(F.col("payload")),
        now,
        id=F.coalesce(F.col("id"), F.uuid()),
    )
    return accepted.select(*columns), rejected


def whole_batches(checked: DataFrame, batch: str) -> DataFrame:
    """Give every row of a batch with a refused row a ``reason``.

    The refused batch ids are joined back instead of taking a maximum over a
    window, so a batch of any size is spread over tasks: its rows are combined
    before the shuffle, and the adaptive join splits them after it.
    """
    refused = (
        checked.filter(F.col("reason").isNotNull())
        .groupBy(batch)
        .agg(F.min("reason").alias("_batch_reason"))
    )
    from_batch = F.concat(F.lit("batch_"), "_batch_reason")
    return (
        checked.join(refused, batch, "left")
        .withColumn("reason", F.coalesce("reason", from_batch))
        .drop("_batch_reason")
    )

"""Sources, keys, limits, gates, memberships and slugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventmetrics.operators import access as ac
from eventmetrics.plans.common import AS_OF, EV, cte, plain
from eventmetrics.session import work_dir
from eventmetrics.sources import events as src
from eventmetrics.sources import sample, store
from eventmetrics.sources.sample import table

USER = "1"
REQUEST_LIMIT = 3

# Inputs with defects spread over all rows, as expressions valid in both engines.
BAD_TIME = "CASE WHEN event_id % 11 = 0 THEN 'yesterday' WHEN event_id % 13 = 0 THEN NULL ELSE {ts} END"
SPARK_TS = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
DUCK_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"

JSON_COLUMNS = [
    "event_id",
    "CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN repeat('x', 300) "
    "ELSE event_type END AS event_name",
    "CASE WHEN event_id % 23 = 0 THEN '[1]' WHEN event_id % 29 = 0 THEN NULL ELSE props END AS payload",
    "CASE WHEN event_id % 31 = 0 THEN 'nope' WHEN event_id % 2 = 0 THEN "
    "md5(cast(user_id as string)) END AS data_source_id",
]
CSV_COLUMNS = [
    "CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS event_name",
    "CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'import' END AS event",
    "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'pro' END AS plan",
    "cast(user_id as string) AS user_id",
]
GATE_COLUMNS = [
    "event_id",
    "'org_' || cast(user_id % 4 as string) AS organization_id",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'src_' || cast(user_id % 4 + 4 * (event_id % 6) "
    "+ CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END as string) END AS data_source_id",
    "cast(floor(event_id / 3.0) as bigint) AS batch_id",
]
QUEUE_COLUMNS = [
    "CASE WHEN event_id % 7 = 0 THEN 'not-a-uuid' ELSE md5(cast(event_id as string)) END AS id",
    "md5(cast(user_id % 4 as string)) AS organization_id",
    "cast(NULL as string) AS data_source_id",
    "event_type AS event_name",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS payload",
    "cast(floor(event_id / 4.0) as bigint) AS batch_id",
]


def _raw(spark, sf_dir, columns, time_name="timestamp"):
    time = BAD_TIME.format(ts=SPARK_TS)
    return table(spark, sf_dir, "events").selectExpr(*columns, f"{time} AS {time_name}")


def json_events(spark, sf_dir):
    accepted, _ = src.json_to_events(_raw(spark, sf_dir, JSON_COLUMNS), "org_1", AS_OF)
    return plain(
        accepted.select("organization_id", "data_source_id", "event_name", "timestamp", "payload", "created_at")
    )


def json_rejects(spark, sf_dir):
    _, rejected = src.json_to_events(_raw(spark, sf_dir, JSON_COLUMNS), "org_1", AS_OF)
    return rejected.select("event_id", "reason")


def csv_events(spark, sf_dir):
    accepted, _ = src.csv_to_events(_raw(spark, sf_dir, CSV_COLUMNS, "time"), "org_1", "src_1", AS_OF)
    return plain(accepted.drop("id"))


def json_files(spark, sf_dir):
    """The same raw rows, written as JSON lines and read from the files."""
    path = work_dir(spark, "json-files")
    _raw(spark, sf_dir, JSON_COLUMNS).drop("event_id").write.json(path)
    accepted, _ = src.read_json_events(spark, path, "org_1", AS_OF)
    return plain(
        accepted.select("organization_id", "data_source_id", "event_name", "timestamp", "payload", "created_at")
    )


# Plans with a line break, quotes and a comma for some users.
BROKEN_PLAN = (
    "CASE WHEN cast(user_id AS bigint) % 3 = 0 THEN plan || chr(10) || 'the \"second\", ' || user_id ELSE plan END"
)


def csv_files(spark, sf_dir):
    """The raw rows in CSV files of two layouts, some with line breaks in quotes, read from one folder."""
    path = work_dir(spark, "csv-files")
    raw = _raw(spark, sf_dir, CSV_COLUMNS, "time").withColumn("plan", F.expr(BROKEN_PLAN))
    even = F.col("user_id").cast("bigint") % 2 == 0
    other = raw.filter(~even).select("user_id", F.col("time").alias("timestamp"), "event", "plan", "event_name")
    form = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    for part in (raw.filter(even), other):
        part.write.options(**form).mode("append").csv(path)
    accepted, _ = src.read_csv_events(spark, path, "org_1", "src_1", AS_OF)
    known = F.from_json("payload", "user_id string, plan string")
    return plain(accepted.drop("id").withColumn("p", known).select("*", "p.*").drop("p", "payload"))


def webhook_events(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.expr("'src_' || cast(event_id % 27 as string)").alias("source_id"),
        F.to_json(
            F.struct(
                F.expr("CASE WHEN event_id % 4 <> 0 THEN 'push' END").alias("event"),
                "event_type",
                F.expr(BAD_TIME.format(ts=SPARK_TS)).alias("timestamp"),
                "props",
            )
        ).alias("body"),
    )
    accepted, _ = src.read_webhook_events(raw, sample.data_sources(spark, sf_dir), AS_OF)
    return plain(
        accepted.select(
            "organization_id",
            "data_source_id",
            "event_name",
            "timestamp",
            F.get_json_object("payload", "$.event_type").alias("event_type"),
            F.get_json_object("payload", "$.props").alias("props"),
        )
    )


def normalised_events(spark, sf_dir):
    queue = table(spark, sf_dir, "events").selectExpr(
        *QUEUE_COLUMNS, f"CASE WHEN event_id % 50 = 0 THEN 'soon' WHEN event_id % 3 = 1 THEN NULL "
        f"ELSE {SPARK_TS} END AS timestamp"
    )
    accepted, _ = src.normalise(queue, AS_OF, batch="batch_id")
    return plain(accepted.drop("created_at"))


def key_attribution(spark, sf_dir):
    verdicts = ac.key_verdicts(
        sample.requests(spark, sf_dir), sample.api_keys(spark, sf_dir), F.col("received_at")
    )
    return verdicts.select("request_id", "organization_id", "reason")


def admission(spark, sf_dir):
    verdicts = ac.admission_verdicts(sample.requests(spark, sf_dir), REQUEST_LIMIT, prefix="caller")
    return verdicts.select("request_id", F.col("reason").isNull().alias("admitted"))


def _gated(spark, sf_dir, batch=None):
    raw = table(spark, sf_dir, "events").selectExpr(*GATE_COLUMNS)
    return ac.gate_verdicts(raw, sample.data_sources(spark, sf_dir), batch)


def source_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("event_id", "reason")


def source_gate_batch(spark, sf_dir):
    return _gated(spark, sf_dir, "batch_id").select("event_id", "reason")


def ingest_receipts(spark, sf_dir):
    return store.ingest_receipts(_gated(spark, sf_dir), "batch_id")


def partition_gate(spark, sf_dir):
    """Report runs by month: those outside the provisioned months have no partition."""
    runs = sample.report_histories(spark, sf_dir).withColumnRenamed("triggered_at", "timestamp")
    november = AS_OF.replace(year=2023, month=11, day=15)
    inside, outside = store.split_by_calendar(runs, store.expected_partitions(spark, november))
    columns = ["id", "reason"]
    return (
        inside.withColumn("reason", F.lit(None).cast("string"))
        .select(*columns)
        .unionByName(outside.select(*columns))
    )


def entitlement(spark, sf_dir):
    verdicts = ac.access_verdicts(
        sample.access_attempts(spark, sf_dir), sample.memberships(spark, sf_dir), "analyst"
    )
    return verdicts.select("attempt_id", "verdict")


def entitled_events(spark, sf_dir):
    events = sample.events(spark, sf_dir)
    return ac.entitled(events, sample.memberships(spark, sf_dir), USER, "analyst").select("id")


def slugs(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "upper(p_name) || ' & ' || p_brand || ' !' AS name"
    )
    return ac.slugs(parts)


QUERIES = {
    "json_events": json_events,
    "json_rejects": json_rejects,
    "csv_events": csv_events,
    "json_files": json_files,
    "csv_files": csv_files,
    "webhook_events": webhook_events,
    "normalised_events": normalised_events,
    "key_attribution": key_attribution,
    "admission": admission,
    "source_gate": source_gate,
    "source_gate_batch": source_gate_batch,
    "ingest_receipts": ingest_receipts,
    "partition_gate": partition_gate,
    "entitlement": entitlement,
    "entitled_events": entitled_events,
    "slugs": slugs,
}

_TIME = BAD_TIME.format(ts=DUCK_TS)
_PARSED = "CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN TIMESTAMP '2024-01-31' ELSE ts END"
_JSON = f"WITH raw AS (SELECT {', '.join(JSON_COLUMNS)}, {_TIME} AS timestamp, ts FROM events)"
_JSON_REASON = (
    "CASE WHEN event_name = '' THEN 'event_name_missing' "
    "WHEN length(event_name) > 255 THEN 'event_name_too_long' "
    "WHEN timestamp = 'yesterday' THEN 'bad_timestamp' "
    "WHEN data_source_id = 'nope' THEN 'bad_data_source_id' "
    "WHEN payload = '[1]' THEN 'bad_payload' END"
)
_SOURCES = cte("sources", sample.SOURCE_COLUMNS, "nation")
GATE_SQL = (
    f"WITH raw AS (SELECT {', '.join(GATE_COLUMNS)} FROM events), {_SOURCES}, "
    "g AS (SELECT event_id, batch_id, CASE WHEN data_source_id IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM sources s WHERE s.id = raw.data_source_id AND s.organization_id = raw.organization_id "
    "AND s.is_active AND NOT s.is_deleted) THEN 'source_not_usable' END AS reason FROM raw)"
)
_QUEUE = (
    f"WITH raw AS (SELECT {', '.join(QUEUE_COLUMNS)}, event_id % 50 = 0 AS bad_time, "
    "event_id % 3 = 1 AS no_time, ts FROM events)"
)

_CSV_FILES = (
    f"WITH raw AS (SELECT {', '.join(CSV_COLUMNS)}, {_PARSED} AS ts2 FROM events) "
    "SELECT 'org_1' AS organization_id, 'src_1' AS data_source_id, "
    f"coalesce(nullif(event_name, ''), event) AS event_name, ts2 AS timestamp, user_id, {BROKEN_PLAN} AS plan, "
    "TIMESTAMP '2024-01-31' AS created_at FROM raw WHERE coalesce(nullif(event_name, ''), event) IS NOT NULL"
)

ORACLES = {
    "json_events": (
        f"{_JSON} SELECT 'org_1' AS organization_id, data_source_id, event_name, "
        "coalesce(CASE WHEN timestamp IS NOT NULL THEN ts END, TIMESTAMP '2024-01-31') AS timestamp, "
        "coalesce(payload, '{}') AS payload, TIMESTAMP '2024-01-31' AS created_at "
        f"FROM raw WHERE {_JSON_REASON} IS NULL"
    ),
    "json_rejects": f"SELECT * FROM ({_JSON} SELECT event_id, {_JSON_REASON} AS reason FROM raw) WHERE reason IS NOT NULL",
    "csv_events": (
        f"WITH raw AS (SELECT {', '.join(CSV_COLUMNS)}, {_PARSED} AS ts2 FROM events) "
        "SELECT 'org_1' AS organization_id, 'src_1' AS data_source_id, "
        "coalesce(nullif(event_name, ''), event) AS event_name, ts2 AS timestamp, "
        "'{\"plan\":\"' || plan || '\",\"user_id\":\"' || user_id || '\"}' AS payload, "
        "TIMESTAMP '2024-01-31' AS created_at FROM raw WHERE coalesce(nullif(event_name, ''), event) IS NOT NULL"
    ),
    "webhook_events": (
        f"WITH {_SOURCES} SELECT s.organization_id, s.id AS data_source_id, "
        "CASE WHEN s.name_key IS NOT NULL THEN event_type WHEN event_id % 4 <> 0 THEN 'push' "
        f"ELSE 'webhook_event' END AS event_name, {_PARSED} AS timestamp, event_type, props "
        "FROM events JOIN sources s ON s.id = 'src_' || (event_id % 27) "
        "WHERE s.is_active AND NOT s.is_deleted AND s.type = 'webhook'"
    ),
    "normalised_events": (
        f"{_QUEUE} SELECT id, organization_id, data_source_id, event_name, "
        "CASE WHEN no_time THEN TIMESTAMP '2024-01-31' ELSE ts END AS timestamp, "
        "coalesce(payload, '{}') AS payload FROM raw WHERE batch_id NOT IN "
        "(SELECT batch_id FROM raw WHERE id = 'not-a-uuid' OR bad_time)"
    ),
    "key_attribution": (
        f"WITH {cte('requests', sample.REQUEST_COLUMNS, 'lineitem')}, {cte('keys', sample.KEY_COLUMNS, 'supplier')}, "
        "k AS (SELECT * FROM keys WHERE is_active AND NOT is_deleted), "
        "j AS (SELECT request_id, k.organization_id, CASE "
        "WHEN length(api_key) < 16 OR NOT starts_with(api_key, 'pk_live_') THEN 'invalid_format' "
        "WHEN k.prefix IS NULL THEN 'unknown_key' WHEN sha256(api_key) <> sha256(k.secret) THEN 'invalid_key' "
        "WHEN k.expires_at < received_at THEN 'expired_key' END AS reason "
        "FROM requests LEFT JOIN k ON k.prefix = left(api_key, 16)) "
        "SELECT request_id, CASE WHEN reason IS NULL THEN organization_id END AS organization_id, reason FROM j"
    ),
    "admission": (
        f"WITH {cte('requests', sample.REQUEST_COLUMNS, 'lineitem')} SELECT request_id, row_number() OVER "
        "(PARTITION BY caller, date_trunc('minute', received_at) ORDER BY received_at, request_id) "
        f"<= {REQUEST_LIMIT} AS admitted FROM requests"
    ),
    "source_gate": f"{GATE_SQL} SELECT event_id, reason FROM g",
    "source_gate_batch": (
        f"{GATE_SQL} SELECT event_id, CASE WHEN reason IS NOT NULL THEN reason WHEN max(reason) OVER "
        "(PARTITION BY batch_id) IS NOT NULL THEN 'batch_source_not_usable' END AS reason FROM g"
    ),
    "ingest_receipts": (
        f"{GATE_SQL} SELECT batch_id, count(*) FILTER (reason IS NULL) AS accepted, "
        "count(*) FILTER (reason IS NOT NULL) AS rejected FROM g GROUP BY ALL"
    ),
    "partition_gate": (
        f"WITH {cte('runs', sample.RUN_COLUMNS, 'orders')} SELECT id, CASE WHEN NOT (triggered_at >= "
        "TIMESTAMP '2023-11-01' AND triggered_at < TIMESTAMP '2024-03-01') THEN 'no_partition' END AS reason FROM runs"
    ),
    "entitlement": (
        f"WITH {cte('a', sample.ATTEMPT_COLUMNS, 'orders')}, {cte('m', sample.MEMBERSHIP_COLUMNS, 'customer')} "
        "SELECT attempt_id, CASE WHEN is_superuser THEN 'allowed' WHEN role IS NULL THEN 'not_a_member' "
        "WHEN role = 'viewer' THEN 'role_too_low' ELSE 'allowed' END AS verdict "
        "FROM a LEFT JOIN (SELECT * FROM m WHERE NOT is_deleted) m USING (user_id, organization_id)"
    ),
    "entitled_events": (
        f"WITH {EV}, {cte('m', sample.MEMBERSHIP_COLUMNS, 'customer')} SELECT id FROM ev WHERE organization_id IN "
        f"(SELECT organization_id FROM m WHERE user_id = '{USER}' AND NOT is_deleted AND role <> 'viewer')"
    ),
    "slugs": (
        "WITH n AS (SELECT p_partkey AS id, upper(p_name) || ' & ' || p_brand || ' !' AS name FROM part), "
        "b AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s-]', '', 'g'), "
        "'[\\s-]+', '-', 'g'), '-') AS base FROM n) "
        "SELECT id, name, CASE WHEN id = min(id) OVER (PARTITION BY base) THEN base "
        "ELSE base || '--' || id END AS slug FROM b"
    ),
}
ORACLES["json_files"] = ORACLES["json_events"]
ORACLES["csv_files"] = _CSV_FILES

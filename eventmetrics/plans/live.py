"""Streaming queries, run over the sample events until all of them are read."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import functions as F

from eventmetrics.operators import access as ac
from eventmetrics.operators import alerts as al
from eventmetrics.plans.alerting import (
    LIVE_RULES,
    MUTED_REPLAY,
    SWEEP,
    SWEEP_VALUES,
    TRANSITION,
    VIOLATED,
    muted_replay_inputs,
)
from eventmetrics.plans.common import AS_OF, EV, RULES, cte, plain, r6
from eventmetrics.plans.ingest import GATE_COLUMNS, GATE_SQL
from eventmetrics.session import stream_session, work_dir
from eventmetrics.sources import sample, store
from eventmetrics.sources.sample import table
from eventmetrics.streaming import alerts as sa
from eventmetrics.streaming import deltas as sd
from eventmetrics.streaming import feed as fd
from eventmetrics.streaming import ingest as si
from eventmetrics.streaming import metrics as sm
from eventmetrics.streaming import receipts as rc
from eventmetrics.streaming import states as st
from eventmetrics.streaming.snapshots import read_latest

REQUEST_LIMIT = 1
INGEST_BATCHES = 2
SLOTS = 16


# Parts the sample is split into, in no order of time; each is a batch of its own.
FILES = 4
ANY_ORDER = [f"coalesce(crc32(id), 0) % {FILES} = {n}" for n in range(FILES)]
# Streams that keep no state start their shuffles in many parts; small ones are merged as they run.
SHUFFLE_PARTS_PER_CORE = 16


def _in_turn(spark, path, inputs, parts, start, shuffle_parts=None):
    """Runs a stream once for each part of its inputs, given as conditions: what came since is one micro-batch.

    ``inputs`` are tables by name. A part is written by many tasks and read by
    many, whatever its size.
    """
    session = stream_session(spark, shuffle_parts)
    for part in parts:
        for name, rows in inputs.items():
            rows.filter(part).write.mode("append").parquet(f"{path}/{name}")
        streams = [session.readStream.schema(rows.schema).parquet(f"{path}/{name}") for name, rows in inputs.items()]
        start(*streams)


def _metrics(interval):
    """From keyed state: each batch reads its own events only."""

    def query(spark, sf_dir):
        path = work_dir(spark, f"metrics-{interval}")

        def start(events):
            sd.start_bucket_changes(events, interval, path, f"{path}/checkpoint", availableNow=True).awaitTermination()

        _in_turn(spark, path, {"in": sample.events(spark, sf_dir)}, ANY_ORDER, start)
        return plain(sd.read_bucket_metrics(spark, path))

    return query


def _recomputed_metrics(interval):
    """From the store: the buckets that a batch touches are computed anew."""

    def query(spark, sf_dir):
        path = work_dir(spark, f"metrics-{interval}")
        events = sample.events(spark, sf_dir)

        def start(arrived):
            sm.start_metrics(
                arrived,
                lambda session: session.read.schema(events.schema).parquet(f"{path}/in"),
                interval,
                path,
                f"{path}/checkpoint",
                availableNow=True,
            ).awaitTermination()

        parts = spark.sparkContext.defaultParallelism * SHUFFLE_PARTS_PER_CORE
        _in_turn(spark, path, {"in": events}, ANY_ORDER, start, parts)
        return plain(sm.read_metrics(spark, path))

    return query


def _feed(spark, sf_dir):
    rules = sample.alert_rules(spark, sf_dir)
    events = sample.events(spark, sf_dir)
    values = al.alert_values(events, rules, AS_OF)
    history = al.transitions(al.evaluate(rules, values, AS_OF), AS_OF)
    return fd.feed(events, fd.alert_feed(history, rules))


def feed_rows(spark, sf_dir):
    return plain(_feed(spark, sf_dir).select("organization_id", "timestamp", "id", "type", "title"))


def feed_search(spark, sf_dir):
    return fd.search(_feed(spark, sf_dir), "all", "RES").select("id", "type", "title")


def feed_search_alerts(spark, sf_dir):
    return fd.search(_feed(spark, sf_dir), "alert", "triggered").select("id", "rule_name", "state")


def event_frames(spark, sf_dir):
    frames = fd.event_feed(sample.events(spark, sf_dir)).select(
        F.from_json(
            "frame",
            "type string, data struct<id string, organization_id string, event_name string, "
            "timestamp string, payload struct<user_id string, k string>>",
        ).alias("f")
    )
    return frames.select(
        "f.type", "f.data.id", "f.data.organization_id", "f.data.event_name", "f.data.timestamp", "f.data.payload.*"
    )


def live_tail(spark, sf_dir):
    """Over four micro-batches, the last of which touches two tenants only."""
    path = work_dir(spark, "tail")
    last = "organization_id IN ('org_0', 'org_1') AND crc32(id) % 3 = 0"
    parts = [f"NOT ({last}) AND crc32(id) % 3 = {n}" for n in (2, 0, 1)]

    def start(events):
        feed = fd.event_feed(events)
        fd.start_live_tail(feed, f"{path}/tail", f"{path}/checkpoint", availableNow=True).awaitTermination()

    _in_turn(spark, path, {"in": sample.events(spark, sf_dir)}, [*parts, last], start)
    return plain(fd.read_tail(spark, f"{path}/tail").select("organization_id", "timestamp", "id", "title"))


def running_counts(spark, sf_dir):
    path = work_dir(spark, "counts")
    fd.start_running_counts(
        fd.event_feed(sample.event_stream(stream_session(spark), sf_dir)),
        f"{path}/counts",
        f"{path}/checkpoint",
        availableNow=True,
    ).awaitTermination()
    return read_latest(spark, f"{path}/counts")


def _sweeps(spark, sf_dir):
    """A clock stream of one batch, at the time of the batch sweeps."""
    path = work_dir(spark, "sweeps")
    sa.put_rules(sample.alert_rules(spark, sf_dir), path)
    clock = sample.event_stream(spark, sf_dir).select(
        F.date_add(F.to_date("timestamp"), 1).cast("timestamp").alias("timestamp")
    )
    sa.start_sweeps(
        clock,
        partial(sample.events, sf_dir=sf_dir),
        path,
        f"{path}/checkpoint",
        availableNow=True,
    ).awaitTermination()
    return path


def stream_alert_history(spark, sf_dir):
    history = sa.read_history(spark, _sweeps(spark, sf_dir))
    return plain(history.select("alert_rule_id", "state", "value", "threshold", "created_at"))


def stream_alert_rules(spark, sf_dir):
    rules = read_latest(spark, f"{_sweeps(spark, sf_dir)}/rules")
    return plain(rules.select("id", "current_state", "swept_at"))


# Ends of the periods in which events arrive; a sweep follows each.
SWEEP_DAYS = ("2024-01-11", "2024-01-21", "2024-01-31")


def _periods(column):
    ends = [f"TIMESTAMP '{day}'" for day in SWEEP_DAYS]
    begins = ["TIMESTAMP '2000-01-01'", *ends]
    return [f"{column} > {low} AND {column} <= {high}" for low, high in zip(begins, ends)]


def stream_pane_alerts(spark, sf_dir):
    """Three sweeps over panes: each reads the events of its own period and combines what is kept of the others."""
    path = work_dir(spark, "pane-sweeps")
    sa.put_rules(sample.alert_rules(spark, sf_dir), path)
    ticks = spark.sql(f"SELECT explode(array({', '.join(f"TIMESTAMP '{day}'" for day in SWEEP_DAYS)})) AS timestamp")

    def start(arrivals, clock):
        sa.start_pane_sweeps(arrivals, clock, path, f"{path}/checkpoint", availableNow=True).awaitTermination()

    inputs = {"in": sample.events(spark, sf_dir), "clock": ticks}
    parts = spark.sparkContext.defaultParallelism * SHUFFLE_PARTS_PER_CORE
    _in_turn(spark, path, inputs, _periods("timestamp"), start, parts)
    return plain(sa.read_history(spark, path).select("alert_rule_id", "state", "value", "threshold", "created_at"))


def stream_alert_replay(spark, sf_dir):
    """The replay with mutes, as a state machine over three micro-batches of ticks and snoozes."""
    path = work_dir(spark, "rule-states")
    rules, ticks, snoozes = muted_replay_inputs(spark, sf_dir)
    parts = ["at < TIMESTAMP '2024-01-11'", *[f"at >= TIMESTAMP '{a}' AND at < TIMESTAMP '{b}'" for a, b in zip(SWEEP_DAYS, SWEEP_DAYS[1:])]]

    def start(ticked, snoozed):
        inputs = st.rule_inputs(rules, ticked, snoozed)
        st.start_rule_states(inputs, f"{path}/history", f"{path}/checkpoint", "None", availableNow=True).awaitTermination()

    inputs = {"ticks": ticks.select("alert_rule_id", "at", "value"), "snoozes": snoozes}
    _in_turn(spark, path, inputs, parts, start)
    found = spark.read.parquet(f"{path}/history")
    return plain(found.select("alert_rule_id", "at", "is_tick", "state_before", "state_after", "history"))


# Each event is a request of its own; keys are those of four suppliers.
INGEST_COLUMNS = [
    "cast(event_id as string) AS request_id",
    "'pk_live_' || lpad(cast(user_id % 4 as string), 8, '0') || '-N' AS api_key",
    "CASE WHEN event_id % 41 = 0 THEN '' ELSE event_type END AS event_name",
    "CASE WHEN event_id % 2 = 0 THEN md5(cast(user_id % 8 as string)) END AS data_source_id",
]
INGEST_SOURCE_COLUMNS = [
    "md5(cast(n_nationkey as string)) AS id",
    "'org_' || cast(n_nationkey % 4 as string) AS organization_id",
    "n_regionkey <> 2 AS is_active",
    "false AS is_deleted",
    "'api' AS type",
]


def _ingested(spark, sf_dir):
    path = work_dir(spark, "ingest")
    # Micro-batches that share most minutes.
    parts = [f"event_id % {INGEST_BATCHES} = {n}" for n in range(INGEST_BATCHES)]

    def start(stream):
        raw = stream.selectExpr(*INGEST_COLUMNS, "event_id", "cast(ts as timestamp) AS received_at").select(
            "request_id",
            "api_key",
            "received_at",
            F.to_json(
                F.struct(
                    "event_name",
                    "data_source_id",
                    F.struct(F.col("event_id").cast("string").alias("event_id")).alias("payload"),
                )
            ).alias("body"),
        )
        si.start_ingest(
            raw,
            partial(sample.api_keys, sf_dir=sf_dir),
            lambda session: table(session, sf_dir, "nation").selectExpr(*INGEST_SOURCE_COLUMNS),
            path,
            f"{path}/checkpoint",
            limit=REQUEST_LIMIT,
            slots=SLOTS,
            availableNow=True,
        ).awaitTermination()

    _in_turn(spark, path, {"in": table(spark, sf_dir, "events")}, parts, start)
    return path


def stream_ingest(spark, sf_dir):
    path = _ingested(spark, sf_dir)
    events = store.read_events(spark, f"{path}/events").select(
        F.get_json_object("payload", "$.event_id").alias("request_id"),
        "organization_id",
        "event_name",
        "timestamp",
        "event_month",
        F.lit(None).cast("string").alias("reason"),
    )
    rejected = spark.read.parquet(f"{path}/rejected").select("request_id", "reason")
    return plain(events.unionByName(rejected, allowMissingColumns=True))


def stream_receipts(spark, sf_dir):
    """Receipts of micro-batches behind the source gate, as observed while they were written."""
    path = work_dir(spark, "receipts")
    parts = [f"event_id % {FILES} = {n}" for n in range(FILES)]

    def start(raw):
        gated = raw.selectExpr(*GATE_COLUMNS, "cast(ts as timestamp) AS timestamp")
        checked = ac.gate_verdicts(gated, sample.data_sources(raw.sparkSession, sf_dir))
        query, listener = rc.start_receipted(
            checked, f"{path}/out", f"{path}/checkpoint", f"{path}/receipts", availableNow=True
        )
        query.awaitTermination()
        if not listener.wait(query):
            raise RuntimeError("the receipts of the stream did not arrive")
        raw.sparkSession.streams.removeListener(listener)

    _in_turn(spark, path, {"in": table(spark, sf_dir, "events")}, parts, start)
    return rc.read_receipts(spark, f"{path}/receipts").drop("query_id")


QUERIES = {
    "stream_metrics_hour": _recomputed_metrics("hour"),
    "stream_metrics_day": _recomputed_metrics("day"),
    "stream_metrics_week": _recomputed_metrics("week"),
    "stream_changes_hour": _metrics("hour"),
    "stream_changes_day": _metrics("day"),
    "stream_changes_month": _metrics("month"),
    "feed_rows": feed_rows,
    "feed_search": feed_search,
    "feed_search_alerts": feed_search_alerts,
    "event_frames": event_frames,
    "live_tail": live_tail,
    "running_counts": running_counts,
    "stream_alert_history": stream_alert_history,
    "stream_alert_rules": stream_alert_rules,
    "stream_pane_alerts": stream_pane_alerts,
    "stream_alert_replay": stream_alert_replay,
    "stream_ingest": stream_ingest,
    "stream_receipts": stream_receipts,
}


def _metrics_sql(interval: str) -> str:
    bucket = f"cast(date_trunc('{interval}', ts) AS timestamp)"
    return f"""WITH {EV},
  b AS (SELECT *, {bucket} AS bucket FROM ev),
  se AS (SELECT organization_id, bucket, session_id, count(*) AS n,
           date_diff('microsecond', min(ts), max(ts)) / 1e6 AS secs FROM b GROUP BY ALL),
  sa AS (SELECT organization_id, bucket, cast(count(*) FILTER (n = 1) AS double) * 100 / count(*) AS bounce_rate,
           avg(secs) AS secs FROM se GROUP BY ALL),
  t AS (SELECT organization_id, bucket, count(*) FILTER (event_name = 'page_view') AS page_views,
          count(DISTINCT visitor_id) AS unique_visitors, count(*) FILTER (event_name = 'error') AS error_count,
          cast(count(*) FILTER (event_name = 'error') AS double) * 100 / count(*) AS error_rate FROM b GROUP BY ALL)
SELECT organization_id, bucket, page_views, unique_visitors, {r6('bounce_rate')} AS bounce_rate,
  {r6('secs')} AS avg_session_duration, error_count, {r6('error_rate')} AS error_rate
FROM t JOIN sa USING (organization_id, bucket)"""


def _sweeps_sql() -> str:
    """One sweep after the other, each over the events up to its tick."""
    steps, rows = ["st0 AS (SELECT id, current_state, muted_until FROM rules)"], []
    for k, day in enumerate(SWEEP_DAYS, 1):
        now = f"TIMESTAMP '{day}'"
        values = SWEEP_VALUES.replace("TIMESTAMP '2024-01-31'", now)
        steps.append(re.sub(r"\b(w|base|tot|ses|sa|vals)\b(?=[. ,)]| AS|$)", rf"\g<1>{k}", values))
        expired = "current_state = 'Muted' AND NOT mute"
        steps.append(
            f"j{k} AS (SELECT s.*, r.threshold, v.value, v.value IS NOT NULL AS judged, "
            f"s.current_state = 'Muted' AND coalesce(s.muted_until > {now}, false) AS mute, "
            f"{VIOLATED.format(v='v.value', t='r.threshold')} AS viol FROM st{k - 1} s JOIN rules r USING (id) "
            f"LEFT JOIN vals{k} v ON v.alert_rule_id = s.id), "
            f"sw{k} AS (SELECT *, {TRANSITION} AS transition FROM j{k}), "
            f"st{k} AS (SELECT id, CASE WHEN transition IS NOT NULL THEN transition WHEN judged AND {expired} "
            "THEN 'Resolved' ELSE current_state END AS current_state, CASE WHEN judged AND (transition = 'Resolved' "
            f"OR ({expired})) THEN NULL ELSE muted_until END AS muted_until FROM sw{k})"
        )
        rows.append(
            f"SELECT id AS alert_rule_id, transition AS state, {r6('value')} AS value, {r6('threshold')} AS threshold, "
            f"{now} AS created_at FROM sw{k} WHERE transition IS NOT NULL"
        )
    return f"WITH {EV}, {RULES}, {LIVE_RULES}, {', '.join(steps)} {' UNION ALL '.join(rows)}"


_ALERT_TITLE = "'[' || upper(transition) || '] ' || name"
_FEED = (
    f"WITH {SWEEP}, f AS (SELECT organization_id, ts AS timestamp, id, 'event' AS type, event_name, "
    "NULL AS rule_name, NULL AS state, 'Event Ingested: ' || event_name AS title FROM ev UNION ALL "
    "SELECT organization_id, TIMESTAMP '2024-01-31', id, 'alert', NULL, name, transition, "
    f"{_ALERT_TITLE} FROM sw WHERE transition IS NOT NULL)"
)

ORACLES = {
    "stream_metrics_hour": _metrics_sql("hour"),
    "stream_metrics_day": _metrics_sql("day"),
    "stream_metrics_week": _metrics_sql("week"),
    "stream_changes_hour": _metrics_sql("hour"),
    "stream_changes_day": _metrics_sql("day"),
    "stream_changes_month": _metrics_sql("month"),
    "stream_pane_alerts": _sweeps_sql(),
    "stream_alert_replay": MUTED_REPLAY,
    "feed_rows": f"{_FEED} SELECT organization_id, timestamp, id, type, title FROM f",
    "feed_search": (
        f"{_FEED} SELECT id, type, title FROM f WHERE contains(lower(coalesce(event_name, '')), 'res') "
        "OR contains(lower(coalesce(rule_name, '')), 'res') OR contains(lower(coalesce(state, '')), 'res') "
        "OR contains(lower(title), 'res')"
    ),
    "feed_search_alerts": (
        f"{_FEED} SELECT id, rule_name, state FROM f WHERE type = 'alert' AND (state = 'Triggered' "
        "OR contains(lower(title), 'triggered'))"
    ),
    "event_frames": (
        f"WITH {EV} SELECT 'event' AS type, id, organization_id, event_name, strftime(ts, '%Y-%m-%dT%H:%M:%S') || "
        "CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS timestamp, "
        "visitor_id AS user_id, k FROM ev"
    ),
    "live_tail": (
        f"WITH {EV} SELECT organization_id, timestamp, id, title FROM (SELECT organization_id, ts AS timestamp, id, "
        "'Event Ingested: ' || event_name AS title, row_number() OVER (PARTITION BY organization_id "
        "ORDER BY ts DESC, id DESC) AS n FROM ev) WHERE n <= 200"
    ),
    "running_counts": (
        f"WITH {EV} SELECT organization_id, 'event' AS type, count(*) AS rows FROM ev GROUP BY ALL"
    ),
    "stream_alert_history": (
        f"WITH {SWEEP} SELECT id AS alert_rule_id, transition AS state, {r6('value')} AS value, "
        f"{r6('threshold')} AS threshold, TIMESTAMP '2024-01-31' AS created_at FROM sw WHERE transition IS NOT NULL"
    ),
    "stream_alert_rules": (
        f"WITH {SWEEP} SELECT id, CASE WHEN transition IS NOT NULL THEN transition WHEN judged AND "
        "current_state = 'Muted' AND NOT mute THEN 'Resolved' ELSE current_state END AS current_state, "
        "TIMESTAMP '2024-01-31' AS swept_at FROM sw"
    ),
    "stream_ingest": (
        f"WITH raw AS (SELECT {', '.join(INGEST_COLUMNS)}, ts, event_id FROM events), "
        f"{cte('sources', INGEST_SOURCE_COLUMNS, 'nation')}, "
        f"{cte('keys', sample.KEY_COLUMNS, 'supplier')}, k AS (SELECT * FROM keys WHERE is_active AND NOT is_deleted), "
        "a AS (SELECT raw.*, k.organization_id, CASE WHEN k.prefix IS NULL THEN 'unknown_key' "
        "WHEN k.secret <> api_key THEN 'invalid_key' WHEN k.expires_at < ts THEN 'expired_key' END AS key_reason "
        "FROM raw LEFT JOIN k ON k.prefix = left(api_key, 16)), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY key_reason, left(api_key, 16), date_trunc('minute', ts) "
        f"ORDER BY event_id % {INGEST_BATCHES}, ts, request_id) AS nth FROM a), "
        "o AS (SELECT *, CASE WHEN key_reason IS NOT NULL THEN key_reason "
        f"WHEN nth > {REQUEST_LIMIT} THEN 'rate_limited' WHEN event_name = '' THEN 'event_name_missing' "
        "WHEN data_source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.id = n.data_source_id "
        "AND s.organization_id = n.organization_id AND s.is_active) THEN 'source_not_usable' END AS reason FROM n) "
        "SELECT request_id, CASE WHEN reason IS NULL THEN organization_id END AS organization_id, "
        "CASE WHEN reason IS NULL THEN event_name END AS event_name, CASE WHEN reason IS NULL THEN ts END AS timestamp, "
        "CASE WHEN reason IS NULL THEN cast(date_trunc('month', ts) AS date) END AS event_month, reason FROM o"
    ),
    "stream_receipts": (
        f"{GATE_SQL} SELECT event_id % {FILES} AS batch, count(*) FILTER (reason IS NULL) AS accepted, "
        "count(*) FILTER (reason IS NOT NULL) AS rejected, min(ts) FILTER (reason IS NULL) AS first_ts, "
        "max(ts) FILTER (reason IS NULL) AS last_ts FROM g JOIN events USING (event_id) GROUP BY ALL"
    ),
}

import json
from datetime import timedelta

import pytest
from helpers import AS_OF, event, events, local, rows, rule, rules, utc
from pyspark.sql import functions as F
from test_ingest import key

from eventmetrics import schema
from eventmetrics.operators import alerts as al
from eventmetrics.operators import series as se
from eventmetrics.sources import store
from eventmetrics.streaming import alerts as sa
from eventmetrics.streaming import feed as fd
from eventmetrics.streaming import ingest as si
from eventmetrics.streaming import metrics as sm
from eventmetrics.streaming.snapshots import read_latest


class Files:
    """A stream that gets one file of rows at a time."""

    def __init__(self, spark, path, layout):
        self.spark, self.path, self.layout = spark, str(path), layout

    def put(self, df):
        df.coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.layout).parquet(self.path)


@pytest.fixture
def inbox(spark, tmp_path):
    return Files(spark, tmp_path / "in", schema.EVENTS)


@pytest.mark.parametrize("files_per_trigger", [1, 100])
def test_buckets_equal_batch_for_any_order(spark, inbox, tmp_path, files_per_trigger):
    parts = [
        [
            event(n, utc(2026, 5, 20, h, m), user_id=f"u{(h + m) % 3}", session_id=f"s{m % 4}" if m % 5 else None)
            for h in hours
            for m, n in zip(range(0, 60, 7), ["page_view", "error", "click", "page.view"] * 3)
        ]
        for hours in ((10, 12), (20,), (1, 2), (3, 22), (10, 1))
    ]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    load = lambda session: session.read.schema(schema.EVENTS).parquet(inbox.path)
    for part in parts:
        inbox.put(events(spark, part))
        if files_per_trigger == 1:
            sm.start_metrics(inbox.stream(), load, "hour", out, checkpoint, availableNow=True).awaitTermination()
    sm.start_metrics(inbox.stream(), load, "hour", out, checkpoint, availableNow=True).awaitTermination()
    everything = load(spark)
    for read in (lambda: sm.read_metrics(spark, out), lambda: sm.read_metrics(spark, str(tmp_path / "compact"))):
        sm.compact_metrics(spark, out, str(tmp_path / "compact"))
        found = read()
        assert found.count() == 7
        for metric in ("page_views", "unique_visitors", "bounce_rate", "avg_session_duration"):
            batch = se.timeseries(everything, metric, "hour", utc(2026, 5, 1), AS_OF)
            got = [(b, float(v)) for b, v in rows(found, "bucket", metric)]
            assert rows(batch, "bucket", "value") == got
    with pytest.raises(ValueError):
        sm.touched_buckets(everything, "fortnight")


def test_tail_over_batches(spark, inbox, tmp_path):
    tail, checkpoint = str(tmp_path / "tail"), str(tmp_path / "checkpoint")
    for part in range(3):
        inbox.put(
            events(spark, [event(f"n{part}", AS_OF + timedelta(minutes=10 * part + i), org=o) for i in range(3) for o in ("a", "b")])
        )
        fd.start_live_tail(fd.event_feed(inbox.stream()), tail, checkpoint, frames=4, availableNow=True).awaitTermination()
    found = fd.read_tail(spark, tail)
    assert rows(found.filter("organization_id = 'a'"), "timestamp", "event_name") == [
        (local(AS_OF + timedelta(minutes=m)), n) for m, n in ((12, "n1"), (20, "n2"), (21, "n2"), (22, "n2"))
    ]
    assert found.count() == 8
    # A batch writes the tails it changes, no others.
    inbox.put(events(spark, [event("n3", AS_OF + timedelta(hours=1), org="b"), event("old", AS_OF - timedelta(hours=1), org="a")]))
    fd.start_live_tail(fd.event_feed(inbox.stream()), tail, checkpoint, frames=4, availableNow=True).awaitTermination()
    last = spark.read.parquet(f"{tail}/batch=3")
    assert rows(last, "organization_id", "event_name") == [("b", "n2"), ("b", "n2"), ("b", "n2"), ("b", "n3")]
    assert rows(fd.read_tail(spark, tail), "organization_id", "event_name")[:4] == [("a", "n1"), ("a", "n2"), ("a", "n2"), ("a", "n2")]


def test_counts_over_batches(spark, inbox, tmp_path):
    counts, checkpoint = str(tmp_path / "counts"), str(tmp_path / "checkpoint")
    for part in range(2):
        inbox.put(events(spark, [event("x", AS_OF)] * (part + 1)))
        fd.start_running_counts(fd.event_feed(inbox.stream()), counts, checkpoint, availableNow=True).awaitTermination()
    assert rows(read_latest(spark, counts), "organization_id", "type", "rows") == [("org_a", "event", 3)]


def test_frames_feed_and_search(spark):
    table = events(
        spark, [event("btn_checkout_click", AS_OF, cart_value=129.99, items=3, platform="mobile"), event("x", AS_OF, org="org_b")]
    )
    frame = json.loads(fd.event_feed(table).filter("event_name <> 'x'").first().frame)
    assert frame["type"] == "event"
    assert frame["data"]["payload"] == {"cart_value": 129.99, "items": 3, "platform": "mobile"}
    assert frame["data"]["timestamp"] == "2026-05-21T12:00:00+00:00"
    watched = rules(spark, rule(name="Checkout errors"), rule(id="r2", name="Slow", current_state="Triggered"))
    judged = spark.createDataFrame(
        [("r1", "org_a", 4.0, True), ("r2", "org_a", 0.0, True)],
        "alert_rule_id string, organization_id string, value double, is_known_metric boolean",
    )
    history = al.transitions(al.evaluate(watched, judged, AS_OF), AS_OF)
    both = fd.feed(table, fd.alert_feed(history, watched), org="org_a")
    assert both.count() == 3
    assert rows(fd.search(both, "all", "CHECKOUT"), "title") == [
        ("Event Ingested: btn_checkout_click",),
        ("[TRIGGERED] Checkout errors",),
    ]
    assert rows(fd.search(both, "alert", "resolved"), "rule_name") == [("Slow",)]
    assert fd.search(both, "event", "slow").isEmpty()
    assert fd.search(both, "all", "  ").count() == 3
    assert fd.search(both, "system").isEmpty()
    with pytest.raises(ValueError):
        fd.search(both, "noise")


def test_sweeps_walk(spark, tmp_path):
    """Trigger, snooze, silence, recovery over four sweeps; a repeated sweep changes nothing."""
    path = str(tmp_path / "state")
    burst = events(spark, [event("error", AS_OF) for _ in range(4)])
    sa.put_rules(rules(spark, rule()), path)
    clock = Files(spark, tmp_path / "clock", "timestamp timestamp")
    snoozes = []
    layout = "organization_id string, alert_rule_id string, snooze_minutes int, requested_at timestamp"

    def load_snoozes(session):
        return spark.createDataFrame(snoozes, layout)

    def tick(minute):
        at = AS_OF + timedelta(minutes=minute)
        clock.put(spark.createDataFrame([(at,)], "timestamp timestamp"))
        sa.start_sweeps(
            clock.stream(), lambda s: burst, path, str(tmp_path / "checkpoint"), load_snoozes, availableNow=True
        ).awaitTermination()
        return rows(read_latest(spark, f"{path}/rules"), "current_state")[0][0]

    assert tick(1) == "Triggered"
    snoozes.append(("org_a", "r1", 30, AS_OF + timedelta(minutes=1, seconds=30)))
    assert tick(2) == "Muted"
    assert tick(3) == "Muted"
    assert tick(15) == "Resolved"
    history = sa.read_history(spark, path)
    wanted = [("Triggered", 4.0, 0), ("Muted", 0.0, 1), ("Resolved", 0.0, 3)]
    assert sorted(rows(history, "sweep", "state", "value")) == [(n, s, v) for s, v, n in wanted]
    at = int((AS_OF + timedelta(minutes=15)).timestamp() * 1e6)
    sa.sweep(spark, lambda s: burst, path, 3, at, load_snoozes)
    assert sa.read_history(spark, path).count() == 3
    assert rows(read_latest(spark, f"{path}/rules"), "current_state") == [("Resolved",)]


def test_sweeps_see_changed_rules_and_late_snoozes(spark, tmp_path):
    path = str(tmp_path / "state")
    burst = events(spark, [event("error", AS_OF) for _ in range(4)])
    defined = [rule(), rule(id="r2", threshold=10.0)]
    sa.put_rules(rules(spark, *defined), path)
    snoozes = []
    layout = "organization_id string, alert_rule_id string, snooze_minutes int, requested_at timestamp"

    def tick(minute, version):
        at = int((AS_OF + timedelta(minutes=minute)).timestamp() * 1e6)
        load = lambda s: s.createDataFrame(snoozes, layout)
        sa.sweep(spark, lambda s: burst, path, version, at, load, lambda s: rules(s, *defined))
        return dict(rows(read_latest(spark, f"{path}/rules"), "id", "current_state"))

    assert tick(1, 0) == {"r1": "Triggered", "r2": "Resolved"}
    # An edited rule, a new one, a deleted one; states are carried over.
    defined[:] = [rule(), rule(id="r2", threshold=2.0), rule(id="r3", threshold=1.0)]
    assert tick(2, 1) == {"r1": "Triggered", "r2": "Triggered", "r3": "Triggered"}
    # Asked for before the last sweep, written after it.
    snoozes.append(("org_a", "r3", 30, AS_OF + timedelta(seconds=90)))
    del defined[0]
    assert tick(3, 2) == {"r2": "Triggered", "r3": "Muted"}
    assert tick(4, 3) == {"r2": "Triggered", "r3": "Muted"}
    history = sa.read_history(spark, path).filter("state = 'Muted'")
    assert rows(history, "alert_rule_id", "sweep") == [("r3", 2)]


def test_ingest_over_batches(spark, tmp_path):
    secret = "pk_live_good0000-secret"
    source = "11111111-2222-3333-4444-555555555555"
    keys = spark.createDataFrame([key(secret)], schema.API_KEYS)
    sources = spark.createDataFrame(
        [(source, "org_a", "s", "api", None, True, False)], schema.DATA_SOURCES
    )
    raw = Files(spark, tmp_path / "in", "request_id string, api_key string, received_at timestamp, body string")
    path = str(tmp_path / "out")

    def send(*requests):
        raw.put(spark.createDataFrame(list(requests), raw.layout))
        si.start_ingest(
            raw.stream(), lambda s: keys, lambda s: sources, path, str(tmp_path / "checkpoint"), limit=3,
            load_calendar=lambda s: store.expected_partitions(s, AS_OF), availableNow=True,
        ).awaitTermination()

    def body(*found):
        return json.dumps(list(found) if len(found) != 1 else found[0])

    at = AS_OF
    send(
        ("r1", secret, at, body({"event_name": "one", "data_source_id": source})),
        ("r2", "pk_live_none0000-secret", at, body({"event_name": "x"})),
        ("r3", secret, at + timedelta(seconds=1), body({"event_name": "a"}, {"event_name": "b", "payload": {"k": 1}})),
        ("r0", secret, at + timedelta(minutes=1), "[]"),
    )
    send(
        ("r4", secret, at + timedelta(seconds=2), body({"event_name": "ok"}, {"event_name": ""})),
        ("r5", secret, at + timedelta(seconds=3), body({"event_name": "late"})),
        ("r6", secret, at + timedelta(minutes=1), body({"event_name": "next"}, {"event_name": "n", "data_source_id": "0" * 32})),
        ("r7", secret, at + timedelta(minutes=1), "{broken"),
        ("r8", secret, at + timedelta(hours=2), '{"event_name":"a"},{"event_name":"b"}'),
        ("r9", secret, at + timedelta(hours=3), body({"event_name": "far", "timestamp": "2031-01-01T00:00:00Z"})),
    )
    stored = store.read_events(spark, f"{path}/events")
    assert rows(stored, "event_name", "organization_id") == [("a", "org_a"), ("b", "org_a"), ("one", "org_a")]
    assert stored.select("id").distinct().count() == 3
    refused = rows(spark.read.parquet(f"{path}/rejected"), "request_id", "reason")
    assert refused == [
        ("r0", "not_json"),
        ("r2", "unknown_key"),
        ("r4", "event_name_missing"),
        ("r5", "rate_limited"),
        ("r6", "source_not_usable"),
        ("r7", "not_json"),
        ("r8", "not_json"),
        ("r9", "no_partition"),
    ]

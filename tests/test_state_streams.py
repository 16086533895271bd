"""Keyed state: each batch reads its own rows, results equal the batch operators."""

import random
from datetime import timedelta

import pytest
from helpers import AS_OF, ago, event, events, local, rows, rule, rules, utc
from pyspark.sql import functions as F
from test_streaming import Files

from eventmetrics import schema
from eventmetrics.operators import alerts as al
from eventmetrics.operators import panes as pn
from eventmetrics.operators import rollups as ro
from eventmetrics.operators import series as se
from eventmetrics.plans import live
from eventmetrics.streaming import alerts as sa
from eventmetrics.streaming import deltas as sd
from eventmetrics.streaming import limits as li
from eventmetrics.streaming import metrics as sm
from eventmetrics.streaming import states as st
from eventmetrics.streaming.snapshots import read_latest

NAMES = ["page_view", "error", "click", "page.view"]


def some_events(rng, n, minutes=3000, orgs=("a", "b")):
    out = []
    for _ in range(n):
        who = {}
        if rng.random() < 0.85:
            who["session_id"] = f"s{rng.randrange(12)}"
        if rng.random() < 0.85:
            who["user_id"] = f"u{rng.randrange(9)}"
        # Half of all events lie on a whole minute: edges of windows and buckets.
        at = ago(minutes=rng.randrange(minutes), microseconds=rng.choice([0, 0, 1, 999_999, 31_000_000]))
        out.append(event(rng.choice(NAMES), at, org=rng.choice(orgs), **who))
    return out


@pytest.fixture
def inbox(spark, tmp_path):
    return Files(spark, tmp_path / "in", schema.EVENTS)


def started(query):
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]


# ---------------------------------------------------------------- bucketed metrics


@pytest.mark.parametrize("interval", ["hour", "day"])
def test_changes_equal_batch_and_read_only_new_rows(spark, inbox, tmp_path, interval):
    rng = random.Random(interval)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    given = some_events(rng, 400)
    given += [event("page_view", AS_OF, org="a", session_id="hot", user_id="hot") for _ in range(300)]
    given += [event("error", AS_OF, org="a")] * 100
    rng.shuffle(given)
    # Batches of any size, one of which comes twice as large; every row may be late.
    for cut in ((0, 5), (5, 300), (300, 301), (301, 800)):
        inbox.put(events(spark, given[slice(*cut)]))
        read = started(sd.start_bucket_changes(inbox.stream(), interval, out, checkpoint, availableNow=True))
        assert sum(read) == cut[1] - cut[0]
    everything = spark.read.schema(schema.EVENTS).parquet(inbox.path)
    want = sm.bucket_metrics(everything.withColumn("bucket", F.date_trunc(interval, "timestamp")))
    columns = [*sm.KEYS, *sm.VALUES]
    assert rows(sd.read_bucket_metrics(spark, out), *columns) == rows(want, *columns)
    sd.compact_bucket_changes(spark, out, str(tmp_path / "compact"))
    assert rows(sd.read_bucket_metrics(spark, str(tmp_path / "compact")), *columns) == rows(want, *columns)
    views = se.timeseries(everything, "page_views", interval, utc(2026, 1, 1), AS_OF)
    assert rows(views, "organization_id", "bucket", "value") == [
        (o, b, float(v)) for o, b, v in rows(sd.read_bucket_metrics(spark, out), "organization_id", "bucket", "page_views")
    ]


def test_changes_are_added_up_before_they_meet_the_state(spark):
    hot = events(spark, [event("page_view", AS_OF, org="a", session_id="s", user_id="u") for _ in range(500)] + [event("x", AS_OF)] * 200)
    part = sd.keyed_events(hot.coalesce(1), "hour").mapInArrow(sd._added_up, sd.PARTIAL)
    assert part.count() == 3  # a session, a visitor, and the rows without either


def state_rows(query):
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]


def test_state_of_many_sessions_is_a_few_values(spark, inbox, tmp_path):
    """Calls to the state go by slot, not by session or visitor."""
    given = [event("click", AS_OF + timedelta(seconds=i % 7), org="a", session_id=f"s{i}", user_id=f"u{i}") for i in range(300)]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for cut in ((0, 200), (100, 300)):
        inbox.put(events(spark, given[slice(*cut)]))
        query = sd.start_bucket_changes(inbox.stream(), "month", out, checkpoint, slots=4, availableNow=True)
        assert max(state_rows(query)) <= 4
    (got,) = sd.read_bucket_metrics(spark, out).collect()
    assert (got.unique_visitors, got.bounce_rate, got.page_views) == (300, percent_of(200, 300), 0)


def percent_of(part, whole):
    return pytest.approx(100 * part / whole)


# ---------------------------------------------------------------- panes and sweeps


@pytest.mark.parametrize("seed", [1, 2])
def test_panes_equal_lookbacks(spark, seed):
    rng = random.Random(seed)
    table = events(spark, some_events(rng, 500, minutes=200))
    windows = spark.createDataFrame([(o, w) for o in ("a", "b", "none") for w in (1, 7, 30, 120)], "organization_id string, time_window_minutes int")
    for minutes in (0, 3, 55):
        now = AS_OF - timedelta(minutes=minutes)
        parts = pn.panes(table.filter("crc32(id) % 2 = 0")).unionByName(pn.panes(table.filter("crc32(id) % 2 = 1")))
        got = al.lookback_totals_of_panes(parts, windows, now + timedelta(seconds=20))
        assert rows(got) == rows(al.lookback_totals(table, windows, now))


def test_pane_sweeps(spark, inbox, tmp_path):
    """Every sweep equals one over all events that came; a batch holds what came since the last one, and a tick."""
    rng = random.Random(3)
    given = some_events(rng, 600, minutes=40, orgs=("org_a",))
    # Mostly in order of time, some late.
    given.sort(key=lambda e: e[4] + timedelta(minutes=rng.choice([0, 0, 0, 9])))
    watched = [
        rule(id=f"r{i}", metric_type=m, threshold=t, time_window_minutes=w)
        for i, (m, t, w) in enumerate([("error_count", 20.0, 10), ("unique_visitors", 5.0, 3), ("bounce_rate", 10.0, 7), ("avg_session_duration", 60.0, 15), ("page_views", 30.0, 5)])
    ]
    path, clock = str(tmp_path / "state"), Files(spark, tmp_path / "clock", "timestamp timestamp")
    sa.put_rules(rules(spark, *watched), path)
    held, seen = rules(spark, *watched), []
    for n, minutes in enumerate((25, 17, 9, 8, 0)):
        at = AS_OF - timedelta(minutes=minutes)
        new = [e for e in given if e not in seen and e[4] <= at + timedelta(minutes=2 * (n % 2))]
        seen += new
        if n != 3:  # a sweep without news as well
            inbox.put(events(spark, new))
        clock.put(spark.createDataFrame([(at + timedelta(seconds=7),)], "timestamp timestamp"))
        read = started(
            sa.start_pane_sweeps(inbox.stream(), clock.stream(), path, str(tmp_path / "checkpoint"), availableNow=True)
        )
        assert sum(read) == (len(new) if n != 3 else 0) + 1
        came = spark.read.schema(schema.EVENTS).parquet(inbox.path)
        evaluated = al.evaluate(held, al.alert_values(came, held, at), at)
        want = rows(al.transitions(evaluated, at), "alert_rule_id", "state", "value", "created_at")
        history = sa.read_history(spark, path)
        assert rows(history.filter(F.col("sweep") == n), "alert_rule_id", "state", "value", "created_at") == want
        after = [tuple(r) for r in al.next_rules(evaluated, held.columns).collect()]
        held = spark.createDataFrame(after, schema.ALERT_RULES)
        assert rows(read_latest(spark, f"{path}/rules"), "id", "current_state") == rows(held, "id", "current_state")
    assert sa.read_history(spark, path).count() > 3


def test_applied_snoozes_are_forgotten(spark, tmp_path):
    path = str(tmp_path / "state")
    sa.put_rules(rules(spark, rule()), path)
    layout = "organization_id string, alert_rule_id string, snooze_minutes int, requested_at timestamp"
    asked = [("org_a", "r1", 30, ago(days=6)), ("org_a", "r1", 30, ago(days=30))]
    load = lambda s: s.createDataFrame(asked, layout)
    none = events(spark, [event("x", AS_OF)])

    def sweep(version, at):
        sa.sweep(spark, lambda s: none, path, version, int(at.timestamp() * 1e6), load)
        return read_latest(spark, f"{path}/snoozed").count()

    assert sweep(0, AS_OF) == 1  # the other one is too old to count
    assert sweep(1, AS_OF + timedelta(days=3)) == 0
    assert sa.read_history(spark, path).filter("state = 'Muted'").count() == 1


# ---------------------------------------------------------------- rule states


TICK, SNOOZE = "alert_rule_id string, at timestamp, value double", "alert_rule_id string, at timestamp, snooze_minutes int"


@pytest.mark.parametrize("seed", [1, 2])
def test_rule_states_equal_replay(spark, tmp_path, seed):
    rng = random.Random(seed)
    watched = rules(
        spark,
        *[
            rule(id=f"r{i}", threshold=0.5, current_state=s, muted_until=u)
            for i, (s, u) in enumerate([("Resolved", None), ("Triggered", None), ("Muted", AS_OF + timedelta(minutes=3)), ("Muted", None)])
        ],
    )
    ticks = [(f"r{i}", AS_OF + timedelta(minutes=m), float(rng.random() < 0.6)) for m in range(40) for i in range(4)]
    asked = [(f"r{rng.randrange(4)}", AS_OF + timedelta(minutes=rng.randrange(40)), rng.randrange(12)) for _ in range(14)]
    asked = list({(r, at): (r, at, n) for r, at, n in asked}.values())
    a, b = Files(spark, tmp_path / "ticks", TICK), Files(spark, tmp_path / "snoozes", SNOOZE)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for low, high in ((0, 1), (1, 2), (2, 17), (17, 40)):
        inside = lambda x: timedelta(minutes=low) <= x[1] - AS_OF < timedelta(minutes=high)  # noqa: B023, E731
        a.put(spark.createDataFrame([t for t in ticks if inside(t)], TICK))
        b.put(spark.createDataFrame([s for s in asked if inside(s)], SNOOZE))
        st.start_rule_states(st.rule_inputs(watched, a.stream(), b.stream()), out, checkpoint, "None", availableNow=True).awaitTermination()
    want = al.replay(watched, spark.createDataFrame(ticks, TICK), spark.createDataFrame(asked, SNOOZE))
    columns = ["alert_rule_id", "at", "is_tick", "violated", "state_before", "state_after", "history"]
    assert rows(spark.read.parquet(out), *columns) == rows(want, *columns)
    # Input from before what was judged is left out.
    a.put(spark.createDataFrame([("r1", AS_OF, 1.0)], TICK))
    st.start_rule_states(st.rule_inputs(watched, a.stream(), b.stream()), out, checkpoint, "None", availableNow=True).awaitTermination()
    assert spark.read.parquet(out).count() == want.count()


def test_states_of_many_rules_are_a_few_values(spark, tmp_path, monkeypatch):
    """Calls to the state go by slot, not by rule; values that are missing or not a number stay what they are."""
    watched = rules(spark, *[rule(id=f"r{i}", threshold=0.5) for i in range(100)])
    a = Files(spark, tmp_path / "ticks", TICK)
    values = [1.0, float("nan"), None]
    a.put(spark.createDataFrame([(f"r{i}", AS_OF, values[i % 3]) for i in range(100)], TICK))
    out = str(tmp_path / "out")
    monkeypatch.setattr(st, "SLOTS", 4)
    inputs = st.rule_inputs(watched, a.stream())
    assert max(state_rows(st.start_rule_states(inputs, out, str(tmp_path / "checkpoint"), "None", availableNow=True))) <= 4
    kinds = spark.read.parquet(out).selectExpr("value IS NULL AS none", "coalesce(isnan(value), false) AS nan").groupBy("none", "nan").count()
    assert sorted(tuple(r) for r in kinds.collect()) == [(False, False, 34), (False, True, 33), (True, False, 33)]


def test_mute_ends_without_a_tick(spark, tmp_path):
    watched = rules(spark, rule(current_state="Muted", muted_until=utc(2020, 1, 1)))
    a = Files(spark, tmp_path / "ticks", TICK)
    b = Files(spark, tmp_path / "snoozes", SNOOZE)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def send(tick, snooze):
        a.put(spark.createDataFrame([tick] if tick else [], TICK))
        b.put(spark.createDataFrame([snooze] if snooze else [], SNOOZE))
        st.start_rule_states(st.rule_inputs(watched, a.stream(), b.stream()), out, checkpoint, availableNow=True).awaitTermination()

    send(("r1", utc(2020, 1, 2), 9.0), ("r1", utc(2020, 1, 3), 30))
    send(None, None)
    send(("r2", utc(2020, 1, 1), 0.0), None)
    found = rows(spark.read.parquet(out), "at", "is_tick", "state_before", "state_after", "history")
    assert [f for f in found if f[1] is not None] == [
        (local(utc(2020, 1, 2)), True, "Muted", "Triggered", "Triggered"),
        (local(utc(2020, 1, 3)), False, "Triggered", "Muted", "Muted"),
    ]
    assert [f[2:] for f in found if f[1] is None] == [("Muted", "Resolved", None)]


# ---------------------------------------------------------------- request limits


RAW = "request_id string, api_key string, received_at timestamp, body string"


def test_limits_over_batches(spark, tmp_path):
    rng = random.Random(8)
    raw = Files(spark, tmp_path / "in", RAW)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    sent, want, used = [], {}, {}
    for batch in range(3):
        some = [
            (f"q{batch}-{i:03}", rng.choice(["hot"] * 5 + ["x", "y", None]), AS_OF + timedelta(seconds=rng.randrange(150)), f"b{i}")
            for i in range(200)
        ]
        sent += some
        raw.put(spark.createDataFrame(some, RAW))
        for q, key, at, _ in sorted(some, key=lambda r: (r[2], r[0])):
            slot = (key, at.replace(second=0))
            want[q] = key is None or used.get(slot, 0) >= 7
            used[slot] = used.get(slot, 0) + 1

        def keep(frame, version):
            frame.write.mode("overwrite").parquet(f"{out}/batch={version}")

        li.limited(raw.stream(), 7).writeStream.outputMode("update").foreachBatch(keep).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert {r.request_id: r.over_limit for r in got.collect()} == want
    assert rows(got, "request_id", "api_key", "received_at", "body") == rows(spark.createDataFrame(sent, RAW))


# ---------------------------------------------------------------- sketches


def exact(table, start, end):
    inside = table.filter((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))
    return inside.groupBy("organization_id").agg(F.count("*").alias("events"), F.count_distinct(F.get_json_object("payload", "$.user_id")).alias("n"))


def test_sketches_of_any_range(spark, tmp_path):
    rng = random.Random(5)
    made = [
        event(rng.choice(NAMES), ago(minutes=rng.randrange(60 * 24 * 40)), org="a" if i % 3 else "b", user_id=f"u{rng.randrange(9000)}")
        for i in range(12_000)
    ] + [event("x", AS_OF, org="none")]
    table = events(spark, made)
    path = str(tmp_path / "rollup")
    # In three batches that share minutes; one is written again.
    for n in (0, 1, 2, 1):
        ro.write_rollup(ro.minute_rollup(table.filter(F.expr(f"crc32(id) % 3 = {n}"))), path, n)
    rollup = ro.read_rollup(spark, path)
    spans = [(ago(days=d), ago(days=e)) for d, e in ((40, 0), (30, 3), (9, 2), (9, 8))]
    asked = spark.createDataFrame([(o, *s) for o in ("a", "b") for s in spans], "organization_id string, range_start timestamp, range_end timestamp")
    got = {(r.organization_id, r.range_start, r.range_end): r for r in ro.range_estimates(rollup, asked).collect()}
    assert len(got) == 8
    for low, high in spans:
        for r in exact(table, low, high).collect():
            if r.organization_id != "none":
                found = got[r.organization_id, local(low), local(high)]
                assert found.events == r.events
                assert abs(found.unique_visitors - r.n) <= ro.ERROR_BOUND * r.n
    # Wider buckets from narrower ones equal those from minutes.
    by_day = ro.rolled_up(ro.rolled_up(rollup, "hour"), "day")
    assert rows(ro.estimates(by_day)) == rows(ro.bucket_estimates(rollup, "day").withColumnRenamed("bucket", "minute"))
    assert [r.unique_visitors for r in ro.bucket_estimates(rollup, "day").filter("organization_id = 'none'").collect()] == [0]
    # A short range reads its months only.
    plan = ro.read_rollup(spark, path, ago(days=2), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "rollup_month" in plan.split("PartitionFilters")[1].split("]")[0]


# ---------------------------------------------------------------- inputs of the named queries


def test_parts_are_batches_of_many_files(spark, tmp_path):
    """A part of the input is written and read by many tasks and is one micro-batch."""
    table, read, path = spark.range(0, 4000, 1, 8), [], str(tmp_path)

    def start(stream):
        query = stream.writeStream.foreachBatch(lambda batch, n: read.append((n, batch.count())))
        query.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    live._in_turn(spark, path, {"in": table}, ["id % 4 < 3", "id % 4 = 3"], start)
    assert read == [(0, 3000), (1, 1000)]
    assert len(spark.read.parquet(f"{path}/in").inputFiles()) == 16

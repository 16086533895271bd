from datetime import timedelta

import pytest
from helpers import AS_OF, ago, event, events, local, rows, rule, rules
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventmetrics.functions.numbers import double_text
from eventmetrics.operators import alerts as al

LATER, EARLIER = AS_OF + timedelta(minutes=5), AS_OF - timedelta(minutes=5)

# state, muted_until, violated -> state after, mute kept, history
TRUTH = [
    ("Resolved", None, True, "Triggered", False, "Triggered"),
    ("Resolved", None, False, "Resolved", False, None),
    ("Triggered", None, True, "Triggered", False, None),
    ("Triggered", None, False, "Resolved", False, "Resolved"),
    ("Muted", LATER, True, "Muted", True, None),
    ("Muted", LATER, False, "Resolved", False, "Resolved"),
    ("Muted", EARLIER, True, "Triggered", False, "Triggered"),
    ("Muted", None, True, "Triggered", False, "Triggered"),
    ("Muted", EARLIER, False, "Resolved", False, None),
    ("Muted", AS_OF, False, "Resolved", False, None),
]


def values(spark, *pairs):
    return spark.createDataFrame(
        [(i, "org_a", float(v), True) for i, v in pairs],
        "alert_rule_id string, organization_id string, value double, is_known_metric boolean",
    )


def test_truth_table(spark):
    table = rules(
        spark, *[rule(id=f"r{i}", current_state=s, muted_until=m) for i, (s, m, *_) in enumerate(TRUTH)]
    )
    given_values = values(spark, *[(f"r{i}", 4 if t[2] else 3) for i, t in enumerate(TRUTH)])
    after, history = al.step(table, given_values, AS_OF)
    states = {r.id: (r.current_state, r.muted_until is not None) for r in after.collect()}
    written = {r.alert_rule_id: r.state for r in history.collect()}
    for i, (_, _, _, state, kept, wrote) in enumerate(TRUTH):
        assert states[f"r{i}"] == (state, kept), TRUTH[i]
        assert written.get(f"r{i}") == wrote, TRUTH[i]
    counts = al.sweep_counts(al.evaluate(table, given_values, AS_OF)).first()
    assert (counts.evaluated, counts.transitions) == (len(TRUTH), len(written))


def test_rules_without_value_stay(spark):
    table = rules(spark, rule(current_state="Muted", muted_until=EARLIER, is_enabled=False))
    after, history = al.step(table, values(spark, ("other", 9)), AS_OF)
    assert rows(after, "current_state") == [("Muted",)]
    assert rows(after, "muted_until") == [(local(EARLIER),)]
    assert history.isEmpty()


def test_operators(spark):
    cases = [(2.0, 3.0), (3.0, 3.0), (4.0, 3.0)]
    wanted = {
        ">": [False, False, True],
        "<": [True, False, False],
        ">=": [False, True, True],
        "<=": [True, True, False],
        "==": [False, True, False],
        "!=": [False, False, False],
        None: [False, False, False],
    }
    table = spark.createDataFrame(
        [(v, t, o) for o in wanted for v, t in cases], "v double, t double, o string"
    )
    found = {}
    for r in table.withColumn("x", al.violated(F.col("v"), F.col("t"), F.col("o"))).collect():
        found.setdefault(r.o, []).append(r.x)
    assert found == wanted


def test_trigger_snooze_and_recovery(spark):
    """Errors trigger, a snooze silences, recovery clears the snooze."""
    burst = events(spark, [event("error", ago(minutes=2)) for _ in range(4)])
    table = rules(spark, rule(email_recipient="ops@example.com", slack_webhook="https://hooks.example.com/x"))
    found = al.alert_values(burst, table, AS_OF)
    assert rows(found, "value", "is_known_metric") == [(4.0, True)]
    triggered, history = al.step(table, found, AS_OF)
    assert rows(triggered, "current_state") == [("Triggered",)]
    assert rows(history, "state", "value", "threshold") == [("Triggered", 4.0, 3.0)]
    asked = spark.createDataFrame(
        [("org_a", "r1", 30), ("org_b", "r1", 60)],
        "organization_id string, alert_rule_id string, snooze_minutes int",
    )
    muted, audit = al.snooze(triggered, asked, AS_OF)
    assert rows(muted, "current_state", "muted_until") == [("Muted", local(AS_OF + timedelta(minutes=30)))]
    assert rows(audit, "state", "value") == [("Muted", 0.0)]
    assert audit.first().details == (
        '{"action":"manual_snooze","snooze_minutes":30,"muted_until":"2026-05-21T12:30:00+00:00"}'
    )
    silent, none = al.step(muted, found, AS_OF)
    assert rows(silent, "current_state") == [("Muted",)] and none.isEmpty()
    later = AS_OF + timedelta(minutes=13)
    calm = al.alert_values(burst, silent, later)
    assert rows(calm, "value") == [(0.0,)]
    healthy, closing = al.step(silent, calm, later)
    assert rows(healthy, "current_state", "muted_until") == [("Resolved", None)]
    assert rows(closing, "state", "value") == [("Resolved", 0.0)]


def test_message_texts(spark):
    table = rules(
        spark,
        rule(email_recipient="ops@example.com"),
        rule(id="r2", name="Slow", slack_webhook="https://hooks.example.com/x", current_state="Triggered"),
        rule(id="r3"),
    )
    evaluated = al.evaluate(table, values(spark, ("r1", 4), ("r2", 1), ("r3", 20000000)), AS_OF)
    found = {r.id: r for r in al.with_messages(evaluated).collect()}
    assert found["r1"].email_draft.subject == "🚨 ALERT TRIGGERED: Errors"
    assert found["r1"].email_draft.body == (
        "Alert Rule 'Errors' has been triggered!\n\nOrganization ID: org_a\n"
        "Metric Evaluated: error_count\nViolation Parameters: > 3.0\nCurrent Value Recorded: 4.0\n"
        "Evaluation Timeframe: Last 10 minutes\n\nPlease review your dashboard for live logs."
    )
    assert found["r1"].slack_payload is None
    assert found["r2"].email_draft is None
    assert found["r2"].slack_payload.text == "✅ Alert *Slow* resolved! Value: 1.0"
    assert found["r2"].slack_payload.blocks[0].text.type == "mrkdwn"
    history = {r.alert_rule_id: r.details for r in al.transitions(evaluated, AS_OF).collect()}
    assert history["r3"] == "{}"
    frames = al.alert_frames(al.transitions(evaluated, AS_OF), table)
    assert (
        '{"type":"alert","data":{"rule_id":"r1","rule_name":"Errors","organization_id":"org_a",'
        '"state":"Triggered","metric_type":"error_count","value":4.0,"threshold":3.0,'
        '"timestamp":"2026-05-21T12:00:00+00:00"}}'
    ) in [r.frame for r in frames.collect()]


def brute_force(history, minutes):
    """Metrics of one tenant's lookback, from plain tuples (age in minutes, name, session, visitor)."""
    inside = [e for e in history if e[0] <= minutes]
    sessions = {}
    for age, _, session, _ in inside:
        if session is not None:
            sessions.setdefault(session, []).append(age)
    errors = sum(e[1] == "error" for e in inside)
    return {
        "page_views": sum(e[1] in ("page_view", "page.view") for e in inside),
        "error_count": errors,
        "error_rate": 100 * errors / len(inside) if inside else 0.0,
        "unique_visitors": len({e[3] for e in inside if e[3] is not None}),
        "bounce_rate": 100 * sum(len(a) == 1 for a in sessions.values()) / len(sessions) if sessions else 0.0,
        "avg_session_duration": sum((max(a) - min(a)) * 60 for a in sessions.values()) / len(sessions)
        if sessions
        else 0.0,
        "latency": 0.0,
    }


one_event = st.tuples(
    st.integers(0, 130),
    st.sampled_from(["page_view", "page.view", "error", "click"]),
    st.sampled_from([None, "s1", "s2", "s3"]),
    st.sampled_from([None, "v1", "v2"]),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(one_event, max_size=25), st.lists(st.sampled_from([1, 10, 30, 60, 120]), min_size=1, unique=True))
def test_lookbacks_equal_brute_force(spark, history, windows):
    table = events(
        spark,
        [event(n, ago(minutes=a), session_id=s, user_id=v) for a, n, s, v in history]
        + [event("error", ago(minutes=1), org="org_b")],
    )
    metrics = [*al.RULE_METRICS, "latency"]
    all_rules = rules(
        spark,
        *[rule(id=f"{m}:{w}", metric_type=m, time_window_minutes=w) for m in metrics for w in windows],
        rule(id="off", is_enabled=False),
        rule(id="gone", is_deleted=True),
    )
    found = {r.alert_rule_id: r for r in al.alert_values(table, all_rules, AS_OF).collect()}
    assert len(found) == len(metrics) * len(windows)
    for w in windows:
        wanted = brute_force(history, w)
        for m in metrics:
            assert found[f"{m}:{w}"].value == pytest.approx(wanted[m]), (m, w)
            assert found[f"{m}:{w}"].is_known_metric == (m != "latency")


def fold(state, until, inputs):
    """The state machine one input after the other."""
    out = []
    for at, kind, payload in inputs:
        before, wrote = state, None
        if kind == "snooze":
            state, until, wrote = "Muted", at + payload, "Muted"
        else:
            broken = payload > 3
            live = state == "Muted" and until is not None and until > at
            if state == "Muted" and not live:
                state, until = "Resolved", None
            if broken and not live and state != "Triggered":
                state, wrote = "Triggered", "Triggered"
            elif not broken and state in ("Triggered", "Muted"):
                state, until, wrote = "Resolved", None, "Resolved"
        out.append((at, before, state, wrote))
    return out


one_input = st.tuples(st.integers(0, 40), st.sampled_from(["tick", "tick", "snooze"]), st.integers(1, 8))


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(one_input, min_size=1, max_size=25, unique_by=lambda x: (x[0], x[1])),
    st.sampled_from([("Resolved", None), ("Triggered", None), ("Muted", 10), ("Muted", None)]),
)
def test_replay_equals_fold(spark, inputs, start):
    state, until = start
    inputs = sorted(inputs, key=lambda x: (x[0], x[1] == "tick"))

    def at(minute):
        return AS_OF + timedelta(minutes=minute)

    table = rules(spark, rule(current_state=state, muted_until=None if until is None else at(until)))
    ticks = [("r1", at(a), float(v)) for a, k, v in inputs if k == "tick"]
    snoozes = [("r1", at(a), v) for a, k, v in inputs if k == "snooze"]
    found = al.replay(
        table,
        spark.createDataFrame(ticks, "alert_rule_id string, at timestamp, value double"),
        spark.createDataFrame(snoozes, "alert_rule_id string, at timestamp, snooze_minutes int"),
    ).orderBy("at", "is_tick")
    got = [(r["at"], r.state_before, r.state_after, r.history) for r in found.collect()]
    wanted = [(local(at(a)), b, s, h) for a, b, s, h in fold(state, until, inputs)]
    assert got == wanted


def test_equal_to_an_exact_duration(spark):
    """A session of 0.64001 s meets a rule that asks for just that."""
    visit = events(
        spark,
        [event("page_view", ago(minutes=5), session_id="s"), event("click", ago(minutes=5) + timedelta(microseconds=640010), session_id="s")],
    )
    table = rules(spark, rule(metric_type="avg_session_duration", operator="==", threshold=0.64001, time_window_minutes=10))
    values = al.alert_values(visit, table, AS_OF)
    assert values.first().value == 0.64001
    assert rows(al.transitions(al.evaluate(table, values, AS_OF), AS_OF), "state") == [("Triggered",)]


def test_number_texts(spark):
    numbers = [0.0005, 12345678.9, 5.0, 0.0, -0.0, 1e16, 1e-5, 1.5e-7, 123456789012345.6, 0.1, 1 / 3, 2e300, -0.00012345678901234567]
    frame = spark.createDataFrame([(n,) for n in numbers], "n double")
    assert [r.t for r in frame.select(double_text(frame.n).alias("t")).collect()] == [repr(n) for n in numbers]

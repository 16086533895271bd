"""Alert rules: metric values over lookback windows, thresholds, states, messages."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmetrics.functions.dates import MICROS, iso_text, mean_seconds, micros_between, moment
from eventmetrics.functions.numbers import double_text, percent
from eventmetrics.functions.payload import with_identity
from eventmetrics.operators.overview import keyed_rows
from eventmetrics.operators.panes import combined
from eventmetrics.operators.scope import active, between, page

# Metrics a rule may watch, states, and the message texts.
RULE_METRICS = (
    "page_views",
    "error_count",
    "error_rate",
    "unique_visitors",
    "bounce_rate",
    "avg_session_duration",
)
RESOLVED, TRIGGERED, MUTED = "Resolved", "Triggered", "Muted"
RECENT = 15

EMAIL_TRIGGER_SUBJECT = "🚨 ALERT TRIGGERED: %s"
EMAIL_TRIGGER_BODY = (
    "Alert Rule '%s' has been triggered!\n\n"
    "Organization ID: %s\n"
    "Metric Evaluated: %s\n"
    "Violation Parameters: %s %s\n"
    "Current Value Recorded: %s\n"
    "Evaluation Timeframe: Last %s minutes\n\n"
    "Please review your dashboard for live logs."
)
EMAIL_RESOLVE_SUBJECT = "✅ ALERT RESOLVED: %s"
EMAIL_RESOLVE_BODY = (
    "Alert Rule '%s' has recovered to healthy parameters.\n\n"
    "Organization ID: %s\n"
    "Metric Evaluated: %s\n"
    "Current Value Recorded: %s (healthy)\n\n"
    "Thank you."
)
CHAT_TRIGGER_TEXT = "🚨 Alert *%s* triggered! Value: %s (threshold: %s)"
CHAT_TRIGGER_BLOCK = (
    "🚨 *Alert Triggered: %s*\n"
    "*Org ID*: `%s`\n"
    "*Metric*: `%s`\n"
    "*Operator*: `%s`\n"
    "*Threshold*: `%s`\n"
    "*Current Value*: *%s*\n"
    "*Lookback Window*: `%s mins`"
)
CHAT_RESOLVE_TEXT = "✅ Alert *%s* resolved! Value: %s"
CHAT_RESOLVE_BLOCK = (
    "✅ *Alert Resolved: %s*\n"
    "*Org ID*: `%s`\n"
    "*Metric*: `%s`\n"
    "*Current Value*: *%s* (healthy)"
)


Totals = Callable[[DataFrame, DataFrame, datetime | Column], DataFrame]


def enabled_rules(rules: DataFrame) -> DataFrame:
    return active(rules).filter("is_enabled")


def _nested_windows(windows: DataFrame) -> tuple[DataFrame, Column]:
    """Each tenant's lookbacks as a sorted list ``_windows``, and the widest one of all in minutes."""
    per_org = windows.groupBy("organization_id").agg(
        F.array_sort(F.collect_set(F.col("time_window_minutes").cast("bigint"))).alias("_windows")
    )
    return per_org, windows.agg(F.max("time_window_minutes")).scalar().cast("bigint")


def _band(age: Column) -> Column:
    """The smallest window that reaches back ``age`` microseconds."""
    return F.try_element_at(F.filter("_windows", lambda w: w * (60 * MICROS) >= age), F.lit(1))


def lookback_totals(events: DataFrame, windows: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Metrics of every (tenant, lookback) pair; ``windows`` holds distinct pairs.

    All lookbacks end at ``as_of``, so a tenant's windows are nested. Each
    event is put once into its band, the smallest window containing it, and
    windows are running totals over bands. The work is therefore one pass over
    the events, not one per rule or window.
    """
    now = moment(as_of)
    per_org, widest = _nested_windows(windows)
    earliest = F.timestamp_micros(F.unix_micros(now) - widest * 60 * MICROS)
    banded = (
        with_identity(between(events, earliest, now))
        .join(per_org, "organization_id")
        .withColumn("time_window_minutes", _band(F.unix_micros(now) - F.unix_micros("timestamp")))
        .filter(F.col("time_window_minutes").isNotNull())
    )
    return _window_totals(keyed_rows(banded, ["organization_id", "time_window_minutes"]), windows)


def lookback_totals_of_panes(panes: DataFrame, windows: DataFrame, as_of: datetime | Column) -> DataFrame:
    """``lookback_totals`` from the panes of ``operators.panes`` instead of events, at a whole minute.

    A pane lies in a band as a whole: windows end and begin at whole minutes,
    and of the minute that starts at ``as_of`` only the edge counts. Panes of
    one minute may be in several parts, as they were written.
    """
    now = F.date_trunc("minute", moment(as_of))
    per_org, widest = _nested_windows(windows)
    earliest = F.timestamp_micros(F.unix_micros(now) - widest * 60 * MICROS)
    inside = panes.filter(F.col("minute").between(earliest, now) & ((F.col("minute") < now) | F.col("on_edge")))
    if "pane_day" in panes.columns:
        inside = inside.filter(F.col("pane_day").between(F.to_date(earliest), F.to_date(now)))
    banded = (
        inside.join(per_org, "organization_id")
        .withColumn("time_window_minutes", _band(F.unix_micros(now) - F.unix_micros("minute")))
        .filter(F.col("time_window_minutes").isNotNull())
    )
    return _window_totals(combined(banded, ["organization_id", "time_window_minutes"]), windows)


def _window_totals(keyed: DataFrame, windows: DataFrame) -> DataFrame:
    """Running totals over bands, from one row per band and session or visitor.

    Sessions and visitors are not additive, but their changes are: a visitor
    counts from their first band on; a session counts as bounced from its
    first band until it has a second event; its duration grows by the
    distance between the oldest events of two bands.
    """
    keys = ["organization_id", "is_session", "session_id", "visitor_id"]
    newest_first = Window.partitionBy(*keys).orderBy("time_window_minutes")
    so_far = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = keyed.withColumns(
        {
            "_nth": F.row_number().over(newest_first),
            "_seen": F.sum("events").over(so_far),
            "_newer_oldest": F.lag("first_ts").over(newest_first),
        }
    )
    first = F.col("_nth") == 1
    session = F.col("is_session") & F.col("session_id").isNotNull()
    visitor = ~F.col("is_session")
    one_before = (F.col("_seen") - F.col("events")) == 1
    bounce_change = F.when(first & (F.col("events") == 1), 1).when(~first & one_before, -1)
    growth = micros_between(F.col("first_ts"), F.coalesce("_newer_oldest", "last_ts"))
    changes = grown.groupBy("organization_id", "time_window_minutes").agg(
        F.sum(F.when(visitor, F.col("events"))).alias("events"),
        F.sum(F.when(visitor, F.col("page_views"))).alias("page_views"),
        F.sum(F.when(visitor, F.col("errors"))).alias("errors"),
        F.count_if(visitor & F.col("visitor_id").isNotNull() & first).alias("visitors"),
        F.count_if(session & first).alias("sessions"),
        F.sum(F.when(session, bounce_change)).alias("bounced"),
        F.sum(F.when(session, growth)).alias("micros"),
    )
    measures = ["events", "page_views", "errors", "visitors", "sessions", "bounced", "micros"]
    pairs = windows.select(
        "organization_id", F.col("time_window_minutes").cast("bigint").alias("time_window_minutes")
    )
    upto = (
        Window.partitionBy("organization_id")
        .orderBy("time_window_minutes")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = (
        pairs.join(changes, ["organization_id", "time_window_minutes"], "left")
        .fillna(0, subset=measures)
        .withColumns({m: F.sum(m).over(upto) for m in measures})
    )
    return summed.select(
        "organization_id",
        "time_window_minutes",
        F.col("page_views").cast("double").alias("page_views"),
        F.col("errors").cast("double").alias("error_count"),
        percent(F.col("errors"), F.col("events")).alias("error_rate"),
        F.col("visitors").cast("double").alias("unique_visitors"),
        percent(F.col("bounced"), F.col("sessions")).alias("bounce_rate"),
        F.coalesce(mean_seconds(F.col("micros"), F.col("sessions")), F.lit(0.0)).alias("avg_session_duration"),
    )


def alert_values(
    events: DataFrame, rules: DataFrame, as_of: datetime | Column, totals: Totals = lookback_totals
) -> DataFrame:
    """Current value of each enabled rule's metric over its own lookback.

    ``totals`` is ``lookback_totals`` of events, or that of panes for panes. A rule without events gets 0.0, and so does one with an unknown metric,
    which ``is_known_metric`` marks.
    """
    live = enabled_rules(rules)
    pairs = live.select("organization_id", "time_window_minutes").distinct()
    measured = totals(events, pairs, as_of)
    metric = F.col("metric_type")
    value = F.lit(0.0)
    for name in RULE_METRICS:
        value = F.when(metric == name, F.col(name)).otherwise(value)
    return (
        live.select(
            F.col("id").alias("alert_rule_id"),
            "organization_id",
            "metric_type",
            F.col("time_window_minutes").cast("bigint").alias("time_window_minutes"),
        )
        .join(measured, ["organization_id", "time_window_minutes"], "left")
        .select(
            "alert_rule_id",
            "organization_id",
            F.coalesce(value, F.lit(0.0)).alias("value"),
            metric.isin(*RULE_METRICS).alias("is_known_metric"),
        )
    )


def violated(value: Column, threshold: Column, operator: Column) -> Column:
    """Compare by operator text; an unknown operator never violates."""
    return F.coalesce(
        F.when(operator == ">", value > threshold)
        .when(operator == "<", value < threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "==", value == threshold),
        F.lit(False),
    )


def evaluate(rules: DataFrame, values: DataFrame, as_of: datetime | Column) -> DataFrame:
    """One sweep: rules with ``value``, ``state_after``, ``mute_after`` and ``transition``.

    ``transition`` is the state written to the history, NULL when there is
    none. A rule without a value (disabled or deleted) stays as it is.
    """
    now = moment(as_of)
    state, until = F.col("current_state"), F.col("muted_until")
    muted = state == MUTED
    live = muted & F.coalesce(until > now, F.lit(False))
    judged = F.col("value").isNotNull()
    broken = violated(F.col("value"), F.col("threshold"), F.col("operator"))
    # An expired mute silently becomes Resolved before the value is judged.
    before = F.when(muted & ~live, F.lit(RESOLVED)).otherwise(state)
    transition = F.when(broken & ~live & (before != TRIGGERED), F.lit(TRIGGERED)).when(
        ~broken & before.isin(TRIGGERED, MUTED), F.lit(RESOLVED)
    )
    clears_mute = (muted & ~live) | F.coalesce(F.col("transition") == RESOLVED, F.lit(False))
    return (
        rules.join(
            values.select(F.col("alert_rule_id").alias("id"), "value", "is_known_metric"), "id", "left"
        )
        .withColumn("transition", F.when(judged, transition))
        .withColumn(
            "state_after",
            F.when(~judged, state).otherwise(F.coalesce(F.col("transition"), before)),
        )
        .withColumn("mute_after", F.when(~judged | ~clears_mute, until))
    )


def next_rules(evaluated: DataFrame, columns: list[str]) -> DataFrame:
    """The rules table after a sweep."""
    return evaluated.withColumns(
        {"current_state": F.col("state_after"), "muted_until": F.col("mute_after")}
    ).select(*columns)


def transitions(evaluated: DataFrame, as_of: datetime | Column) -> DataFrame:
    """History rows of a sweep: only rules that changed, with message drafts as details."""
    changed = evaluated.filter(F.col("transition").isNotNull())
    return with_messages(changed).select(
        F.col("id").alias("alert_rule_id"),
        "organization_id",
        F.col("transition").alias("state"),
        "value",
        "threshold",
        F.to_json(
            F.struct(
                F.col("email_draft"),
                F.when(
                    F.col("slack_payload").isNotNull(),
                    F.struct(
                        F.col("slack_webhook").alias("webhook"),
                        F.col("slack_payload").alias("payload"),
                    ),
                ).alias("slack_notification"),
            )
        ).alias("details"),
        moment(as_of).alias("created_at"),
    )


def step(
    rules: DataFrame, values: DataFrame, as_of: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """One sweep as (rules after, history rows). Write ``values`` first if both are used."""
    evaluated = evaluate(rules, values, as_of)
    return next_rules(evaluated, rules.columns), transitions(evaluated, as_of)


def list_history(histories: DataFrame, org: str, skip: int = 0, limit: int = RECENT) -> DataFrame:
    """One tenant's history, newest first."""
    rows = histories.filter(F.col("organization_id") == org)
    return page(rows, F.desc("created_at"), F.asc("alert_rule_id"), skip=skip, limit=limit)


def sweep_counts(evaluated: DataFrame) -> DataFrame:
    """Rules evaluated and transitions made in a sweep."""
    return evaluated.agg(
        F.count("value").alias("evaluated"), F.count("transition").alias("transitions")
    )


def with_messages(changed: DataFrame) -> DataFrame:
    """Add ``email_draft`` and ``slack_payload`` where the rule names a receiver."""
    fired = F.col("transition") == TRIGGERED
    value, threshold = double_text(F.col("value")), double_text(F.col("threshold"))
    name, org, metric = F.col("name"), F.col("organization_id"), F.col("metric_type")
    operator, minutes = F.col("operator"), F.col("time_window_minutes")

    def either(on_trigger: Column, on_resolve: Column) -> Column:
        return F.when(fired, on_trigger).otherwise(on_resolve)

    subject = either(
        F.format_string(EMAIL_TRIGGER_SUBJECT, name), F.format_string(EMAIL_RESOLVE_SUBJECT, name)
    )
    body = either(
        F.format_string(EMAIL_TRIGGER_BODY, name, org, metric, operator, threshold, value, minutes),
        F.format_string(EMAIL_RESOLVE_BODY, name, org, metric, value),
    )
    text = either(
        F.format_string(CHAT_TRIGGER_TEXT, name, value, threshold),
        F.format_string(CHAT_RESOLVE_TEXT, name, value),
    )
    block = either(
        F.format_string(CHAT_TRIGGER_BLOCK, name, org, metric, operator, threshold, value, minutes),
        F.format_string(CHAT_RESOLVE_BLOCK, name, org, metric, value),
    )
    email = F.struct(
        F.col("email_recipient").alias("recipient"), subject.alias("subject"), body.alias("body")
    )
    chat = F.struct(
        text.alias("text"),
        F.array(
            F.struct(
                F.lit("section").alias("type"),
                F.struct(F.lit("mrkdwn").alias("type"), block.alias("text")).alias("text"),
            )
        ).alias("blocks"),
    )

    def given(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) != ""

    return changed.withColumns(
        {
            "email_draft": F.when(given("email_recipient"), email),
            "slack_payload": F.when(given("slack_webhook"), chat),
        }
    )


def alert_frames(history: DataFrame, rules: DataFrame) -> DataFrame:
    """Live feed frames for history rows, as (organization_id, ts, frame JSON)."""
    named = rules.select(
        F.col("id").alias("alert_rule_id"), F.col("name").alias("rule_name"), "metric_type"
    )
    data = F.struct(
        F.col("alert_rule_id").alias("rule_id"),
        "rule_name",
        "organization_id",
        "state",
        "metric_type",
        "value",
        "threshold",
        iso_text(F.col("created_at")).alias("timestamp"),
    )
    return history.join(named, "alert_rule_id").select(
        "organization_id",
        F.col("created_at").alias("timestamp"),
        F.to_json(F.struct(F.lit("alert").alias("type"), data.alias("data"))).alias("frame"),
    )


def snooze(
    rules: DataFrame, snoozes: DataFrame, as_of: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """Mute rules; ``snoozes`` has (organization_id, alert_rule_id, snooze_minutes).

    A mute starts at ``requested_at`` where that column is given, else at
    ``as_of``; the last request of a rule wins. A tenant can only mute its own
    rules.
    """
    now = moment(as_of)
    asked_at = F.col("requested_at") if "requested_at" in snoozes.columns else now
    asked = (
        snoozes.groupBy("organization_id", F.col("alert_rule_id").alias("id"))
        .agg(F.max(F.struct(asked_at.alias("at"), F.col("snooze_minutes").alias("minutes"))).alias("_ask"))
        .select("organization_id", "id", F.col("_ask.at").alias("_at"), F.col("_ask.minutes").alias("_minutes"))
    )
    until = F.timestamp_micros(
        F.unix_micros("_at") + F.col("_minutes").cast("bigint") * (60 * MICROS)
    )
    hit = F.col("_minutes").isNotNull() & ~F.col("is_deleted")
    joined = rules.join(asked, ["organization_id", "id"], "left")
    after = joined.withColumns(
        {
            "current_state": F.when(hit, F.lit(MUTED)).otherwise(F.col("current_state")),
            "muted_until": F.when(hit, until).otherwise(F.col("muted_until")),
        }
    ).select(*rules.columns)
    details = F.to_json(
        F.struct(
            F.lit("manual_snooze").alias("action"),
            F.col("_minutes").alias("snooze_minutes"),
            iso_text(until).alias("muted_until"),
        )
    )
    history = joined.filter(hit).select(
        F.col("id").alias("alert_rule_id"),
        "organization_id",
        F.lit(MUTED).alias("state"),
        F.lit(0.0).alias("value"),
        "threshold",
        details.alias("details"),
        F.col("_at").alias("created_at"),
    )
    return after, history


def replay(rules: DataFrame, ticks: DataFrame, snoozes: DataFrame | None = None) -> DataFrame:
    """States of every rule over many sweeps at once.

    ``ticks`` has (alert_rule_id, at, value) per sweep, ``snoozes``
    (alert_rule_id, at, snooze_minutes); a snooze at the time of a sweep comes
    first. No fold is needed: an unmuted rule is Triggered exactly while its
    value violates, and a mute lasts from its snooze until the first sweep
    that is healthy or past its end. Windows hold one rule's sweeps, whose
    number is given by the calendar and the same for every rule.
    """
    inputs = ticks.select(
        "alert_rule_id",
        "at",
        F.lit(1).alias("is_tick"),
        F.col("value").cast("double").alias("value"),
        F.lit(None).cast("timestamp").alias("until"),
    )
    if snoozes is not None:
        until = F.timestamp_micros(
            F.unix_micros(F.col("at")) + F.col("snooze_minutes").cast("bigint") * (60 * MICROS)
        )
        inputs = inputs.unionByName(
            snoozes.select(
                "alert_rule_id",
                "at",
                F.lit(0).alias("is_tick"),
                F.lit(None).cast("double").alias("value"),
                until.alias("until"),
            )
        )
    known = rules.select(
        F.col("id").alias("alert_rule_id"),
        "organization_id",
        "operator",
        "threshold",
        F.col("current_state").alias("_state0"),
        F.col("muted_until").alias("_until0"),
    )
    in_order = Window.partitionBy("alert_rule_id").orderBy("at", "is_tick")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tick = F.col("is_tick") == 1
    numbered = inputs.join(known, "alert_rule_id").withColumns(
        {
            "violated": F.when(tick, violated(F.col("value"), F.col("threshold"), F.col("operator"))),
            "_mute": F.sum(1 - F.col("is_tick")).over(so_far),
            "_last_until": F.last("until", ignorenulls=True).over(so_far),
        }
    )
    mute_so_far = (
        Window.partitionBy("alert_rule_id", "_mute")
        .orderBy("at", "is_tick")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    was_muted = (F.col("_mute") > 0) | (F.col("_state0") == MUTED)
    mute_end = F.when(F.col("_mute") > 0, F.col("_last_until")).otherwise(F.col("_until0"))
    live = was_muted & F.coalesce(F.col("at") < mute_end, F.lit(False))
    healthy_seen = F.max(F.when(tick & ~F.col("violated"), 1).otherwise(0)).over(mute_so_far)
    state = (
        F.when(~tick, F.lit(MUTED))
        .when(F.col("_live") & (F.col("_healthy") == 0), F.lit(MUTED))
        .when(F.col("violated"), F.lit(TRIGGERED))
        .otherwise(F.lit(RESOLVED))
    )
    before = F.coalesce(F.lag("state_after").over(in_order), F.col("_state0"))
    history = (
        F.when(~tick, F.lit(MUTED))
        .when((F.col("state_after") == TRIGGERED) & (F.col("state_before") != TRIGGERED), F.lit(TRIGGERED))
        .when(
            (F.col("state_after") == RESOLVED)
            & (
                (F.col("state_before") == TRIGGERED)
                | ((F.col("state_before") == MUTED) & F.col("_live"))
            ),
            F.lit(RESOLVED),
        )
    )
    return (
        numbered.withColumns({"_live": live, "_healthy": healthy_seen})
        .withColumn("state_after", state)
        .withColumn("state_before", before)
        .withColumn("history", history)
        .select(
            "alert_rule_id",
            "organization_id",
            "at",
            tick.alias("is_tick"),
            "value",
            "violated",
            "state_before",
            "state_after",
            "history",
        )
    )

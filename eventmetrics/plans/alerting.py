"""Alert sweeps, replays, snoozes and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventmetrics.functions.dates import bucket
from eventmetrics.operators import alerts as al
from eventmetrics.operators.scope import scope
from eventmetrics.operators.series import all_metric_points
from eventmetrics.plans.analytics import points_sql
from eventmetrics.plans.common import AS_OF, EV, FIRST, RULES, plain, r6
from eventmetrics.sources import sample


def _sweep(spark, sf_dir):
    rules = sample.alert_rules(spark, sf_dir)
    values = al.alert_values(sample.events(spark, sf_dir), rules, AS_OF)
    return al.evaluate(rules, values, AS_OF)


def alert_values(spark, sf_dir):
    rules = sample.alert_rules(spark, sf_dir)
    return plain(al.alert_values(sample.events(spark, sf_dir), rules, AS_OF))


def alert_states(spark, sf_dir):
    rules = al.next_rules(_sweep(spark, sf_dir), ["id", "organization_id", "current_state", "muted_until"])
    return plain(rules)


def alert_transitions(spark, sf_dir):
    changed = _sweep(spark, sf_dir).filter(F.col("transition").isNotNull())
    return plain(changed.select("id", "organization_id", "transition", "value", "threshold"))


def alert_messages(spark, sf_dir):
    # Averages have digits in which the two engines differ; messages print rounded ones here.
    changed = _sweep(spark, sf_dir).filter(F.col("transition").isNotNull())
    drafted = al.with_messages(plain(changed))
    draft, chat = F.col("email_draft"), F.col("slack_payload")
    return drafted.select(
        "id",
        draft["recipient"].alias("recipient"),
        draft["subject"].alias("subject"),
        draft["body"].alias("body"),
        chat["text"].alias("chat_text"),
        chat["blocks"][0]["text"]["text"].alias("chat_block"),
    )


def alert_history(spark, sf_dir):
    """The rows a sweep appends; details are JSON."""
    history = al.transitions(_sweep(spark, sf_dir), AS_OF)
    return plain(
        history.select(
            "alert_rule_id",
            "organization_id",
            "state",
            "created_at",
            F.get_json_object("details", "$.email_draft.recipient").alias("recipient"),
            F.get_json_object("details", "$.slack_notification.webhook").alias("webhook"),
        )
    )


def alert_sweep_counts(spark, sf_dir):
    return al.sweep_counts(_sweep(spark, sf_dir))


def alert_feed(spark, sf_dir):
    rules = sample.alert_rules(spark, sf_dir)
    frames = al.alert_frames(al.transitions(_sweep(spark, sf_dir), AS_OF), rules)
    data = F.from_json(
        "frame",
        "type string, data struct<rule_id string, rule_name string, state string, "
        "metric_type string, threshold double, timestamp string>",
    )
    return frames.select("organization_id", data.alias("f")).select(
        "organization_id", "f.type", "f.data.*"
    )


def alert_snooze(spark, sf_dir):
    """Every triggered rule is snoozed by its own number of minutes."""
    rules = sample.alert_rules(spark, sf_dir)
    asked = rules.filter(F.col("current_state") == "Triggered").select(
        "organization_id",
        F.col("id").alias("alert_rule_id"),
        F.col("time_window_minutes").alias("snooze_minutes"),
    )
    after, _ = al.snooze(rules, asked, AS_OF)
    return plain(after.select("id", "current_state", "muted_until"))


def alert_snooze_history(spark, sf_dir):
    rules = sample.alert_rules(spark, sf_dir)
    asked = rules.filter(F.col("current_state") == "Triggered").select(
        "organization_id",
        F.col("id").alias("alert_rule_id"),
        F.col("time_window_minutes").alias("snooze_minutes"),
    )
    _, history = al.snooze(rules, asked, AS_OF)
    return plain(history)


def _ticks(spark, sf_dir):
    """One sweep per day: the day's value of each rule's metric, where it has a series."""
    daily = scope(sample.events(spark, sf_dir), FIRST, AS_OF).withColumn("at", bucket("day"))
    points = all_metric_points(daily, ["organization_id", "at"])
    rules = sample.alert_rules(spark, sf_dir)
    ticks = rules.select(
        F.col("id").alias("alert_rule_id"), "organization_id", F.col("metric_type").alias("metric")
    ).join(points, ["organization_id", "metric"])
    return rules, ticks


def alert_replay(spark, sf_dir):
    """Without mutes: every rule starts resolved."""
    rules, ticks = _ticks(spark, sf_dir)
    rules = rules.withColumns(
        {"current_state": F.lit("Resolved"), "muted_until": F.lit(None).cast("timestamp")}
    )
    replayed = al.replay(rules, ticks)
    return plain(replayed.select("alert_rule_id", "at", "state_after", "history"))


def muted_replay_inputs(spark, sf_dir):
    """Rules in their stored states, a tick a day, and snoozes of 5 days at noon of the second and fifteenth day."""
    rules, ticks = _ticks(spark, sf_dir)
    noon = F.array(*[F.lit(f"2024-01-{d} 12:00:00").cast("timestamp") for d in ("02", "15")])
    snoozes = rules.select(
        F.col("id").alias("alert_rule_id"), F.explode(noon).alias("at"), F.lit(7200).alias("snooze_minutes")
    )
    return rules, ticks, snoozes


def alert_replay_muted(spark, sf_dir):
    replayed = al.replay(*muted_replay_inputs(spark, sf_dir))
    return plain(
        replayed.select("alert_rule_id", "at", "is_tick", "state_before", "state_after", "history")
    )


def alert_history_page(spark, sf_dir):
    """The newest history rows of one tenant."""
    history = al.transitions(_sweep(spark, sf_dir), AS_OF)
    return plain(al.list_history(history, "org_1").select("alert_rule_id", "state", "created_at"))


QUERIES = {
    "alert_values": alert_values,
    "alert_states": alert_states,
    "alert_transitions": alert_transitions,
    "alert_history": alert_history,
    "alert_messages": alert_messages,
    "alert_sweep_counts": alert_sweep_counts,
    "alert_feed": alert_feed,
    "alert_history_page": alert_history_page,
    "alert_snooze": alert_snooze,
    "alert_snooze_history": alert_snooze_history,
    "alert_replay": alert_replay,
    "alert_replay_muted": alert_replay_muted,
}

# The plain way: each distinct (tenant, lookback) joined to its events.
LIVE_RULES = "live AS (SELECT * FROM rules WHERE is_enabled AND NOT is_deleted)"
SWEEP_VALUES = """w AS (SELECT DISTINCT organization_id, time_window_minutes FROM live),
  base AS (SELECT w.time_window_minutes, e.* FROM ev e JOIN w USING (organization_id)
           WHERE e.ts <= TIMESTAMP '2024-01-31'
             AND e.ts >= TIMESTAMP '2024-01-31' - to_minutes(cast(w.time_window_minutes AS bigint))),
  tot AS (SELECT organization_id, time_window_minutes, count(*) AS n,
                 count(*) FILTER (event_name IN ('page_view', 'page.view')) AS page_views,
                 count(*) FILTER (event_name = 'error') AS error_count,
                 count(DISTINCT visitor_id) AS unique_visitors FROM base GROUP BY ALL),
  ses AS (SELECT organization_id, time_window_minutes, session_id, count(*) AS n,
                 date_diff('microsecond', min(ts), max(ts)) / 1e6 AS secs FROM base GROUP BY ALL),
  sa AS (SELECT organization_id, time_window_minutes,
                cast(count(*) FILTER (n = 1) AS double) * 100 / count(*) AS bounce_rate,
                avg(secs) AS avg_session_duration FROM ses GROUP BY ALL),
  vals AS (SELECT r.id AS alert_rule_id, r.organization_id,
             coalesce(CASE metric_type WHEN 'page_views' THEN cast(page_views AS double)
               WHEN 'error_count' THEN cast(error_count AS double)
               WHEN 'error_rate' THEN cast(error_count AS double) * 100 / n
               WHEN 'unique_visitors' THEN cast(unique_visitors AS double)
               WHEN 'bounce_rate' THEN bounce_rate
               WHEN 'avg_session_duration' THEN avg_session_duration END, 0.0e0) AS value,
             metric_type <> 'latency' AS is_known_metric
           FROM live r LEFT JOIN tot USING (organization_id, time_window_minutes)
           LEFT JOIN sa USING (organization_id, time_window_minutes))"""
VALUES = f"{EV}, {RULES}, {LIVE_RULES}, {SWEEP_VALUES}"

VIOLATED = (
    "CASE operator WHEN '>' THEN {v} > {t} WHEN '<' THEN {v} < {t} WHEN '>=' THEN {v} >= {t} "
    "WHEN '<=' THEN {v} <= {t} WHEN '==' THEN {v} = {t} ELSE false END"
)

TRANSITION = """CASE
      WHEN NOT judged THEN NULL
      WHEN current_state = 'Resolved' AND viol THEN 'Triggered'
      WHEN current_state = 'Triggered' AND NOT viol THEN 'Resolved'
      WHEN current_state = 'Muted' AND mute AND NOT viol THEN 'Resolved'
      WHEN current_state = 'Muted' AND NOT mute AND viol THEN 'Triggered' END"""

SWEEP = f"""{VALUES},
  j AS (SELECT r.*, v.value, v.value IS NOT NULL AS judged,
          current_state = 'Muted' AND coalesce(muted_until > TIMESTAMP '2024-01-31', false) AS mute,
          {VIOLATED.format(v='v.value', t='r.threshold')} AS viol
        FROM rules r LEFT JOIN vals v ON v.alert_rule_id = r.id),
  sw AS (SELECT *, {TRANSITION} AS transition FROM j)"""

_NUM = (
    "CASE WHEN {0} = floor({0}) THEN cast(cast({0} AS bigint) AS varchar) || '.0' "
    "ELSE cast({0} AS varchar) END"
)
_V, _T = _NUM.format("value"), _NUM.format("threshold")


def _message(template: str, *values: str) -> str:
    """SQL concatenation of a printf template's pieces and values."""
    pieces = template.split("%s")
    parts = []
    for i, piece in enumerate(pieces):
        if piece:
            parts.append("'" + piece.replace("'", "''") + "'")
        if i < len(values):
            parts.append(f"({values[i]})")
    return " || ".join(parts)


_ARGS = ("name", "organization_id", "metric_type", "operator", _T, _V, "cast(time_window_minutes AS varchar)")
_SHORT = ("name", "organization_id", "metric_type", _V)


def _either(trigger: str, resolve: str) -> str:
    return f"CASE WHEN transition = 'Triggered' THEN {trigger} ELSE {resolve} END"



_SERIES_METRICS = ("page_views", "unique_visitors", "bounce_rate", "avg_session_duration")
TICKS = (
    f"{EV}, {RULES}, h AS ("
    + " UNION ALL ".join(
        f"SELECT *, '{m}' AS metric_type FROM ({points_sql(m, 'day')})" for m in _SERIES_METRICS
    )
    + "), t AS (SELECT r.id AS alert_rule_id, h.bucket AS \"at\", "
    + VIOLATED.format(v="h.value", t="r.threshold")
    + " AS viol FROM rules r JOIN h USING (organization_id, metric_type))"
)

# With mutes: the state machine as a recursion over the numbered inputs of a rule.
MUTED_REPLAY = f"""WITH RECURSIVE {TICKS},
  inp AS (SELECT alert_rule_id, "at", 1 AS tick, viol FROM t UNION ALL
          SELECT id, unnest([TIMESTAMP '2024-01-02 12:00:00', TIMESTAMP '2024-01-15 12:00:00']), 0, NULL FROM rules),
  num AS (SELECT *, row_number() OVER (PARTITION BY alert_rule_id ORDER BY "at", tick) AS n FROM inp),
  run(alert_rule_id, n, "at", tick, before, after, until, history) AS (
    SELECT id, cast(0 AS bigint), NULL::timestamp, 1, ''::varchar, current_state, muted_until, NULL::varchar FROM rules
    UNION ALL
    SELECT m.alert_rule_id, m.n, m."at", m.tick, p.after,
      CASE WHEN m.tick = 0 THEN 'Muted'
           WHEN p.after = 'Muted' AND coalesce(p.until > m."at", false) AND m.viol THEN 'Muted'
           WHEN m.viol THEN 'Triggered' ELSE 'Resolved' END,
      CASE WHEN m.tick = 0 THEN m."at" + INTERVAL 7200 MINUTE
           WHEN p.after = 'Muted' AND coalesce(p.until > m."at", false) AND m.viol THEN p.until END,
      CASE WHEN m.tick = 0 THEN 'Muted'
           WHEN p.after = 'Triggered' AND NOT m.viol THEN 'Resolved'
           WHEN p.after = 'Resolved' AND m.viol THEN 'Triggered'
           WHEN p.after = 'Muted' AND coalesce(p.until > m."at", false) AND NOT m.viol THEN 'Resolved'
           WHEN p.after = 'Muted' AND NOT coalesce(p.until > m."at", false) AND m.viol THEN 'Triggered' END
    FROM run p JOIN num m ON m.alert_rule_id = p.alert_rule_id AND m.n = p.n + 1)
  SELECT alert_rule_id, "at", tick = 1 AS is_tick, before AS state_before, after AS state_after, history
  FROM run WHERE n > 0"""

ORACLES = {
    "alert_values": (
        f"WITH {VALUES} SELECT alert_rule_id, organization_id, {r6('value')} AS value, is_known_metric FROM vals"
    ),
    "alert_states": (
        f"WITH {SWEEP} SELECT id, organization_id, CASE WHEN transition IS NOT NULL THEN transition "
        "WHEN judged AND current_state = 'Muted' AND NOT mute THEN 'Resolved' ELSE current_state END "
        "AS current_state, CASE WHEN judged AND (transition = 'Resolved' OR "
        "(current_state = 'Muted' AND NOT mute)) THEN NULL ELSE muted_until END AS muted_until FROM sw"
    ),
    "alert_transitions": (
        f"WITH {SWEEP} SELECT id, organization_id, transition, {r6('value')} AS value, "
        f"{r6('threshold')} AS threshold FROM sw WHERE transition IS NOT NULL"
    ),
    "alert_history": (
        f"WITH {SWEEP} SELECT id AS alert_rule_id, organization_id, transition AS state, "
        "TIMESTAMP '2024-01-31' AS created_at, email_recipient AS recipient, slack_webhook AS webhook "
        "FROM sw WHERE transition IS NOT NULL"
    ),
    "alert_messages": (
        f"WITH {SWEEP} SELECT id, email_recipient AS recipient, "
        "CASE WHEN email_recipient IS NOT NULL THEN "
        + _either(_message(al.EMAIL_TRIGGER_SUBJECT, "name"), _message(al.EMAIL_RESOLVE_SUBJECT, "name"))
        + " END AS subject, CASE WHEN email_recipient IS NOT NULL THEN "
        + _either(_message(al.EMAIL_TRIGGER_BODY, *_ARGS), _message(al.EMAIL_RESOLVE_BODY, *_SHORT))
        + " END AS body, CASE WHEN slack_webhook IS NOT NULL THEN "
        + _either(_message(al.CHAT_TRIGGER_TEXT, "name", _V, _T), _message(al.CHAT_RESOLVE_TEXT, "name", _V))
        + " END AS chat_text, CASE WHEN slack_webhook IS NOT NULL THEN "
        + _either(_message(al.CHAT_TRIGGER_BLOCK, *_ARGS), _message(al.CHAT_RESOLVE_BLOCK, *_SHORT))
        + f" END AS chat_block FROM (SELECT * REPLACE ({r6('value')} AS value) FROM sw) "
        "WHERE transition IS NOT NULL"
    ),
    "alert_sweep_counts": (
        f"WITH {SWEEP} SELECT count(*) FILTER (judged) AS evaluated, count(transition) AS transitions FROM sw"
    ),
    "alert_history_page": (
        f"WITH {SWEEP} SELECT id AS alert_rule_id, transition AS state, TIMESTAMP '2024-01-31' AS created_at "
        "FROM sw WHERE transition IS NOT NULL AND organization_id = 'org_1' ORDER BY id LIMIT 15"
    ),
    "alert_feed": (
        f"WITH {SWEEP} SELECT organization_id, 'alert' AS type, id AS rule_id, name AS rule_name, "
        "transition AS state, metric_type, threshold, '2024-01-31T00:00:00+00:00' AS timestamp "
        "FROM sw WHERE transition IS NOT NULL"
    ),
    "alert_snooze": (
        f"WITH {RULES} SELECT id, CASE WHEN current_state = 'Triggered' AND NOT is_deleted THEN 'Muted' "
        "ELSE current_state END AS current_state, CASE WHEN current_state = 'Triggered' AND NOT is_deleted "
        "THEN TIMESTAMP '2024-01-31' + to_minutes(cast(time_window_minutes AS bigint)) ELSE muted_until END "
        "AS muted_until FROM rules"
    ),
    "alert_snooze_history": (
        f"WITH {RULES} SELECT id AS alert_rule_id, organization_id, 'Muted' AS state, 0.0e0 AS value, threshold, "
        "'{\"action\":\"manual_snooze\",\"snooze_minutes\":' || time_window_minutes || ',\"muted_until\":\"' || "
        "strftime(TIMESTAMP '2024-01-31' + to_minutes(cast(time_window_minutes AS bigint)), "
        "'%Y-%m-%dT%H:%M:%S+00:00') || '\"}' AS details, TIMESTAMP '2024-01-31' AS created_at "
        "FROM rules WHERE current_state = 'Triggered' AND NOT is_deleted"
    ),
    "alert_replay": (
        f"WITH {TICKS}, s AS (SELECT *, coalesce(lag(viol) OVER (PARTITION BY alert_rule_id ORDER BY \"at\"), "
        "false) AS was FROM t) SELECT alert_rule_id, \"at\", CASE WHEN viol THEN 'Triggered' ELSE 'Resolved' END "
        "AS state_after, CASE WHEN viol AND NOT was THEN 'Triggered' WHEN was AND NOT viol THEN 'Resolved' END "
        "AS history FROM s"
    ),
    "alert_replay_muted": MUTED_REPLAY,
}

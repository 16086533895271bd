"""Small literal tables."""

import json
from datetime import datetime, timedelta, timezone

from eventmetrics import schema

AS_OF = datetime(2026, 5, 21, 12, 0, 0, tzinfo=timezone.utc)


def ago(**delta):
    return AS_OF - timedelta(**delta)


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def event(name, at, org="org_a", source=None, **payload):
    return (None, org, source, name, at, json.dumps(payload), at)


def events(spark, rows):
    numbered = [(f"e{i:04d}", *row[1:]) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, schema.EVENTS)


def rule(**given):
    base = dict(
        id="r1",
        organization_id="org_a",
        name="Errors",
        is_enabled=True,
        metric_type="error_count",
        operator=">",
        threshold=3.0,
        time_window_minutes=10,
        current_state="Resolved",
        muted_until=None,
        snooze_duration_minutes=30,
        slack_webhook=None,
        email_recipient=None,
        is_deleted=False,
    )
    return base | given


def rules(spark, *given):
    return spark.createDataFrame([tuple(r.values()) for r in given], schema.ALERT_RULES)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is None, "" if v is None else v) for v in t])


def local(moment):
    """What collect() returns for an aware moment: local wall time without a zone."""
    return moment.astimezone().replace(tzinfo=None)

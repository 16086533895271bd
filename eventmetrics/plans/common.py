"""Shared pieces of the named queries and of their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from eventmetrics.sources import sample

# The sample events span 2024-01-01 .. 2024-01-30.
FIRST = datetime(2024, 1, 1, tzinfo=timezone.utc)
MIDDLE = datetime(2024, 1, 16, tzinfo=timezone.utc)
AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)

EV = (
    "ev AS (SELECT " + ", ".join(sample.EVENT_COLUMNS) + ", ts, cast(user_id as varchar) AS visitor_id, "
    "cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%d') AS session_id, "
    "regexp_extract(props, '\"k\": ([0-9]+)', 1) AS k FROM events)"
)


def cte(name: str, columns: list[str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM {source})"


RULES = cte("rules", sample.RULE_COLUMNS, "customer")
DASHBOARDS = cte("dashboards", sample.DASHBOARD_COLUMNS, "supplier")
WIDGETS = cte("widgets", sample.WIDGET_COLUMNS, "part")
SCHEDULES = cte("schedules", sample.SCHEDULE_COLUMNS, "supplier")
RUNS = cte("runs", sample.RUN_COLUMNS, "orders")


# Averages of microseconds often end in an exact half, which float noise rounds
# either way. Both sides move it off the rounding boundary by the same amount.
OFF_HALF = 1.23e-8


def r6(sql: str) -> str:
    return f"round({sql} + {OFF_HALF}, 6)"


def plain(df: DataFrame) -> DataFrame:
    """Round doubles and drop time zones, as the SQL side prints them."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind == "double":
            column = F.round(column + OFF_HALF, 6)
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)

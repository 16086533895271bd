"""Scheduled reports: which are due, what they contain, and their run history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from eventmetrics.functions.dates import MICROS, moment
from eventmetrics.operators.dashboards import RANGE, evaluate_widgets, widget_requests
from eventmetrics.operators.overview import OVERVIEW_METRICS
from eventmetrics.operators.scope import active, page

# Hours between runs, days covered and label per frequency; any
# other frequency is treated like a daily one.
DUE_HOURS = {"daily": 23, "weekly": 6 * 24, "monthly": 28 * 24}
COVERED_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}
TIME_LABELS = {"daily": "Past 24 Hours", "weekly": "Past 7 Days", "monthly": "Past 30 Days"}
OTHER_LABEL = "Lookback Period (%s)"
NO_DASHBOARD_NAME = "Organization Overview"
PENDING, SUCCESS, FAILED = "pending", "success", "failed"
NO_FREQUENCY = "the schedule has no frequency"
NO_OVERVIEW = "the overview was not written"


def _by_frequency(choices: dict, default) -> Column:
    default = default if isinstance(default, Column) else F.lit(default)
    picked = default
    for name, value in choices.items():
        picked = F.when(F.lower("frequency") == name, F.lit(value)).otherwise(picked)
    return picked


def _before(now: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - hours.cast("bigint") * (3600 * MICROS))


def latest_success(histories: DataFrame) -> DataFrame:
    """Time of the newest successful run per schedule."""
    return (
        active(histories)
        .filter(F.col("status") == SUCCESS)
        .groupBy("report_schedule_id")
        .agg(F.max("triggered_at").alias("last_success"))
    )


def scan_schedules(schedules: DataFrame, histories: DataFrame, as_of: datetime) -> DataFrame:
    """Active schedules with ``last_success`` and ``is_due``."""
    now = moment(as_of)
    runs = latest_success(histories).withColumnRenamed("report_schedule_id", "id")
    rested = F.col("last_success") <= _before(now, _by_frequency(DUE_HOURS, DUE_HOURS["daily"]))
    return (
        active(schedules)
        .filter("is_active")
        .join(runs, "id", "left")
        .withColumn("is_due", F.coalesce(rested, F.lit(True)))
    )


def due_schedules(schedules: DataFrame, histories: DataFrame, as_of: datetime) -> DataFrame:
    return scan_schedules(schedules, histories, as_of).filter("is_due").drop("is_due")


def scan_counts(scanned: DataFrame) -> DataFrame:
    """Active schedules and those triggered in a scan."""
    return scanned.agg(
        F.count(F.lit(1)).alias("active_schedules"),
        F.count_if("is_due").alias("triggered_reports"),
    )


def with_window(schedules: DataFrame, as_of: datetime) -> DataFrame:
    """Add the range a report covers and its label."""
    now = moment(as_of)
    days = _by_frequency(COVERED_DAYS, COVERED_DAYS["daily"])
    label = _by_frequency(TIME_LABELS, F.format_string(OTHER_LABEL, F.col("frequency")))
    return schedules.withColumns(
        {"range_start": _before(now, days * 24), "range_end": now, "time_label": label}
    )


def with_dashboard(due: DataFrame, dashboards: DataFrame) -> DataFrame:
    """Resolve each schedule's dashboard; a missing, foreign or deleted one leaves the overview only."""
    boards = active(dashboards).select(
        F.col("id").alias("dashboard_id"),
        "organization_id",
        F.col("name").alias("_name"),
        F.lit(True).alias("_found"),
    )
    return (
        due.join(boards, ["dashboard_id", "organization_id"], "left")
        .withColumn("dashboard_name", F.coalesce("_name", F.lit(NO_DASHBOARD_NAME)))
        .withColumn("dashboard_id", F.when(F.col("_found"), F.col("dashboard_id")))
        .drop("_name", "_found")
    )


def report_sections(
    events: DataFrame, due: DataFrame, dashboards: DataFrame, widgets: DataFrame, as_of: datetime
) -> DataFrame:
    """Contents of all due reports: the overview and every widget, as one long table.

    The overview is asked for like four more KPI widgets (without a widget
    id), so each tenant's totals are computed once for both.
    """
    resolved = with_dashboard(with_window(due, as_of), dashboards).withColumnRenamed(
        "id", "schedule_id"
    )
    parts = active(widgets).select(
        F.col("id").alias("widget_id"), "dashboard_id", "type", "query_config"
    )
    columns = ["schedule_id", *RANGE, "widget_id", "type", "query_config"]
    configs = F.array(*[F.lit(f'{{"metric_type":"{m}"}}') for m in OVERVIEW_METRICS])
    summary = resolved.select(
        "schedule_id",
        *RANGE,
        F.lit(None).cast("string").alias("widget_id"),
        F.lit("kpi").alias("type"),
        F.explode(configs).alias("query_config"),
    )
    placed = resolved.join(parts, "dashboard_id").select(*columns).unionByName(summary)
    keys = ["organization_id", "schedule_id", "widget_id"]
    sections = evaluate_widgets(events, widget_requests(placed), keys)
    is_summary = F.col("widget_id").isNull()
    position = F.array_position(F.array(*[F.lit(m) for m in OVERVIEW_METRICS]), F.col("label"))
    return sections.withColumns(
        {
            "section": F.when(is_summary, F.lit("overview")).otherwise(F.col("section")),
            "ord": F.when(is_summary, position).otherwise(F.col("ord")),
        }
    )


def write_reports(sections: DataFrame, path: str) -> None:
    """Archive report contents, sorted so that one schedule's rows lie together.

    Schedules are not folders: their number grows with the tenants.
    """
    sections.repartitionByRange("schedule_id").sortWithinPartitions(
        "schedule_id", "section", "widget_id", "ord"
    ).write.mode("append").parquet(path)


def report_errors(due: DataFrame, written: DataFrame) -> DataFrame:
    """What went wrong with each due schedule, as (id, error), NULL where nothing did.

    ``written`` are the archived sections. A schedule without a frequency has no
    range to report on; one whose overview did not arrive has no report. Each
    fails for itself: the sections of all others are computed and kept.
    """
    arrived = written.filter(F.col("section") == "overview").groupBy(F.col("schedule_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_parts")
    )
    return due.join(arrived, "id", "left").select(
        "id",
        F.when(F.col("frequency").isNull(), F.lit(NO_FREQUENCY))
        .when(F.coalesce("_parts", F.lit(0)) < len(OVERVIEW_METRICS), F.lit(NO_OVERVIEW))
        .alias("error"),
    )


def run_id(schedule: Column, as_of: datetime) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", schedule, moment(as_of).cast("string")), 256), 1, 32)


def report_path(folder: str, schedule: Column, run: Column) -> Column:
    return F.concat(F.lit(f"{folder}/report_"), schedule, F.lit("_"), run)


def record_outcomes(due: DataFrame, errors: DataFrame | None, as_of: datetime, folder: str | None = None) -> DataFrame:
    """History rows of a run, each schedule with its own status, error and file.

    Without ``errors`` (id, error) the run has just begun and all are pending.
    """
    run = run_id(F.col("id"), as_of)
    text = F.lit(None).cast("string")
    if errors is None:
        judged = due.withColumns({"error": text, "_status": F.lit(PENDING)})
    else:
        judged = due.join(errors.select("id", "error", F.lit(True).alias("_known")), "id", "left").withColumn(
            "_status",
            F.when(F.col("_known").isNull(), PENDING).when(F.col("error").isNull(), SUCCESS).otherwise(FAILED),
        )
    done = F.col("_status") == SUCCESS
    return judged.select(
        run.alias("id"),
        F.col("id").alias("report_schedule_id"),
        "organization_id",
        moment(as_of).alias("triggered_at"),
        F.col("_status").alias("status"),
        F.col("error").alias("error_message"),
        (F.when(done, report_path(folder, F.col("id"), run)) if folder else text).alias("file_path"),
        F.lit(False).alias("is_deleted"),
    )


def run_reports(
    events: DataFrame,
    schedules: DataFrame,
    histories: DataFrame,
    dashboards: DataFrame,
    widgets: DataFrame,
    as_of: datetime,
    folder: str,
) -> DataFrame:
    """One scan of the schedules: due ones are computed and archived, and their runs returned.

    Only schedules with a frequency go into the computation. A failed run does
    not count as a success, so the next scan finds its schedule due again.
    """
    due = due_schedules(schedules, histories, as_of)
    sections = report_sections(events, due.filter("frequency IS NOT NULL"), dashboards, widgets, as_of)
    write_reports(sections, folder)
    archived = events.sparkSession.read.schema(sections.schema).parquet(folder)
    return record_outcomes(due, report_errors(due, archived), as_of, folder)


def record_runs(
    due: DataFrame, as_of: datetime, status: str, path: str | None = None, error: str | None = None
) -> DataFrame:
    """``record_outcomes`` where all due schedules share one status, file and error."""
    if status not in (PENDING, SUCCESS, FAILED):
        raise ValueError(f"unknown run status: {status!r}")
    return record_outcomes(due, None, as_of).withColumns(
        {
            "status": F.lit(status),
            "error_message": F.lit(error).cast("string"),
            "file_path": F.lit(path if status == SUCCESS else None).cast("string"),
        }
    )


def list_runs(histories: DataFrame, org: str, skip: int = 0, limit: int = 100) -> DataFrame:
    rows = active(histories).filter(F.col("organization_id") == org)
    return page(rows, F.desc("triggered_at"), F.asc("id"), skip=skip, limit=limit)

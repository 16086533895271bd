import json
from datetime import timedelta

import pytest
from helpers import AS_OF, ago, event, events, local, rows

from pyspark.sql import functions as F

from eventmetrics import schema
from eventmetrics.operators import dashboards as da
from eventmetrics.operators import reports as re


@pytest.fixture(scope="module")
def visits(spark):
    return events(
        spark,
        [
            event(
                "page_view",
                ago(hours=i),
                session_id=f"sess-{i}",
                visitor_id=f"visitor-{i}",
                browser="Chrome" if i % 2 == 0 else "Safari",
            )
            for i in range(1, 11)
        ],
    ).cache()


def widget(id, kind, dashboard="d1", deleted=False, **config):
    return (id, dashboard, id, kind, "{}", json.dumps(config), deleted)


@pytest.fixture(scope="module")
def boards(spark):
    return spark.createDataFrame(
        [
            ("d1", "org_a", "Main", False, None, False),
            ("d2", "org_a", "Old", False, None, True),
            ("d3", "org_b", "Theirs", False, None, False),
            ("d4", "org_a", "Bare", False, None, False),
        ],
        schema.DASHBOARDS,
    )


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame(
        [
            widget("kpi", "kpi"),
            widget("bounce", "KPI", metric_type="bounce_rate"),
            widget("odd", "kpi", metric_type="latency"),
            widget("line", "line", interval="hour"),
            widget("broken", "bar", interval="decade"),
            widget("pie", "pie", property_key="browser", limit=1),
            widget("table", "table", breakdown_property="browser"),
            widget("none", "table", breakdown_property="browser", limit=0),
            widget("gauge", "gauge"),
            widget("gone", "kpi", deleted=True),
            widget("theirs", "line", dashboard="d3"),
        ],
        schema.WIDGETS,
    )


def test_widgets(visits, boards, parts):
    found = da.widget_results(visits, boards, parts, ago(days=1), AS_OF)
    got = {}
    for r in found.collect():
        got.setdefault(r.widget_id, []).append((r.section, r.ord, r.label, r.value, r.extra))
    assert set(got) == {"kpi", "bounce", "odd", "line", "broken", "pie", "table", "none", "gauge", "theirs"}
    assert got["none"] == [("empty", 1, "table", None, None)]
    assert got["kpi"] == [("kpi", 1, "page_views", 10.0, 100.0)]
    assert got["bounce"] == [("kpi", 1, "bounce_rate", 100.0, 100.0)]
    assert got["odd"] == [("kpi", 1, "latency", 0.0, 0.0)]
    points = sorted(p for p in got["line"] if p[0] == "point")
    assert [p[1] for p in points] == list(range(1, 9))
    assert points[-1][2] == "2026-05-21 11:00"
    bars = sorted(p for p in got["line"] if p[0] == "bar")
    assert [(b[1], b[4]) for b in bars] == [(i, 100.0) for i in range(1, 11)]
    assert got["broken"] == [("error", 1, "page_views by decade", None, None)]
    assert got["pie"] == [("pie", 1, "Chrome", 5.0, 100.0)]
    assert sorted(got["table"]) == [("table", 1, "Chrome", 5.0, 50.0), ("table", 2, "Safari", 5.0, 50.0)]
    assert got["gauge"] == [("unsupported", 1, "gauge", None, None)]
    assert got["theirs"] == [("empty", 1, "line", None, None)]


def test_dashboard_without_widgets(boards, parts):
    placed = rows(da.dashboard_widgets(boards, parts).groupBy("dashboard_id").count())
    assert placed == [("d1", 9), ("d3", 1), ("d4", 1)]
    kept = da.dashboard_widgets(boards, parts, keep_deleted=True)
    assert kept.filter("dashboard_id = 'd1'").count() == 10


def test_template(spark, visits):
    orgs = spark.createDataFrame([("org_a",), ("org_b",)], "organization_id string")
    dashboards, widgets = da.web_analytics_template(orgs, "Web_Analytics")
    assert rows(widgets.groupBy("dashboard_id").count(), "count") == [(6,), (6,)]
    first = json.loads(widgets.filter("name = 'Bounce Rate'").first().layout)
    assert first == {"x": 6, "y": 0, "w": 3, "h": 2}
    results = da.widget_results(visits, dashboards, widgets, ago(days=1), AS_OF)
    pie = results.filter("section = 'pie' AND organization_id = 'org_a'")
    assert rows(pie, "label", "value", "extra") == [("Chrome", 5.0, 50.0), ("Safari", 5.0, 50.0)]
    with pytest.raises(ValueError):
        da.web_analytics_template(orgs, "sales")


def schedule(id, frequency, dashboard="d1", org="org_a", active=True, deleted=False):
    return (id, org, dashboard, id, frequency, ["a@example.com"], active, deleted)


def run(schedule_id, at, status="success", deleted=False):
    return ("h", schedule_id, "org_a", at, status, None, None, deleted)


def test_due(spark):
    schedules = spark.createDataFrame(
        [schedule("never", "daily"), schedule("off", "daily", active=False), schedule("gone", "daily", deleted=True)]
        + [
            schedule(f"{f}:{name}", f)
            for f in ("Daily", "weekly", "monthly", "hourly")
            for name in ("rested", "fresh", "failed", "erased")
        ],
        schema.REPORT_SCHEDULES,
    )
    hours = {"Daily": 23, "weekly": 144, "monthly": 672, "hourly": 23}
    history = []
    for f, h in hours.items():
        history += [
            run(f"{f}:rested", ago(hours=h)),
            run(f"{f}:rested", ago(hours=h + 50)),
            run(f"{f}:fresh", ago(hours=h) + timedelta(seconds=1)),
            run(f"{f}:failed", ago(hours=1), "failed"),
            run(f"{f}:failed", ago(hours=1), "pending"),
            run(f"{f}:erased", ago(hours=1), deleted=True),
        ]
    histories = spark.createDataFrame(history, schema.REPORT_HISTORIES)
    due = {r.id for r in re.due_schedules(schedules, histories, AS_OF).collect()}
    wanted = {"never"} | {f"{f}:{n}" for f in hours for n in ("rested", "failed", "erased")}
    assert due == wanted
    counts = re.scan_counts(re.scan_schedules(schedules, histories, AS_OF)).first()
    assert (counts.active_schedules, counts.triggered_reports) == (17, 13)


def test_sections(spark, visits, boards, parts, tmp_path):
    due = spark.createDataFrame(
        [
            schedule("week", "weekly"),
            schedule("bare", "daily", "d4"),
            schedule("deleted", "monthly", "d2"),
            schedule("foreign", "Quarterly", "d3"),
            schedule("none", "daily", None),
        ],
        schema.REPORT_SCHEDULES,
    )
    named = re.with_dashboard(re.with_window(due, AS_OF), boards)
    assert rows(named, "id", "dashboard_name", "time_label", "range_start") == [
        ("bare", "Bare", "Past 24 Hours", local(ago(days=1))),
        ("deleted", "Organization Overview", "Past 30 Days", local(ago(days=30))),
        ("foreign", "Organization Overview", "Lookback Period (Quarterly)", local(ago(days=1))),
        ("none", "Organization Overview", "Past 24 Hours", local(ago(days=1))),
        ("week", "Main", "Past 7 Days", local(ago(days=7))),
    ]
    sections = re.report_sections(visits, due, boards, parts, AS_OF)
    overview = sections.filter("section = 'overview'")
    assert overview.count() == 20
    week = rows(overview.filter("schedule_id = 'week'"), "ord", "label", "value")
    assert week == [
        (1, "page_views", 10.0),
        (2, "unique_visitors", 10.0),
        (3, "bounce_rate", 100.0),
        (4, "avg_session_duration", 0.0),
    ]
    rest = sections.filter("section <> 'overview'")
    assert {r.schedule_id for r in rest.collect()} == {"week"}
    path = str(tmp_path / "reports")
    re.write_reports(sections, path)
    assert spark.read.parquet(path).count() == sections.count()


def test_runs(spark):
    due = spark.createDataFrame([schedule("a", "daily"), schedule("b", "daily")], schema.REPORT_SCHEDULES)
    done = re.record_runs(due, AS_OF, "success", path="p")
    failed = re.record_runs(due, AS_OF, "failed", path="p", error="boom")
    assert rows(done, "report_schedule_id", "status", "file_path") == [("a", "success", "p"), ("b", "success", "p")]
    assert rows(failed, "error_message", "file_path") == [("boom", None), ("boom", None)]
    assert rows(done, "id") == rows(failed, "id")
    with pytest.raises(ValueError):
        re.record_runs(due, AS_OF, "lost")
    listed = re.list_runs(done.unionByName(failed.withColumn("id", F.concat("id", F.lit("x")))), "org_a", skip=1, limit=2)
    assert listed.count() == 2


def test_one_failed_report_fails_only_itself(spark, tmp_path):
    due = spark.createDataFrame(
        [schedule("good", "daily"), schedule("bad", None), schedule("lost", "weekly"), schedule("new", "daily")],
        schema.REPORT_SCHEDULES,
    )
    begun = re.record_outcomes(due, None, AS_OF)
    assert {r.status for r in begun.collect()} == {"pending"}
    written = spark.createDataFrame([("good", "overview")] * 4 + [("new", "overview")] * 4 + [("lost", "kpi")], "schedule_id string, section string")
    errors = re.report_errors(due, written).filter("id <> 'new'")
    runs = {r.report_schedule_id: r for r in re.record_outcomes(due, errors, AS_OF, "archive").collect()}
    assert {k: (r.status, r.error_message) for k, r in runs.items()} == {
        "good": ("success", None),
        "bad": ("failed", re.NO_FREQUENCY),
        "lost": ("failed", re.NO_OVERVIEW),
        "new": ("pending", None),
    }
    assert runs["good"].file_path == f"archive/report_good_{runs['good'].id}"
    assert runs["bad"].file_path is None
    # A failed run does not count: the schedule is due again.
    history = re.record_outcomes(due, errors, AS_OF, "archive")
    again = re.due_schedules(due, history, AS_OF)
    assert rows(again, "id") == [("bad",), ("lost",), ("new",)]

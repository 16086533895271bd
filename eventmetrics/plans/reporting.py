"""Dashboards, widgets and scheduled reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventmetrics.functions import text as tx
from eventmetrics.operators import dashboards as da
from eventmetrics.operators import overview as ov
from eventmetrics.operators import reports as re
from eventmetrics.plans.analytics import change_sql, period_sql
from eventmetrics.plans.common import (
    AS_OF,
    DASHBOARDS,
    EV,
    MIDDLE,
    RUNS,
    SCHEDULES,
    WIDGETS,
    plain,
    r6,
)
from eventmetrics.session import work_dir
from eventmetrics.sources import sample


def dashboard_widgets(spark, sf_dir):
    return da.dashboard_widgets(sample.dashboards(spark, sf_dir), sample.widgets(spark, sf_dir)).select(
        "dashboard_id", "organization_id", "widget_id", "type"
    )


def widget_results(spark, sf_dir):
    results = da.widget_results(
        sample.events(spark, sf_dir),
        sample.dashboards(spark, sf_dir),
        sample.widgets(spark, sf_dir),
        MIDDLE,
        AS_OF,
    )
    return plain(results)


def template_results(spark, sf_dir):
    """The web analytics dashboard of every tenant that has one of its own."""
    boards, parts = da.web_analytics_template(sample.dashboards(spark, sf_dir))
    results = da.widget_results(sample.events(spark, sf_dir), boards, parts, MIDDLE, AS_OF)
    return plain(results.drop("dashboard_id"))


def _due(spark, sf_dir):
    return re.due_schedules(
        sample.report_schedules(spark, sf_dir), sample.report_histories(spark, sf_dir), AS_OF
    )


def due_reports(spark, sf_dir):
    return plain(_due(spark, sf_dir).select("id", "organization_id", "frequency", "last_success"))


def report_scan_counts(spark, sf_dir):
    return re.scan_counts(
        re.scan_schedules(
            sample.report_schedules(spark, sf_dir), sample.report_histories(spark, sf_dir), AS_OF
        )
    )


def report_windows(spark, sf_dir):
    due = re.with_window(_due(spark, sf_dir), AS_OF)
    named = re.with_dashboard(due, sample.dashboards(spark, sf_dir))
    return plain(named.select("id", "dashboard_id", "dashboard_name", "time_label", "range_start", "range_end"))


def report_sections(spark, sf_dir):
    sections = re.report_sections(
        sample.events(spark, sf_dir),
        _due(spark, sf_dir),
        sample.dashboards(spark, sf_dir),
        sample.widgets(spark, sf_dir),
        AS_OF,
    )
    return plain(sections)


# Schedules whose frequency is taken away for a run.
BROKEN_SCHEDULE = "id LIKE '%7'"


def report_runs(spark, sf_dir):
    """Every due report computed and archived; schedules that lack a frequency fail, each for itself."""
    folder = f"{work_dir(spark, 'reports')}/archive"
    broken = F.expr(BROKEN_SCHEDULE)
    schedules = sample.report_schedules(spark, sf_dir).withColumn(
        "frequency", F.when(~broken, F.col("frequency"))
    )
    runs = re.run_reports(
        sample.events(spark, sf_dir),
        schedules,
        sample.report_histories(spark, sf_dir),
        sample.dashboards(spark, sf_dir),
        sample.widgets(spark, sf_dir),
        AS_OF,
        folder,
    )
    file = F.replace("file_path", F.concat(F.lit(f"{folder}/report_"), "report_schedule_id", F.lit("_"), "id"), F.lit("run"))
    return plain(runs.withColumn("file_path", file).drop("id"))


def report_run_page(spark, sf_dir):
    runs = re.list_runs(sample.report_histories(spark, sf_dir), "org_3", skip=10, limit=25)
    return plain(runs.select("id", "triggered_at", "status"))


def kpi_texts(spark, sf_dir):
    """Display texts of the four overview metrics of every tenant."""
    totals = ov.overview_delta(sample.events(spark, sf_dir), MIDDLE, AS_OF)
    lines = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).cast("double").alias("value"),
                F.col(f"{m}_change").alias("change"),
            )
            for m in ov.OVERVIEW_METRICS
        ]
    )
    lower = F.col("metric") == "bounce_rate"
    return totals.select("organization_id", F.inline(lines)).select(
        "organization_id",
        "metric",
        tx.metric_title(F.col("metric")).alias("title"),
        tx.unit_suffix(F.col("metric")).alias("suffix"),
        tx.signed_text(F.col("change")).alias("change_text"),
        tx.trend(F.col("change"), lower).alias("trend"),
        tx.duration_text(F.floor(F.col("value") * 10.0) / 10.0).alias("as_duration"),
    )


QUERIES = {
    "dashboard_widgets": dashboard_widgets,
    "widget_results": widget_results,
    "template_results": template_results,
    "due_reports": due_reports,
    "report_scan_counts": report_scan_counts,
    "report_windows": report_windows,
    "report_sections": report_sections,
    "report_runs": report_runs,
    "report_run_page": report_run_page,
    "kpi_texts": kpi_texts,
}


def _config(field: str) -> str:
    return f"json_extract_string(query_config, '$.{field}')"


# ``placed`` must exist with (keys, organization_id, type, query_config, lo, hi).
_REQUESTS = f"""req AS (SELECT * REPLACE (lower(type) AS type),
    coalesce({_config('metric_type')}, 'page_views') AS metric,
    coalesce({_config('interval')}, 'hour') AS ival,
    coalesce(CASE WHEN lower(type) = 'table' THEN {_config('breakdown_property')} END,
             {_config('property_key')}, {_config('breakdown_property')}, 'browser') AS property,
    coalesce(cast({_config('limit')} AS int), 5) AS lim FROM placed)"""

# Totals of each (tenant, range) and of the range before it.
_RANGES = (
    "rng AS (SELECT DISTINCT organization_id, lo, hi FROM placed), "
    "rp AS (SELECT organization_id, lo AS rlo, hi AS rhi, lo, hi, 'c' || epoch_us(lo) AS period FROM rng "
    "UNION ALL SELECT organization_id, lo, hi, lo - (hi - lo), lo, 'p' || epoch_us(lo) FROM rng), "
    + period_sql("rp").lstrip()
    + ", pairs AS (SELECT rng.organization_id, rng.lo, rng.hi, coalesce(c.page_views, 0) AS page_views, "
    "coalesce(c.unique_visitors, 0) AS unique_visitors, coalesce(c.bounce_rate, 0) AS bounce_rate, "
    "coalesce(c.avg_session_duration, 0) AS avg_session_duration, "
    + ", ".join(change_sql(m) for m in ov.OVERVIEW_METRICS)
    + " FROM rng LEFT JOIN met c ON c.organization_id = rng.organization_id AND c.period = 'c' || epoch_us(rng.lo) "
    "LEFT JOIN met p ON p.organization_id = rng.organization_id AND p.period = 'p' || epoch_us(rng.lo))"
)


def _pick(suffix: str = "") -> str:
    cases = " ".join(f"WHEN '{m}' THEN cast({m}{suffix} AS double)" for m in ov.OVERVIEW_METRICS)
    return f"CASE metric {cases} ELSE 0.0e0 END"


def sections_sql(keys: str) -> str:
    """Sections of all widgets in ``req``, computed the plain way."""
    same = "r.organization_id = e.organization_id AND e.ts >= r.lo AND e.ts <= r.hi"
    g = "organization_id, lo, hi, ival, bucket"
    one = "organization_id, lo, hi, ival, metric"
    return f"""{_RANGES},
  sr AS (SELECT DISTINCT organization_id, lo, hi, ival FROM req
         WHERE type IN ('line', 'bar') AND metric <> 'latency'),
  se AS (SELECT r.lo, r.hi, r.ival, CASE r.ival WHEN 'hour' THEN date_trunc('hour', e.ts)
           WHEN 'day' THEN cast(date_trunc('day', e.ts) AS timestamp)
           ELSE cast(date_trunc('week', e.ts) AS timestamp) END AS bucket, e.*
         FROM sr r JOIN ev e ON {same}),
  s1 AS (SELECT {g}, session_id, count(*) AS n,
           date_diff('microsecond', min(ts), max(ts)) / 1e6 AS secs FROM se GROUP BY ALL),
  pts AS (SELECT {g}, 'page_views' AS metric,
            cast(count(*) FILTER (event_name IN ('page_view', 'page.view')) AS double) AS value FROM se GROUP BY ALL
          UNION ALL SELECT {g}, 'unique_visitors', cast(count(DISTINCT visitor_id) AS double) FROM se GROUP BY ALL
          UNION ALL SELECT {g}, 'bounce_rate', cast(count(*) FILTER (n = 1) AS double) * 100 / count(*) FROM s1 GROUP BY ALL
          UNION ALL SELECT {g}, 'avg_session_duration', avg(secs) FROM s1 GROUP BY ALL),
  back AS (SELECT *, row_number() OVER (PARTITION BY {one} ORDER BY bucket DESC) AS b,
             max(value) OVER (PARTITION BY {one}) AS m FROM pts),
  shown AS (SELECT {one}, 'point' AS section, bucket, value, NULL::double AS extra FROM back WHERE b <= 8
            UNION ALL SELECT {one}, 'bar', bucket, value,
              cast(trunc(value / CASE WHEN m = 0 THEN 1 ELSE m END * 100) AS double) FROM back WHERE b <= 12),
  num AS (SELECT *, row_number() OVER (PARTITION BY {one}, section ORDER BY bucket) AS ord FROM shown),
  br AS (SELECT DISTINCT organization_id, lo, hi, property FROM req WHERE type IN ('pie', 'table')),
  cnt AS (SELECT r.organization_id, r.lo, r.hi, r.property, coalesce(CASE r.property WHEN 'k' THEN e.k
            WHEN 'user_id' THEN e.visitor_id END, 'unknown') AS label, count(*) AS n
          FROM br r JOIN ev e ON {same} GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY organization_id, lo, hi, property ORDER BY n DESC, label) AS ord,
           sum(n) OVER (PARTITION BY organization_id, lo, hi, property) AS total FROM cnt),
  top AS (SELECT {keys}, req.type, rk.ord, rk.label, rk.n, rk.total FROM req
          JOIN rk USING (organization_id, lo, hi, property)
          WHERE req.type IN ('pie', 'table') AND rk.ord <= req.lim),
  sections AS (
    SELECT {keys}, 'kpi' AS section, cast(1 AS bigint) AS ord, metric AS label, {_pick()} AS value, {_pick('_change')} AS extra
    FROM req JOIN pairs USING (organization_id, lo, hi) WHERE type = 'kpi'
    UNION ALL SELECT {keys}, section, ord, strftime(bucket, '%Y-%m-%d %H:%M'), value, extra
    FROM req JOIN num USING (organization_id, lo, hi, ival, metric) WHERE type IN ('line', 'bar')
    UNION ALL SELECT {keys}, type, ord, label, cast(n AS double), CASE type
      WHEN 'pie' THEN round(cast(n AS double) * 100 / sum(n) OVER (PARTITION BY {keys}), 1)
      ELSE cast(n AS double) * 100 / total END FROM top
    UNION ALL SELECT {keys}, 'unsupported', 1, type, NULL, NULL FROM req
    WHERE type NOT IN ('kpi', 'line', 'bar', 'pie', 'table')
    UNION ALL SELECT {keys}, 'error', 1, metric || ' by ' || ival, NULL, NULL FROM req
    WHERE type IN ('line', 'bar') AND metric = 'latency'
    UNION ALL SELECT {keys}, 'empty', 1, type, NULL, NULL FROM req r
    WHERE (type IN ('line', 'bar') AND metric <> 'latency' OR type IN ('pie', 'table'))
      AND NOT EXISTS (SELECT 1 FROM ev e WHERE {same}))"""


_ROUNDED = f"* REPLACE ({r6('value')} AS value, {r6('extra')} AS extra)"
_LIVE_WIDGETS = "(SELECT id AS widget_id, dashboard_id, type, query_config FROM widgets WHERE NOT is_deleted) w"
_RANGE = "TIMESTAMP '2024-01-16' AS lo, TIMESTAMP '2024-01-31' AS hi"

_DUE = f"""{SCHEDULES}, {RUNS},
  last AS (SELECT report_schedule_id AS id, max(triggered_at) AS last_success FROM runs
           WHERE status = 'success' AND NOT is_deleted GROUP BY ALL),
  scan AS (SELECT s.*, last_success, coalesce(TIMESTAMP '2024-01-31' - last_success >= to_hours(CASE lower(frequency)
             WHEN 'weekly' THEN 144 WHEN 'monthly' THEN 672 ELSE 23 END), true) AS is_due
           FROM schedules s LEFT JOIN last USING (id) WHERE is_active AND NOT is_deleted),
  due AS (SELECT * FROM scan WHERE is_due)"""
_SOME_BROKEN = (
    f"schedules AS (SELECT * REPLACE (CASE WHEN {BROKEN_SCHEDULE} THEN NULL ELSE frequency END AS frequency) FROM given)"
)
_WINDOWS = f"""{_DUE}, {DASHBOARDS},
  win AS (SELECT due.id AS schedule_id, due.organization_id, d.id AS dashboard_id, coalesce(d.name, 'Organization Overview')
            AS dashboard_name, CASE lower(frequency) WHEN 'daily' THEN 'Past 24 Hours' WHEN 'weekly' THEN 'Past 7 Days'
            WHEN 'monthly' THEN 'Past 30 Days' ELSE 'Lookback Period (' || frequency || ')' END AS time_label,
            TIMESTAMP '2024-01-31' - to_days(CASE lower(frequency) WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 30 ELSE 1 END) AS lo,
            TIMESTAMP '2024-01-31' AS hi
          FROM due LEFT JOIN (SELECT * FROM dashboards WHERE NOT is_deleted) d
            ON d.id = due.dashboard_id AND d.organization_id = due.organization_id)"""
_TEMPLATE_ROWS = ", ".join(
    f"({i + 1}, '{kind}', '{config}')" for i, (_, kind, _, config) in enumerate(da.TEMPLATE_WIDGETS)
)

ORACLES = {
    "dashboard_widgets": (
        f"WITH {DASHBOARDS}, {WIDGETS} SELECT d.id AS dashboard_id, organization_id, widget_id, type "
        f"FROM dashboards d LEFT JOIN {_LIVE_WIDGETS} ON w.dashboard_id = d.id WHERE NOT d.is_deleted"
    ),
    "widget_results": (
        f"WITH {EV}, {DASHBOARDS}, {WIDGETS}, placed AS (SELECT organization_id, d.id AS dashboard_id, widget_id, type, "
        f"query_config, {_RANGE} FROM dashboards d JOIN {_LIVE_WIDGETS} ON w.dashboard_id = d.id WHERE NOT d.is_deleted), "
        f"{_REQUESTS}, {sections_sql('organization_id, dashboard_id, widget_id')} SELECT {_ROUNDED} FROM sections"
    ),
    "template_results": (
        f"WITH {EV}, {DASHBOARDS}, placed AS (SELECT organization_id, 'web_analytics:' || organization_id || ':' || t.n "
        f"AS widget_id, t.type, t.query_config, {_RANGE} FROM (SELECT DISTINCT organization_id FROM dashboards), "
        f"(VALUES {_TEMPLATE_ROWS}) t(n, type, query_config)), {_REQUESTS}, "
        f"{sections_sql('organization_id, widget_id')} SELECT {_ROUNDED} FROM sections"
    ),
    "due_reports": f"WITH {_DUE} SELECT id, organization_id, frequency, last_success FROM due",
    "report_scan_counts": (
        f"WITH {_DUE} SELECT count(*) AS active_schedules, count(*) FILTER (is_due) AS triggered_reports FROM scan"
    ),
    "report_windows": (
        f"WITH {_WINDOWS} SELECT schedule_id AS id, dashboard_id, dashboard_name, time_label, lo AS range_start, "
        "hi AS range_end FROM win"
    ),
    "report_sections": (
        f"WITH {EV}, {WIDGETS}, {_WINDOWS}, placed AS (SELECT organization_id, schedule_id, widget_id, "
        f"coalesce(type, 'none') AS type, query_config, lo, hi FROM win LEFT JOIN {_LIVE_WIDGETS} "
        "ON w.dashboard_id = win.dashboard_id), " + _REQUESTS + ", "
        + sections_sql("organization_id, schedule_id, widget_id")
        + f" SELECT {_ROUNDED} FROM (SELECT * FROM sections WHERE widget_id IS NOT NULL UNION ALL "
        "SELECT organization_id, schedule_id, NULL, 'overview', unnest([1, 2, 3, 4]), "
        "unnest(['page_views', 'unique_visitors', 'bounce_rate', 'avg_session_duration']), "
        "unnest([cast(page_views AS double), unique_visitors, bounce_rate, avg_session_duration]), "
        "unnest([page_views_change, unique_visitors_change, bounce_rate_change, avg_session_duration_change]) "
        "FROM win JOIN pairs USING (organization_id, lo, hi))"
    ),
    "report_runs": (
        f"WITH {_DUE.replace(SCHEDULES, f'{SCHEDULES.replace('schedules AS', 'given AS', 1)}, {_SOME_BROKEN}')} "
        "SELECT id AS report_schedule_id, organization_id, TIMESTAMP '2024-01-31' AS triggered_at, "
        "CASE WHEN frequency IS NULL THEN 'failed' ELSE 'success' END AS status, "
        f"CASE WHEN frequency IS NULL THEN '{re.NO_FREQUENCY}' END AS error_message, "
        "CASE WHEN frequency IS NOT NULL THEN 'run' END AS file_path, false AS is_deleted FROM due"
    ),
    "report_run_page": (
        f"WITH {RUNS} SELECT id, triggered_at, status FROM runs WHERE organization_id = 'org_3' AND NOT is_deleted "
        "ORDER BY triggered_at DESC, id LIMIT 25 OFFSET 10"
    ),
    "kpi_texts": (
        f"WITH {EV}, placed AS (SELECT DISTINCT organization_id, {_RANGE} FROM ev), {_RANGES}, l AS (SELECT organization_id, "
        "unnest(['page_views', 'unique_visitors', 'bounce_rate', 'avg_session_duration']) AS metric, "
        "unnest([cast(page_views AS double), unique_visitors, bounce_rate, avg_session_duration]) AS value, "
        "unnest([page_views_change, unique_visitors_change, bounce_rate_change, avg_session_duration_change]) AS change "
        "FROM pairs), t AS (SELECT *, floor(value * 10) / 10 AS d FROM l) SELECT organization_id, metric, CASE metric WHEN "
        "'page_views' THEN 'Page Views' WHEN 'unique_visitors' THEN 'Unique Visitors' WHEN 'bounce_rate' THEN 'Bounce Rate' "
        "ELSE 'Avg Session Duration' END AS title, CASE metric WHEN 'bounce_rate' THEN '%' WHEN 'avg_session_duration' "
        "THEN 's' ELSE '' END AS suffix, CASE WHEN change >= 0 THEN '+' ELSE '' END || cast(change AS varchar) || '%' "
        "AS change_text, CASE WHEN change = 0 THEN 'flat' WHEN (change > 0) <> (metric = 'bounce_rate') THEN 'good' "
        "ELSE 'bad' END AS trend, CASE WHEN d < 60 THEN cast(cast(floor(d + 0.5) AS bigint) AS varchar) || 's' ELSE "
        "cast(cast(floor(d / 60) AS bigint) AS varchar) || 'm ' || cast(cast(floor(d - floor(d / 60) * 60 + 0.5) AS bigint) "
        "AS varchar) || 's' END AS as_duration FROM t"
    ),
}

"""Overview, series, breakdown, listings."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from eventmetrics.functions.dates import bucket
from eventmetrics.functions.payload import with_identity
from eventmetrics.operators import breakdown as bd
from eventmetrics.operators import overview as ov
from eventmetrics.operators import rollups as ro
from eventmetrics.operators import scope as sc
from eventmetrics.operators import series as se
from eventmetrics.plans.common import AS_OF, DASHBOARDS, EV, FIRST, MIDDLE, plain, r6
from eventmetrics.session import work_dir
from eventmetrics.sources import sample, store


def overview(spark, sf_dir):
    return plain(ov.overview(sample.events(spark, sf_dir), FIRST, AS_OF))


def overview_received(spark, sf_dir):
    """The same from payloads alone."""
    return plain(ov.overview(sample.received_events(spark, sf_dir), FIRST, AS_OF))


def overview_delta(spark, sf_dir):
    return plain(ov.overview_delta(sample.events(spark, sf_dir), MIDDLE, AS_OF))


def _series(metric, interval):
    def query(spark, sf_dir):
        events = sample.events(spark, sf_dir)
        return plain(se.timeseries(events, metric, interval, FIRST, AS_OF))

    return query


def breakdown(spark, sf_dir):
    return plain(bd.breakdown(sample.events(spark, sf_dir), "k", FIRST, AS_OF))


def breakdown_visitor(spark, sf_dir):
    return plain(bd.breakdown(sample.events(spark, sf_dir), "user_id", FIRST, AS_OF, limit=100))


def breakdown_missing(spark, sf_dir):
    return plain(bd.breakdown(sample.events(spark, sf_dir), "browser", FIRST, AS_OF))


def breakdown_top_share(spark, sf_dir):
    top = bd.breakdown(sample.events(spark, sf_dir), "k", FIRST, AS_OF, limit=5)
    return plain(bd.top_share(top))


def chart_merge(spark, sf_dir):
    events = sample.events(spark, sf_dir)
    return plain(se.chart_of(events, "page_views", "unique_visitors", "hour", FIRST, AS_OF))


def chart_merge_series(spark, sf_dir):
    events = sample.events(spark, sf_dir)
    views = se.timeseries(events, "page_views", "hour", FIRST, AS_OF)
    visitors = se.timeseries(events, "unique_visitors", "hour", FIRST, AS_OF)
    return plain(se.chart_merge(views, visitors, "page_views", "unique_visitors"))


def tail_points(spark, sf_dir):
    points = se.timeseries(sample.events(spark, sf_dir), "unique_visitors", "day", FIRST, AS_OF)
    return plain(se.tail_points(points))


def bar_heights(spark, sf_dir):
    points = se.timeseries(sample.events(spark, sf_dir), "page_views", "day", FIRST, AS_OF)
    return plain(se.bar_heights(points))


def error_rate(spark, sf_dir):
    return plain(ov.errors(sample.events(spark, sf_dir), FIRST, AS_OF))


def event_frequency(spark, sf_dir):
    return ov.event_frequency(sample.events(spark, sf_dir))


def partition_counts(spark, sf_dir):
    return plain(store.partition_counts(sample.events(spark, sf_dir)))


def partition_calendar(spark, sf_dir):
    return store.expected_partitions(spark, FIRST, sample.events(spark, sf_dir))


def event_page(spark, sf_dir):
    rows = store.list_events(sample.events(spark, sf_dir), "org_1", limit=50, skip=20)
    return plain(rows.select("id", "event_name", "timestamp"))


PAGE_AT = datetime(2024, 1, 9, 12, tzinfo=timezone.utc)


def event_page_after(spark, sf_dir):
    """A page of the stored events from a moment back, found by the months' row counts."""
    path = work_dir(spark, "event-store")
    store.write_events(sample.events(spark, sf_dir), path)
    stored = store.read_events(spark, path)
    rows = store.events_page(stored, store.tenant_months(stored), "org_1", (PAGE_AT, ""), limit=75)
    return plain(rows.select("id", "event_name", "timestamp"))


def _rollup(spark, sf_dir):
    """Minute rollups with visitor sketches, written in two batches."""
    path = work_dir(spark, "rollup")
    events = sample.events(spark, sf_dir)
    for n in range(2):
        ro.write_rollup(ro.minute_rollup(events.filter(F.expr(f"crc32(id) % 2 = {n}"))), path, n)
    return ro.read_rollup(spark, path)


def _within(found, exact, keys):
    """Counts as they are; of estimated visitors whether they keep the stated bound."""
    near = F.abs(F.col("unique_visitors") - F.col("exact")) <= ro.ERROR_BOUND * F.col("exact")
    return plain(found.join(exact, keys).select(*keys, *ro.COUNTS, near.alias("within_bound")))


def visitor_sketch_day(spark, sf_dir):
    events = with_identity(sample.events(spark, sf_dir))
    keys = ["organization_id", "bucket"]
    exact = events.groupBy("organization_id", bucket("day").alias("bucket")).agg(F.count_distinct("visitor_id").alias("exact"))
    return _within(ro.bucket_estimates(_rollup(spark, sf_dir), "day"), exact, keys)


def visitor_sketch_ranges(spark, sf_dir):
    """Every tenant's seven days before each day, from the rollup alone."""
    days = F.explode(F.sequence(F.lit(FIRST), F.lit(AS_OF), F.expr("interval 1 day")))
    events = with_identity(sample.events(spark, sf_dir))
    ranges = events.select("organization_id").distinct().select(
        "organization_id", days.alias("range_end")
    ).withColumn("range_start", F.col("range_end") - F.expr("interval 7 days"))
    keys = ["organization_id", "range_start", "range_end"]
    inside = (F.col("timestamp") >= F.col("range_start")) & (F.col("timestamp") < F.col("range_end"))
    exact = events.join(ranges, "organization_id").filter(inside).groupBy(*keys).agg(F.count_distinct("visitor_id").alias("exact"))
    return _within(ro.range_estimates(_rollup(spark, sf_dir), ranges), exact, keys)


def newest_per_org(spark, sf_dir):
    rows = sc.page_per_org(sample.events(spark, sf_dir), F.desc("timestamp"), F.asc("id"), limit=100)
    return plain(rows.select("organization_id", "ord", "id", "timestamp"))


def shared_overview(spark, sf_dir):
    events = sample.events(spark, sf_dir)
    shared = sc.shared_events(events, sample.dashboards(spark, sf_dir), SHARE_TOKEN)
    return plain(ov.overview_delta(shared, MIDDLE, AS_OF))


SHARE_TOKEN = "share_7"

QUERIES = {
    "overview": overview,
    "overview_received": overview_received,
    "overview_delta": overview_delta,
    "breakdown": breakdown,
    "breakdown_visitor": breakdown_visitor,
    "breakdown_missing": breakdown_missing,
    "breakdown_top_share": breakdown_top_share,
    "chart_merge": chart_merge,
    "chart_merge_series": chart_merge_series,
    "tail_points": tail_points,
    "bar_heights": bar_heights,
    "error_rate": error_rate,
    "event_frequency": event_frequency,
    "partition_counts": partition_counts,
    "partition_calendar": partition_calendar,
    "event_page": event_page,
    "event_page_after": event_page_after,
    "visitor_sketch_day": visitor_sketch_day,
    "visitor_sketch_ranges": visitor_sketch_ranges,
    "newest_per_org": newest_per_org,
    "shared_overview": shared_overview,
}

SERIES = {
    "ts_page_views_minute": ("page_views", "minute"),
    "ts_page_views_hour": ("page_views", "hour"),
    "ts_page_views_week": ("page_views", "week"),
    "ts_unique_visitors_hour": ("unique_visitors", "hour"),
    "ts_unique_visitors_day": ("unique_visitors", "day"),
    "ts_unique_visitors_month": ("unique_visitors", "month"),
    "ts_bounce_rate_hour": ("bounce_rate", "hour"),
    "ts_bounce_rate_day": ("bounce_rate", "day"),
    "ts_session_duration_hour": ("avg_session_duration", "hour"),
    "ts_session_duration_week": ("avg_session_duration", "week"),
}
QUERIES |= {name: _series(*spec) for name, spec in SERIES.items()}


def period_sql(ranges: str) -> str:
    """Totals per row of ``ranges`` (organization_id, period, lo, hi), the plain way."""
    return f"""
  base AS (SELECT r.period, e.* FROM ev e JOIN {ranges} r
           ON r.organization_id = e.organization_id AND e.ts >= r.lo AND e.ts <= r.hi),
  sess AS (SELECT organization_id, period, session_id, count(*) AS n,
                  date_diff('microsecond', min(ts), max(ts)) / 1e6 AS secs
           FROM base WHERE session_id IS NOT NULL GROUP BY ALL),
  sa AS (SELECT organization_id, period,
                cast(count(*) FILTER (n = 1) AS double) * 100 / count(*) AS bounce_rate,
                avg(secs) AS avg_session_duration FROM sess GROUP BY ALL),
  oa AS (SELECT organization_id, period,
                count(*) FILTER (event_name IN ('page_view', 'page.view')) AS page_views,
                count(DISTINCT visitor_id) AS unique_visitors
         FROM base GROUP BY ALL),
  met AS (SELECT oa.organization_id, oa.period, page_views, unique_visitors,
                 coalesce(bounce_rate, 0) AS bounce_rate,
                 coalesce(avg_session_duration, 0) AS avg_session_duration
          FROM oa LEFT JOIN sa USING (organization_id, period))"""


def change_sql(metric: str) -> str:
    cur, prior = f"coalesce(c.{metric}, 0)", f"coalesce(p.{metric}, 0)"
    return (
        f"CASE WHEN {prior} = 0 THEN CASE WHEN {cur} > 0 THEN 100.0e0 ELSE 0.0e0 END "
        f"ELSE round(cast({cur} - {prior} AS double) / {prior} * 100, 2) END AS {metric}_change"
    )


def pair_sql(cur: str, prior: str) -> str:
    """Joins two rows of ``met`` per tenant into values and changes."""
    return (
        "SELECT organization_id, coalesce(c.page_views, 0) AS page_views, "
        "coalesce(c.unique_visitors, 0) AS unique_visitors, "
        f"{r6('coalesce(c.bounce_rate, 0)')} AS bounce_rate, "
        f"{r6('coalesce(c.avg_session_duration, 0)')} AS avg_session_duration, "
        + ", ".join(change_sql(m) for m in ov.OVERVIEW_METRICS)
        + f" FROM (SELECT * FROM met WHERE period = '{cur}') c "
        f"FULL JOIN (SELECT * FROM met WHERE period = '{prior}') p USING (organization_id)"
    )


ORGS = "(SELECT DISTINCT organization_id FROM ev)"
TWO_PERIODS = (
    f"two AS (SELECT organization_id, unnest(['cur', 'prior']) AS period, "
    "unnest([TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-01']) AS lo, "
    "unnest([TIMESTAMP '2024-01-31', TIMESTAMP '2024-01-16']) AS hi FROM "
)

_POINTS = {
    "page_views": (
        "SELECT organization_id, date_trunc('{i}', ts) AS bucket, "
        "cast(count(*) FILTER (event_name IN ('page_view', 'page.view')) AS double) AS value "
        "FROM ev GROUP BY ALL"
    ),
    "unique_visitors": (
        "SELECT organization_id, date_trunc('{i}', ts) AS bucket, "
        "cast(count(DISTINCT visitor_id) AS double) AS value FROM ev GROUP BY ALL"
    ),
    "bounce_rate": (
        "SELECT organization_id, bucket, cast(count(*) FILTER (n = 1) AS double) * 100 / count(*) AS value "
        "FROM (SELECT organization_id, date_trunc('{i}', ts) AS bucket, session_id, count(*) AS n "
        "FROM ev GROUP BY ALL) GROUP BY ALL"
    ),
    "avg_session_duration": (
        "SELECT organization_id, bucket, avg(secs) AS value FROM (SELECT organization_id, "
        "date_trunc('{i}', ts) AS bucket, session_id, "
        "date_diff('microsecond', min(ts), max(ts)) / 1e6 AS secs FROM ev GROUP BY ALL) GROUP BY ALL"
    ),
}


def points_sql(metric: str, interval: str) -> str:
    points = _POINTS[metric].format(i=interval)
    return f"SELECT organization_id, cast(bucket AS timestamp) AS bucket, value FROM ({points})"


def series_sql(metric: str, interval: str) -> str:
    return (
        f"WITH {EV} SELECT organization_id, bucket, {r6('value')} AS value, "
        + r6(
            "avg(value) OVER (PARTITION BY organization_id ORDER BY bucket "
            "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
        )
        + " AS moving_average "
        f"FROM ({points_sql(metric, interval)})"
    )


def breakdown_sql(label: str, limit: int) -> str:
    return (
        f"WITH {EV}, c AS (SELECT organization_id, {label} AS label, count(*) AS count FROM ev GROUP BY ALL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY count DESC, label) AS ord, "
        "sum(count) OVER (PARTITION BY organization_id) AS total FROM c) "
        "SELECT organization_id, ord, label, count, "
        f"{r6('cast(count AS double) * 100 / total')} AS percentage "
        f"FROM r WHERE ord <= {limit}"
    )


ORACLES = {
    "overview": (
        f"WITH {EV}, one AS (SELECT organization_id, 'all' AS period, TIMESTAMP '2024-01-01' AS lo, "
        f"TIMESTAMP '2024-01-31' AS hi FROM {ORGS}), {period_sql('one')} "
        f"SELECT organization_id, page_views, unique_visitors, {r6('bounce_rate')} AS bounce_rate, "
        f"{r6('avg_session_duration')} AS avg_session_duration FROM met"
    ),
    "overview_delta": (
        f"WITH {EV}, {TWO_PERIODS}{ORGS}), {period_sql('two')} " + pair_sql("cur", "prior")
    ),
    "shared_overview": (
        f"WITH {EV}, {DASHBOARDS}, {TWO_PERIODS}(SELECT organization_id FROM dashboards "
        f"WHERE share_token = '{SHARE_TOKEN}' AND is_public AND NOT is_deleted)), {period_sql('two')} "
        + pair_sql("cur", "prior")
    ),
    "breakdown": breakdown_sql("coalesce(k, 'unknown')", 10),
    "breakdown_visitor": breakdown_sql("visitor_id", 100),
    "breakdown_missing": breakdown_sql("'unknown'", 10),
    "breakdown_top_share": (
        f"SELECT *, round(cast(count AS double) * 100 / sum(count) OVER (PARTITION BY organization_id), 1) "
        f"AS share FROM ({breakdown_sql('k', 5)})"
    ),
    "chart_merge": (
        f"WITH {EV}, a AS ({points_sql('page_views', 'hour')}), b AS ({points_sql('unique_visitors', 'hour')}) "
        "SELECT organization_id, bucket, coalesce(a.value, 0) AS page_views, coalesce(b.value, 0) AS unique_visitors "
        "FROM a FULL JOIN b USING (organization_id, bucket)"
    ),
    "tail_points": (
        f"WITH s AS ({series_sql('unique_visitors', 'day')}), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY bucket DESC) AS b FROM s) "
        "SELECT organization_id, bucket, value, moving_average, row_number() OVER "
        "(PARTITION BY organization_id ORDER BY bucket) AS ord FROM r WHERE b <= 8"
    ),
    "bar_heights": (
        f"WITH s AS ({series_sql('page_views', 'day')}), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY bucket DESC) AS b, "
        "max(value) OVER (PARTITION BY organization_id) AS m FROM s) "
        "SELECT organization_id, bucket, value, moving_average, cast(trunc(value / "
        "CASE WHEN m = 0 THEN 1 ELSE m END * 100) AS bigint) AS height, row_number() OVER "
        "(PARTITION BY organization_id ORDER BY bucket) AS ord FROM r WHERE b <= 12"
    ),
    "error_rate": (
        f"WITH {EV} SELECT organization_id, count(*) FILTER (event_name = 'error') AS error_count, "
        + r6("cast(count(*) FILTER (event_name = 'error') AS double) * 100 / count(*)")
        + " AS error_rate FROM ev GROUP BY ALL"
    ),
    "event_frequency": (
        f"WITH {EV} SELECT organization_id, event_name, count(*) AS event_count FROM ev GROUP BY ALL"
    ),
    "partition_counts": (
        "SELECT cast(date_trunc('month', ts) AS date) AS event_month, count(*) AS row_count "
        "FROM events GROUP BY ALL"
    ),
    "partition_calendar": (
        "WITH m AS (SELECT cast(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-04-01', "
        "INTERVAL 1 MONTH)) AS date) AS range_from) "
        "SELECT range_from, 'events_y' || strftime(range_from, '%Ym%m') AS partition_name, "
        "cast(range_from + INTERVAL 1 MONTH AS date) AS range_to, (SELECT count(*) FROM events "
        "WHERE ts >= range_from AND ts < range_from + INTERVAL 1 MONTH) AS row_count FROM m"
    ),
    "event_page": (
        f"WITH {EV} SELECT id, event_name, ts AS timestamp FROM ev WHERE organization_id = 'org_1' "
        "ORDER BY ts DESC, id LIMIT 50 OFFSET 20"
    ),
    "event_page_after": (
        f"WITH {EV} SELECT id, event_name, ts AS timestamp FROM ev WHERE organization_id = 'org_1' "
        "AND ts <= TIMESTAMP '2024-01-09 12:00:00' ORDER BY ts DESC, id LIMIT 75"
    ),
    "visitor_sketch_day": (
        f"WITH {EV} SELECT organization_id, cast(date_trunc('day', ts) AS timestamp) AS bucket, count(*) AS events, "
        "count(*) FILTER (event_name = 'page_view') AS page_views, count(*) FILTER (event_name = 'error') AS error_count, "
        "true AS within_bound FROM ev GROUP BY ALL"
    ),
    "visitor_sketch_ranges": (
        f"WITH {EV}, r AS (SELECT organization_id, range_end - INTERVAL 7 DAY AS range_start, range_end FROM "
        "(SELECT DISTINCT organization_id FROM ev), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', "
        "TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS range_end)) "
        "SELECT organization_id, range_start, range_end, count(*) AS events, "
        "count(*) FILTER (event_name = 'page_view') AS page_views, count(*) FILTER (event_name = 'error') AS error_count, "
        "true AS within_bound FROM ev JOIN r USING (organization_id) WHERE ts >= range_start AND ts < range_end GROUP BY ALL"
    ),
    "newest_per_org": (
        f"WITH {EV} SELECT * FROM (SELECT organization_id, row_number() OVER (PARTITION BY organization_id "
        "ORDER BY ts DESC, id) AS ord, id, ts AS timestamp FROM ev) WHERE ord <= 100"
    ),
}
ORACLES["overview_received"] = ORACLES["overview"]
ORACLES |= {name: series_sql(*spec) for name, spec in SERIES.items()}
ORACLES["chart_merge_series"] = ORACLES["chart_merge"]

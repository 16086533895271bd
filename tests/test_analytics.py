from datetime import datetime, timedelta

import pytest
from helpers import AS_OF, ago, event, events, local, rows, utc

from eventmetrics.functions import dates
from eventmetrics.operators import breakdown as bd
from eventmetrics.operators import overview as ov
from eventmetrics.operators import scope as sc
from eventmetrics.operators import series as se

DAY = ago(days=1)


def visit(session, user, browser, *ages):
    return [
        event("page_view", ago(**age), session_id=session, user_id=user, browser=browser, path="/")
        for age in ages
    ]


@pytest.fixture(scope="module")
def site(spark):
    return events(
        spark,
        visit("sess_1", "user_1", "Chrome", {"hours": 2}, {"hours": 2, "minutes": 5}, {"hours": 2, "minutes": 10})
        + visit("sess_2", "user_2", "Firefox", {"hours": 4})
        + visit("sess_3", "user_3", "Chrome", {"hours": 6}, {"hours": 6, "minutes": 5})
        + visit("sess_4", "user_4", "Safari", {"hours": 26}, {"hours": 26, "minutes": 3, "seconds": 20})
        + visit("sess_5", "user_5", "Firefox", {"hours": 30}),
    ).cache()


def test_overview_and_changes(site):
    found = ov.overview_delta(site, DAY, AS_OF).collect()
    assert len(found) == 1
    one = found[0]
    assert (one.page_views, one.unique_visitors) == (6, 3)
    assert one.bounce_rate == pytest.approx(100 / 3)
    assert one.avg_session_duration == pytest.approx(300.0)
    assert one.page_views_change == 100.0
    assert one.unique_visitors_change == 50.0
    assert one.bounce_rate_change == -33.33
    assert one.avg_session_duration_change == 200.0


def test_overview_alone_equals_current_period(site):
    alone = ov.overview(site, DAY, AS_OF).first()
    both = ov.overview_delta(site, DAY, AS_OF).first()
    for metric in ov.OVERVIEW_METRICS:
        assert alone[metric] == both[metric]


def test_breakdown(site):
    found = rows(bd.breakdown(site, "browser", DAY, AS_OF), "label", "count", "percentage", "ord")
    assert [(f[0], f[1], round(f[2], 2), f[3]) for f in found] == [
        ("Chrome", 5, 83.33, 1),
        ("Firefox", 1, 16.67, 2),
    ]


def test_breakdown_ties_missing_and_limit(spark):
    table = events(
        spark,
        [event("x", AS_OF, b="b"), event("x", AS_OF, b="a"), event("x", AS_OF, b=None), event("x", AS_OF)],
    )
    top = bd.breakdown(table, "b", DAY, AS_OF, limit=2)
    assert rows(top, "ord", "label", "count", "percentage") == [(1, "unknown", 2, 50.0), (2, "a", 1, 25.0)]
    shares = rows(bd.top_share(top), "label", "share")
    assert shares == [("a", 33.3), ("unknown", 66.7)]
    for limit in (0, 101):
        with pytest.raises(ValueError):
            bd.breakdown(table, "b", DAY, AS_OF, limit=limit)


def test_property_keys_and_types(spark):
    table = events(
        spark,
        [event("x", AS_OF, **{"a.b": "dot", "it's?": True, "n": 7, "o": {"x": 1}, "l": [1, 2]})],
    )
    for key, label in (("a.b", "dot"), ("it's?", "true"), ("n", "7"), ("o", '{"x":1}'), ("l", "[1,2]")):
        assert bd.breakdown(table, key, DAY, AS_OF).first().label == label


def test_identity_order_and_null_session(spark):
    table = events(
        spark,
        [
            event("page.view", ago(hours=1), user_id="u", visitor_id="v", anonymous_id="a"),
            event("click", ago(hours=2), visitor_id="u", session_id="s"),
            event("click", ago(hours=3), anonymous_id="w", session_id="s"),
            event("click", ago(hours=4)),
        ],
    )
    one = ov.overview(table, DAY, AS_OF).first()
    assert (one.page_views, one.unique_visitors) == (1, 2)
    assert (one.bounce_rate, one.avg_session_duration) == (0.0, 3600.0)


def test_bounds_are_inclusive_and_shared_by_both_periods(spark):
    table = events(
        spark,
        [event("page_view", t, user_id="u", session_id="s") for t in (AS_OF, DAY, ago(days=2))]
        + [event("page_view", ago(days=2, seconds=1), user_id="u", session_id="s")],
    )
    one = ov.overview_delta(table, DAY, AS_OF).first()
    assert (one.page_views, one.page_views_change) == (2, 0.0)
    assert one.avg_session_duration == 86400.0


def test_tenants_are_apart_and_empty_ones_listed(spark):
    table = events(
        spark,
        [
            event("page_view", AS_OF, org="a", user_id="u", session_id="s"),
            event("page_view", AS_OF, org="b", user_id="u", session_id="s"),
            event("page_view", ago(hours=30), org="c", user_id="u", session_id="s"),
        ],
    )
    orgs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "organization_id string")
    found = rows(
        ov.overview_delta(table, DAY, AS_OF, orgs), "organization_id", "page_views", "page_views_change"
    )
    assert found == [("a", 1, 100.0), ("b", 1, 100.0), ("c", 0, -100.0), ("d", 0, 0.0)]


def test_series_values_gaps_and_moving_average(spark):
    at = [utc(2026, 5, 20, h) for h in (1, 2, 5, 6, 7, 8, 9, 10)]
    table = events(
        spark,
        [event("page_view", t, user_id="u", session_id="s") for i, t in enumerate(at) for _ in range(i + 1)]
        + [event("click", utc(2026, 5, 20, 12), user_id="u")],
    )
    found = rows(
        se.timeseries(table, "page_views", "hour", ago(days=2), AS_OF), "bucket", "value", "moving_average"
    )
    assert [f[1] for f in found] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 0.0]
    assert [f[2] for f in found] == [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 33 / 7]
    assert found[2][0] == local(at[2])
    sessions = se.timeseries(table, "bounce_rate", "hour", ago(days=2), AS_OF)
    assert [r[1] for r in rows(sessions, "bucket", "value")] == [100.0] + [0.0] * 7


def test_session_counts_in_each_bucket(spark):
    table = events(
        spark,
        [
            event("click", utc(2026, 5, 20, 1, 50), session_id="s"),
            event("click", utc(2026, 5, 20, 2, 10), session_id="s"),
            event("click", utc(2026, 5, 20, 2, 40), session_id="s"),
        ],
    )
    span = (ago(days=2), AS_OF)
    bounce = rows(se.timeseries(table, "bounce_rate", "hour", *span), "bucket", "value")
    length = rows(se.timeseries(table, "avg_session_duration", "hour", *span), "bucket", "value")
    assert [b[1] for b in bounce] == [100.0, 0.0]
    assert [d[1] for d in length] == [0.0, 1800.0]


def test_week_buckets_start_on_monday(spark):
    table = events(spark, [event("page_view", utc(2026, 5, 17, 23)), event("page_view", utc(2026, 5, 18, 0))])
    weeks = rows(se.timeseries(table, "page_views", "week", ago(days=10), AS_OF), "bucket")
    assert weeks == [(local(utc(2026, 5, 11)),), (local(utc(2026, 5, 18)),)]


@pytest.mark.parametrize("interval", dates.INTERVALS)
def test_all_metric_points_equal_single_series(site, interval):
    inside = sc.scope(site, ago(days=3), AS_OF).withColumn("bucket", dates.bucket(interval))
    together = se.all_metric_points(inside, ["organization_id", "bucket"])
    for metric in dates.METRICS:
        alone = se.timeseries(site, metric, interval, ago(days=3), AS_OF)
        assert rows(together.filter(f"metric = '{metric}'"), "bucket", "value") == rows(alone, "bucket", "value")


def test_unknown_interval_and_metric(site):
    with pytest.raises(ValueError):
        se.timeseries(site, "page_views", "decade", DAY, AS_OF)
    with pytest.raises(ValueError):
        se.timeseries(site, "revenue", "day", DAY, AS_OF)


def test_chart_merge_fills_both_sides(spark):
    layout = "organization_id string, bucket timestamp, value double"
    a = spark.createDataFrame([("o", utc(2026, 1, 1), 1.0), ("o", utc(2026, 1, 2), 2.0)], layout)
    b = spark.createDataFrame([("o", utc(2026, 1, 2), 5.0), ("o", utc(2026, 1, 3), 6.0)], layout)
    merged = se.chart_merge(a, b, "x", "y").collect()
    assert [(r.x, r.y) for r in merged] == [(1.0, 0.0), (2.0, 5.0), (0.0, 6.0)]


def test_tail_and_bars(spark):
    layout = "organization_id string, bucket timestamp, value double"
    series = spark.createDataFrame(
        [("o", utc(2026, 1, d), float(d)) for d in range(1, 16)] + [("z", utc(2026, 1, 1), 0.0)], layout
    )
    tail = rows(se.tail_points(series).filter("organization_id = 'o'"), "ord", "value")
    assert tail == [(i + 1, float(i + 8)) for i in range(8)]
    bars = rows(se.bar_heights(series).filter("organization_id = 'o'"), "ord", "height")
    assert sorted(bars) == [(i + 1, int((i + 4) / 15 * 100)) for i in range(12)]
    assert rows(se.bar_heights(series).filter("organization_id = 'z'"), "height") == [(0,)]


def test_range_defaults_and_interval():
    naive = datetime(2026, 5, 1, 8)
    assert dates.resolve_range(None, None, AS_OF) == (AS_OF - timedelta(days=30), AS_OF)
    assert dates.resolve_range(naive, None, AS_OF)[0] == utc(2026, 5, 1, 8)
    assert [dates.auto_interval(h) for h in (1, 24, 25, 720)] == ["hour", "hour", "day", "day"]


def test_share_token(spark, site):
    boards = spark.createDataFrame(
        [
            ("d1", "org_a", "n", True, "tok", False),
            ("d2", "org_a", "n", False, "private", False),
            ("d3", "org_a", "n", True, "gone", True),
        ],
        "id string, organization_id string, name string, is_public boolean, share_token string, is_deleted boolean",
    )
    assert sc.shared_events(site, boards, "tok").count() == site.count()
    for token in ("private", "gone", "none"):
        assert sc.shared_events(site, boards, token).count() == 0


def test_paging(site):
    from pyspark.sql import functions as F

    order = (F.desc("timestamp"), F.asc("id"))
    everything = [r.id for r in sc.page(site, *order).collect()]
    pages = [r.id for skip in (0, 4, 8) for r in sc.page(site, *order, skip=skip, limit=4).collect()]
    assert pages == everything
    per_org = rows(sc.page_per_org(site, *order, skip=2, limit=3), "ord", "id")
    assert [p[1] for p in per_org] == everything[2:5]

"""Many overlapping ranges from pieces, against one computation per range."""

import random
from datetime import timedelta

from helpers import AS_OF, ago, event, events, local

from pyspark.sql import functions as F

from eventmetrics.operators import dashboards as da
from eventmetrics.operators import overview as ov
from eventmetrics.operators import pieces as pc

CONFIGS = (
    ("kpi", "{}"),
    ("line", '{"metric_type":"bounce_rate","interval":"hour"}'),
    ("line", '{"metric_type":"avg_session_duration","interval":"day"}'),
    ("pie", '{"property_key":"browser","limit":9}'),
)


def visits(spark, seed=3):
    rng, rows = random.Random(seed), []
    for _ in range(400):
        given = {"session_id": f"s{rng.randrange(40)}", "visitor_id": f"v{rng.randrange(30)}"}
        for name in list(given):
            if rng.random() < 0.1:
                del given[name]
        at = ago(minutes=rng.randrange(0, 3000, 10))
        rows.append(event("page_view", at, rng.choice(["org_a", "org_b"]), browser=rng.choice("xyz"), **given))
    return events(spark, rows)


def spans():
    """Nested, overlapping, equal, touching and one-moment ranges; their ends meet events."""
    given = [(2000, 0), (1000, 0), (1500, 500), (500, 500), (1000, 500), (500, 0), (2000, 1990), (9000, 8000)]
    return [(ago(minutes=a), ago(minutes=b)) for a, b in given]


def placed(spark, ranges):
    rows = [
        (org, f"{org}{k}", f"w{n}", kind, config, start, end)
        for org in ("org_a", "org_b", "org_none")
        for k, (start, end) in enumerate(ranges)
        for n, (kind, config) in enumerate(CONFIGS)
    ]
    columns = "organization_id string, board string, widget_id string, type string, query_config string"
    return spark.createDataFrame(rows, f"{columns}, range_start timestamp, range_end timestamp")


def test_overlapping_ranges_equal_each_range_alone(spark):
    found = visits(spark).cache()
    keys = ["organization_id", "board", "widget_id"]
    together = da.evaluate_widgets(found, da.widget_requests(placed(spark, spans()[:5])), keys)
    got = sorted(map(tuple, together.collect()), key=repr)
    want = []
    for k, one in enumerate(spans()[:5]):
        alone = placed(spark, [one]).withColumn("board", F.concat("organization_id", F.lit(str(k))))
        want += map(tuple, da.evaluate_widgets(found, da.widget_requests(alone), keys).collect())
    assert got == sorted(want, key=repr)


def test_metrics_of_pieces_equal_the_plain_overview(spark):
    found = visits(spark, 4).cache()
    ranges = spark.createDataFrame(
        [(org, s, e, org, f"{k}") for org in ("org_a", "org_b") for k, (s, e) in enumerate(spans())],
        "organization_id string, range_start timestamp, range_end timestamp, request string, k string",
    ).withColumn("request", F.lit("kpi:page_views"))
    ranges = ranges.withColumns({"interval": F.lit("hour"), "property": F.lit("x")})
    asked = da.asked_ranges(ranges)
    pieces = pc.pieces_of(asked, "grain")
    first, last = pieces.agg(F.min("piece"), F.max("piece_end")).first()
    metrics = da.metric_results(pc.in_pieces(found, pieces, first, last), pieces, asked).collect()
    got = {(r.organization_id, r.range_start, r.range_end, r.label): (r.value, r.extra) for r in metrics}
    assert len(got) == 2 * len(spans()) * len(ov.OVERVIEW_METRICS) == len(metrics)
    for start, end in spans():
        plain = {r.organization_id: r for r in ov.overview_delta(found, start, end).collect()}
        for org in ("org_a", "org_b"):
            for m in ov.OVERVIEW_METRICS:
                want = (plain[org][m], plain[org][f"{m}_change"]) if org in plain else (0, 0)
                assert got[org, local(start), local(end), m] == want, (org, start, m)


def test_rows_do_not_grow_with_ranges(spark):
    found = visits(spark, 5)
    whole = [(ago(minutes=3000), AS_OF)]
    nested = whole + [(ago(minutes=3000 - 7 * k), AS_OF - timedelta(minutes=5 * k)) for k in range(1, 60)]
    for ranges in (whole, nested):
        asked = da.asked_ranges(
            da.widget_requests(placed(spark, ranges)).withColumn("request", F.lit("breakdown:browser"))
        )
        pieces = pc.pieces_of(asked, "property")
        first, last = pieces.agg(F.min("piece"), F.max("piece_end")).first()
        assert pc.in_pieces(found, pieces, first, last).count() == 400


def test_two_scans_of_the_events(spark, tmp_path):
    visits(spark).write.parquet(f"{tmp_path}/visits")
    stored = spark.read.parquet(f"{tmp_path}/visits")
    keys = ["organization_id", "board", "widget_id"]
    results = da.evaluate_widgets(stored, da.widget_requests(placed(spark, spans())), keys)
    plan = results._jdf.queryExecution().optimizedPlan().toString()
    assert sum("payload#" in line and "Relation" in line for line in plan.splitlines()) == 2


def test_no_requests(spark):
    keys = ["organization_id", "board", "widget_id"]
    assert da.evaluate_widgets(visits(spark), da.widget_requests(placed(spark, [])), keys).collect() == []

"""Dashboards: widgets of many dashboards and ranges, evaluated together."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from eventmetrics.functions.dates import INTERVALS, METRICS, mean_seconds, moment
from eventmetrics.functions.numbers import percent, percent_change
from eventmetrics.functions.payload import last_value, properties
from eventmetrics.operators.breakdown import label_counts, top_labels, top_share
from eventmetrics.operators.overview import OVERVIEW_METRICS
from eventmetrics.operators.pieces import (
    WHOLE,
    chains,
    in_pieces,
    labels_in_pieces,
    pieces_of,
    range_counts,
)
from eventmetrics.operators.scope import active
from eventmetrics.operators.series import chart_rows
from eventmetrics.session import work_dir

# Settings a widget may carry, their defaults, report sizes, and
# the widgets of the web analytics template.
QUERY_CONFIG = (
    "metric_type string, interval string, property_key string, breakdown_property string, "
    "limit int, time_range string"
)
DEFAULT_METRIC = "page_views"
DEFAULT_INTERVAL = "hour"
DEFAULT_PROPERTY = "browser"
DEFAULT_LIMIT = 5
TABLE_POINTS = 8
BAR_POINTS = 12
TEMPLATE = "web_analytics"
TEMPLATE_NAME = "Web Analytics Console"
TEMPLATE_WIDGETS = (
    ("Page Views", "kpi", '{"x":0,"y":0,"w":3,"h":2}', '{"metric_type":"page_views","time_range":"24h"}'),
    ("Unique Visitors", "kpi", '{"x":3,"y":0,"w":3,"h":2}', '{"metric_type":"unique_visitors","time_range":"24h"}'),
    ("Bounce Rate", "kpi", '{"x":6,"y":0,"w":3,"h":2}', '{"metric_type":"bounce_rate","time_range":"24h"}'),
    (
        "Average Session Duration",
        "kpi",
        '{"x":9,"y":0,"w":3,"h":2}',
        '{"metric_type":"avg_session_duration","time_range":"24h"}',
    ),
    (
        "Hourly Page Views Trend",
        "line",
        '{"x":0,"y":2,"w":8,"h":4}',
        '{"metric_type":"page_views","interval":"hour","time_range":"24h"}',
    ),
    ("Browser Segmentation Breakdown", "pie", '{"x":8,"y":2,"w":4,"h":4}', '{"property_key":"browser","limit":5}'),
)

RANGE = ["organization_id", "range_start", "range_end"]


def dashboard_widgets(dashboards: DataFrame, widgets: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """Each live dashboard with its widgets; a dashboard without any keeps one row."""
    boards = active(dashboards).select(
        F.col("id").alias("dashboard_id"), "organization_id", F.col("name").alias("dashboard_name")
    )
    parts = active(widgets, include_deleted=keep_deleted).select(
        F.col("id").alias("widget_id"),
        "dashboard_id",
        F.col("name").alias("widget_name"),
        "type",
        "query_config",
    )
    return boards.join(parts, "dashboard_id", "left")


def web_analytics_template(
    orgs: DataFrame, template: str = TEMPLATE
) -> tuple[DataFrame, DataFrame]:
    """One template dashboard with its six widgets for each tenant."""
    if template.lower() != TEMPLATE:
        raise ValueError(f"unknown dashboard template: {template!r}")
    dashboard_id = F.concat(F.lit(f"{TEMPLATE}:"), F.col("organization_id"))
    boards = orgs.select("organization_id").distinct().select(
        dashboard_id.alias("id"),
        "organization_id",
        F.lit(TEMPLATE_NAME).alias("name"),
        F.lit(False).alias("is_public"),
        F.lit(None).cast("string").alias("share_token"),
        F.lit(False).alias("is_deleted"),
    )
    kinds = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(kind).alias("type"),
                F.lit(layout).alias("layout"),
                F.lit(config).alias("query_config"),
            )
            for name, kind, layout, config in TEMPLATE_WIDGETS
        ]
    )
    parts = boards.select(F.col("id").alias("dashboard_id"), F.posexplode(kinds)).select(
        F.concat_ws(":", "dashboard_id", F.col("pos") + 1).alias("id"),
        "dashboard_id",
        "col.*",
        F.lit(False).alias("is_deleted"),
    )
    return boards, parts


def widget_requests(placed: DataFrame) -> DataFrame:
    """Resolve each widget's settings and defaults.

    ``placed`` has one row per widget to evaluate with ``type``,
    ``query_config`` and the range. Pie and table widgets name their property
    under different keys; either key is taken.
    """
    config = F.from_json("query_config", QUERY_CONFIG)
    settings = placed.withColumn("_config", config).withColumn("type", F.lower("type"))

    def given(field: str, default: Column) -> Column:
        return F.coalesce(F.col(f"_config.{field}"), default)

    metric = given("metric_type", F.lit(DEFAULT_METRIC))
    return settings.withColumns(
        {
            "metric": metric,
            "interval": given("interval", F.lit(DEFAULT_INTERVAL)),
            "property": F.coalesce(
                F.when(F.col("type") == "table", F.col("_config.breakdown_property")),
                F.col("_config.property_key"),
                F.col("_config.breakdown_property"),
                F.lit(DEFAULT_PROPERTY),
            ),
            "limit": given("limit", F.lit(DEFAULT_LIMIT)),
        }
    ).drop("_config")


def _request_key() -> Column:
    """What a widget asks for; widgets asking for the same share one result."""
    metric, interval = F.col("metric"), F.col("interval")
    drawable = metric.isin(*METRICS) & interval.isin(*INTERVALS)
    return (
        F.when(F.col("type") == "kpi", F.concat_ws(":", F.lit("kpi"), metric))
        .when(
            F.col("type").isin("line", "bar") & drawable,
            F.concat_ws(":", F.lit("series"), interval, metric),
        )
        .when(
            F.col("type").isin("pie", "table"), F.concat_ws(":", F.lit("breakdown"), F.col("property"))
        )
    )


def _result(
    rows: DataFrame, request: Column, section: Column, ord: Column, label: Column, value: Column, extra: Column
) -> DataFrame:
    return rows.select(
        *RANGE,
        request.alias("request"),
        section.alias("section"),
        ord.cast("bigint").alias("ord"),
        label.cast("string").alias("label"),
        value.cast("double").alias("value"),
        extra.cast("double").alias("extra"),
    )


def asked_ranges(asked: DataFrame) -> DataFrame:
    """What the requests need of which time: (RANGE, low, high, period, grain, property), each once.

    Metrics have a grain, the whole range or an interval, and breakdowns a
    property. A KPI also needs the range of equal length before its own; an
    event at its very start is in both.
    """
    start, end = F.unix_micros("range_start"), F.unix_micros("range_end")
    kind = F.split_part("request", F.lit(":"), F.lit(1))
    text = F.lit(None).cast("string")

    def part(when: str, low: Column, high: Column, period: str, grain: Column, prop: Column) -> DataFrame:
        return asked.filter(kind == when).select(
            *RANGE,
            low.alias("low"),
            (high + 1).alias("high"),
            F.lit(period).alias("period"),
            grain.alias("grain"),
            prop.alias("property"),
        )

    return (
        part("kpi", start, end, "cur", F.lit(WHOLE), text)
        .unionAll(part("kpi", 2 * start - end, start, "prior", F.lit(WHOLE), text))
        .unionAll(part("series", start, end, "cur", F.col("interval"), text))
        .unionAll(part("breakdown", start, end, "cur", text, F.col("property")))
        .distinct()
    )


def metric_results(events: DataFrame, pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """KPIs with their change, and last points and scaled bars of each asked series, from one scan."""
    counts = range_counts(chains(events, pieces), ranges, RANGE, ("cur", "prior"))

    def value(metric: str, period: str) -> Column:
        if metric == "bounce_rate":
            return percent(F.col(f"{period}_bounces"), F.col(f"{period}_sessions"))
        if metric == "avg_session_duration":
            mean = mean_seconds(F.col(f"{period}_micros"), F.col(f"{period}_sessions"))
            return F.coalesce(mean, F.lit(0.0))
        return F.col(f"{period}_{metric}").cast("double")

    whole = F.col("grain") == WHOLE
    lines = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                value(m, "cur").alias("value"),
                F.when(whole, percent_change(value(m, "cur"), value(m, "prior"))).alias("change"),
            )
            for m in OVERVIEW_METRICS
        ]
    )
    needs_session = F.col("metric").isin("bounce_rate", "avg_session_duration")
    points = counts.select(*RANGE, "grain", "bucket", "cur_sessions", F.inline(lines)).filter(
        whole | ~needs_session | (F.col("cur_sessions") > 0)
    )
    # A KPI is a series of one point.
    shown = chart_rows(points, (*RANGE, "grain", "metric"), TABLE_POINTS, BAR_POINTS, keep=("change",))
    return _result(
        shown.filter(~whole | (F.col("section") == "point")),
        F.when(whole, F.concat_ws(":", F.lit("kpi"), "metric")).otherwise(
            F.concat_ws(":", F.lit("series"), "grain", "metric")
        ),
        F.when(whole, F.lit("kpi")).otherwise(F.col("section")),
        F.col("ord"),
        F.when(whole, F.col("metric")).otherwise(F.date_format("bucket", "yyyy-MM-dd HH:mm")),
        F.col("value"),
        F.when(whole, F.col("change")).otherwise(F.col("height")),
    )


def breakdown_results(events: DataFrame, pieces: DataFrame, ranges: DataFrame, limit: int) -> DataFrame:
    """Top labels of each asked property with their share of all rows.

    An event's payload is parsed once; it then counts once for each property
    asked of its piece, whatever the number of ranges.
    """
    by = [*RANGE, "property"]
    parsed = events.select("organization_id", "piece", properties().alias("_properties"))
    labels = labels_in_pieces(parsed, pieces, last_value("_properties", F.col("property")))
    inside = (F.col("low") <= F.col("piece")) & (F.col("piece") < F.col("high"))
    met = labels.join(ranges, ["organization_id", "property"]).filter(inside)
    return _result(
        top_labels(label_counts(met.select(*by, "label", "rows"), by, F.col("rows")), by, limit),
        F.concat_ws(":", F.lit("breakdown"), "property"),
        F.lit("breakdown"),
        F.col("ord"),
        F.col("label"),
        F.col("count"),
        F.col("percentage"),
    )


def _written(table: DataFrame, label: str) -> DataFrame:
    """A config-derived table in the shared folder: computed once, and of known size when it is joined."""
    path = work_dir(table.sparkSession, label)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def evaluate_widgets(
    events: DataFrame, requests: DataFrame, keys: list[str]
) -> DataFrame:
    """All widgets as one long table (``keys``, section, ord, label, value, extra).

    ``extra`` is the change of a KPI, the height of a bar or the share of a
    label: a pie shows shares of the returned rows, a table of all rows.
    Every distinct KPI, series and breakdown is computed once per tenant and
    range and then joined to the widgets asking for it. All ranges are cut into
    pieces (``pieces``), and events are counted per piece: one scan gives all
    metrics and one all breakdowns, however many ranges overlap. Widgets of an unknown
    type, a wrong series or without data give one notice row and do not fail
    the others.
    """
    asked = _written(requests.withColumn("request", _request_key()), "widget-requests")
    ranges = asked_ranges(asked)
    pieces = _written(pieces_of(ranges, "grain", "property"), "widget-pieces")
    limit = asked.agg(F.coalesce(F.max("limit"), F.lit(0))).first()[0]
    first, last = pieces.agg(F.coalesce(F.min("piece"), F.lit(0)), F.coalesce(F.max("piece_end"), F.lit(0))).first()

    def needed(kind: str, other: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        own = pieces.filter(F.col(kind).isNotNull())
        return in_pieces(events, own, first, last), own, ranges.filter(F.col(kind).isNotNull()).drop(other)

    metrics = metric_results(*needed("grain", "property"))
    labels = breakdown_results(*needed("property", "grain"), max(limit, 1))
    results = metrics.unionByName(labels)
    keyed = results.withColumnsRenamed({name: f"_{name}" for name in (*RANGE, "request")})
    same = F.lit(True)
    for name in (*RANGE, "request"):
        same = same & (F.col(name) == F.col(f"_{name}"))
    # Part of the join: a widget whose limit leaves no row keeps its notice.
    shown = (F.col("section") != "breakdown") | (F.col("ord") <= F.col("limit"))
    found = asked.join(keyed, same & shown, "left")
    found = top_share(found.withColumn("count", F.col("value")), tuple([*keys, "section"]))
    kind = F.col("type")
    has_result = F.col("section").isNotNull()
    unknown_kpi = (kind == "kpi") & ~has_result
    notice = (
        F.when(~kind.isin("kpi", "line", "bar", "pie", "table"), F.lit("unsupported"))
        .when(F.col("request").isNull(), F.lit("error"))
        .when(unknown_kpi, F.lit("kpi"))
        .otherwise(F.lit("empty"))
    )
    notice_label = (
        F.when(unknown_kpi, F.col("metric"))
        .when(notice == "error", F.concat_ws(" by ", "metric", "interval"))
        .otherwise(kind)
    )
    zero = F.when(unknown_kpi, F.lit(0.0))
    return found.select(
        *keys,
        F.when(~has_result, notice)
        .when(F.col("section") == "breakdown", kind)
        .otherwise(F.col("section"))
        .alias("section"),
        F.when(has_result, F.col("ord")).otherwise(F.lit(1)).cast("bigint").alias("ord"),
        F.when(has_result, F.col("label")).otherwise(notice_label).alias("label"),
        F.when(has_result, F.col("value")).otherwise(zero).alias("value"),
        F.when(kind == "pie", F.when(has_result, F.col("share")))
        .when(has_result, F.col("extra"))
        .otherwise(zero)
        .alias("extra"),
    )


def widget_results(
    events: DataFrame, dashboards: DataFrame, widgets: DataFrame, start: datetime, end: datetime
) -> DataFrame:
    """Every widget of every live dashboard over one range."""
    placed = (
        dashboard_widgets(dashboards, widgets)
        .filter(F.col("widget_id").isNotNull())
        .withColumns({"range_start": moment(start), "range_end": moment(end)})
    )
    keys = ["organization_id", "dashboard_id", "widget_id"]
    return evaluate_widgets(events, widget_requests(placed), keys)

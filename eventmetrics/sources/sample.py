"""The engine's model over the sample star-schema tables.

Events come from ``events``; config tables are derived from the dimension
tables, so their size follows the data. ``*_COLUMNS`` are SQL expressions valid
in Spark and in DuckDB: the checks build the same inputs from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_COLUMNS = [
    "cast(event_id as string) AS id",
    "'org_' || cast(user_id % 4 as string) AS organization_id",
    "CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS event_name",
]

RULE_COLUMNS = [
    "'rule_' || cast(c_custkey as string) AS id",
    "'org_' || cast(c_custkey % 5 as string) AS organization_id",
    "c_name AS name",
    "c_nationkey <> 9 AS is_enabled",
    "CASE c_custkey % 7 WHEN 0 THEN 'page_views' WHEN 1 THEN 'error_count' "
    "WHEN 2 THEN 'error_rate' WHEN 3 THEN 'unique_visitors' WHEN 4 THEN 'bounce_rate' "
    "WHEN 5 THEN 'avg_session_duration' ELSE 'latency' END AS metric_type",
    "CASE cast(floor(c_custkey / 7.0) as bigint) % 6 WHEN 0 THEN '>' WHEN 1 THEN '<' "
    "WHEN 2 THEN '>=' WHEN 3 THEN '<=' WHEN 4 THEN '==' ELSE '!=' END AS operator",
    "floor(abs(c_acctbal) / CASE c_custkey % 7 WHEN 5 THEN 0.2e0 ELSE 100.0e0 END) AS threshold",
    "cast(CASE c_nationkey % 5 WHEN 0 THEN 60 WHEN 1 THEN 1440 WHEN 2 THEN 10080 "
    "WHEN 3 THEN 21600 ELSE 43200 END as int) AS time_window_minutes",
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'Triggered' WHEN 'MACHINERY' THEN 'Muted' "
    "ELSE 'Resolved' END AS current_state",
    "CASE WHEN c_mktsegment <> 'MACHINERY' OR c_custkey % 3 = 0 THEN NULL "
    "WHEN c_custkey % 3 = 1 THEN TIMESTAMP '2024-01-31 01:00:00' "
    "ELSE TIMESTAMP '2024-01-30 23:00:00' END AS muted_until",
    "CASE WHEN c_custkey % 3 = 0 THEN 'https://hooks.example.com/' || cast(c_custkey as string) END "
    "AS slack_webhook",
    "CASE WHEN c_custkey % 2 = 0 THEN 'team' || cast(c_custkey as string) || '@example.com' END "
    "AS email_recipient",
    "c_acctbal < -900 AS is_deleted",
]

DASHBOARD_COLUMNS = [
    "'dash_' || cast(s_suppkey as string) AS id",
    "'org_' || cast(s_suppkey % 5 as string) AS organization_id",
    "s_name AS name",
    "s_nationkey % 2 = 0 AS is_public",
    "CASE WHEN s_nationkey % 2 = 0 THEN 'share_' || cast(s_suppkey as string) END AS share_token",
    "s_acctbal < 0 AS is_deleted",
]

WIDGET_COLUMNS = [
    "'widget_' || cast(p_partkey as string) AS id",
    "'dash_' || cast(p_partkey % 100 as string) AS dashboard_id",
    "p_name AS name",
    "CASE p_size % 8 WHEN 0 THEN 'gauge' WHEN 1 THEN 'kpi' WHEN 2 THEN 'line' WHEN 3 THEN 'bar' "
    "WHEN 4 THEN 'pie' WHEN 5 THEN 'table' WHEN 6 THEN 'KPI' ELSE 'line' END AS type",
    "CASE p_size % 8 "
    "WHEN 1 THEN '{\"metric_type\":\"' || CASE p_partkey % 4 WHEN 0 THEN 'page_views' "
    "WHEN 1 THEN 'unique_visitors' WHEN 2 THEN 'bounce_rate' ELSE 'avg_session_duration' END || '\"}' "
    "WHEN 2 THEN '{\"metric_type\":\"' || CASE p_partkey % 3 WHEN 0 THEN 'unique_visitors' "
    "WHEN 1 THEN 'bounce_rate' ELSE 'avg_session_duration' END || '\",\"interval\":\"' || "
    "CASE p_partkey % 2 WHEN 0 THEN 'day' ELSE 'week' END || '\"}' "
    "WHEN 3 THEN '{\"interval\":\"day\",\"time_range\":\"24h\"}' "
    "WHEN 4 THEN '{\"property_key\":\"k\",\"limit\":' || cast(p_partkey % 9 + 1 as string) || '}' "
    "WHEN 5 THEN '{\"breakdown_property\":\"user_id\"}' "
    "WHEN 7 THEN '{\"metric_type\":\"latency\"}' "
    "ELSE '{}' END AS query_config",
    "p_retailprice > 995 AS is_deleted",
]

SCHEDULE_COLUMNS = [
    "'sched_' || cast(s_suppkey as string) AS id",
    "'org_' || cast(s_suppkey % 5 as string) AS organization_id",
    "CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 "
    "THEN 'dash_' || cast(s_suppkey + 1 as string) ELSE 'dash_' || cast(s_suppkey as string) END "
    "AS dashboard_id",
    "s_name AS name",
    "CASE s_nationkey % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'Weekly' WHEN 2 THEN 'monthly' "
    "WHEN 3 THEN 'hourly' ELSE 'weekly' END AS frequency",
    "s_nationkey <> 7 AS is_active",
    "s_acctbal > 9500 AS is_deleted",
]

# Order dates end in 1998; moved so that the newest runs end in January 2024.
RUN_COLUMNS = [
    "cast(o_orderkey as string) AS id",
    "'sched_' || cast(o_custkey % 100 as string) AS report_schedule_id",
    "'org_' || cast(o_custkey % 5 as string) AS organization_id",
    "o_orderdate + INTERVAL '8217' DAY AS triggered_at",
    "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status",
    "o_orderpriority = '5-LOW' AS is_deleted",
]

KEY_COLUMNS = [
    "'org_' || cast(s_suppkey % 5 as string) AS organization_id",
    "s_name AS name",
    "'pk_live_' || lpad(cast(s_suppkey as string), 8, '0') AS prefix",
    "'pk_live_' || lpad(cast(s_suppkey as string), 8, '0') || "
    "CASE WHEN s_nationkey % 4 = 0 THEN '-A' ELSE '-N' END AS secret",
    "s_nationkey <> 3 AS is_active",
    "CASE WHEN s_nationkey % 6 = 1 THEN TIMESTAMP '1996-01-01 00:00:00' END AS expires_at",
    "s_acctbal < -800 AS is_deleted",
]

REQUEST_COLUMNS = [
    "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || "
    "cast(l_partkey as string) || '-' || cast(l_suppkey as string) AS request_id",
    "l_shipdate AS received_at",
    "CASE WHEN l_linenumber = 7 THEN 'key_' || cast(l_suppkey as string) "
    "ELSE 'pk_live_' || lpad(cast(l_suppkey as string), 8, '0') || '-' || l_returnflag END AS api_key",
    "'pk_live_' || l_returnflag || l_linestatus AS caller",
]

SOURCE_COLUMNS = [
    "'src_' || cast(n_nationkey as string) AS id",
    "'org_' || cast(n_nationkey % 4 as string) AS organization_id",
    "n_name AS name",
    "CASE n_nationkey % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'csv' ELSE 'webhook' END AS type",
    "CASE WHEN n_nationkey % 2 = 0 THEN 'event_type' END AS name_key",
    "n_regionkey <> 2 AS is_active",
    "n_nationkey = 5 AS is_deleted",
]

MEMBERSHIP_COLUMNS = [
    "cast(c_custkey as string) AS user_id",
    "'org_' || cast(c_nationkey % 4 as string) AS organization_id",
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'admin' "
    "WHEN 'FURNITURE' THEN 'analyst' ELSE 'viewer' END AS role",
    "c_acctbal < 0 AS is_deleted",
]

ATTEMPT_COLUMNS = [
    "cast(o_orderkey as string) AS attempt_id",
    "cast(o_custkey as string) AS user_id",
    "'org_' || cast(o_orderkey % 4 as string) AS organization_id",
    "o_custkey = 7 AS is_superuser",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_events(raw: DataFrame, stored: bool = False) -> DataFrame:
    """Rows of the sample ``events`` table (batch or stream) in the event model.

    ``stored`` adds the identity columns the event store keeps next to the
    payload; without them a query parses the payload.
    """
    ts = F.col("ts").cast("timestamp")
    visitor = F.col("user_id").cast("string")
    session = F.concat_ws("-", "user_id", F.date_format(ts, "yyyyMMdd"))
    k = F.get_json_object("props", "$.k")
    payload = F.to_json(
        F.struct(visitor.alias("user_id"), session.alias("session_id"), k.alias("k"))
    )
    identity = [session.alias("session_id"), visitor.alias("visitor_id")] if stored else []
    return raw.select(
        *[F.expr(c) for c in EVENT_COLUMNS],
        F.lit(None).cast("string").alias("data_source_id"),
        ts.alias("timestamp"),
        payload.alias("payload"),
        ts.alias("created_at"),
        *identity,
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the store returns them."""
    return as_events(table(spark, sf_dir, "events"), stored=True)


def received_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive, with nothing but the payload to identify them."""
    return as_events(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events read as a stream of files."""
    layout = table(spark, sf_dir, "events").schema
    # A stream source takes a single file only as a pattern.
    return as_events(spark.readStream.schema(layout).parquet(f"{sf_dir}/events.parque[t]"))


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "customer").selectExpr(*RULE_COLUMNS)
    return rules.withColumn("threshold", F.col("threshold").cast("double"))


def dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*DASHBOARD_COLUMNS)


def widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*WIDGET_COLUMNS)


def report_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*SCHEDULE_COLUMNS)


def report_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").selectExpr(*RUN_COLUMNS)
    return runs.withColumn("triggered_at", F.col("triggered_at").cast("timestamp"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").selectExpr(*KEY_COLUMNS)
    return keys.withColumn("hashed_key", F.sha2("secret", 256)).drop("secret")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").selectExpr(*REQUEST_COLUMNS)
    return raw.withColumn("received_at", F.col("received_at").cast("timestamp"))


def data_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "nation").selectExpr(*SOURCE_COLUMNS)
    config = F.when(F.col("name_key").isNotNull(), F.create_map(F.lit("event_name_path"), "name_key"))
    return sources.withColumn("config", config).drop("name_key")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*MEMBERSHIP_COLUMNS)


def access_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*ATTEMPT_COLUMNS)

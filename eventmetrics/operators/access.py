"""Who may write and read: keys, request limits, sources, memberships, slugs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmetrics.functions.dates import moment
from eventmetrics.functions.text import slug_base
from eventmetrics.operators.scope import MAX_SMALL_ROWS, active, small_side
from eventmetrics.sources.events import split, whole_batches

# Key format, default request limit, role levels.
KEY_PREFIX = "pk_live_"
KEY_PREFIX_LENGTH = 16
REQUESTS_PER_MINUTE = 100
ROLE_LEVELS = {"owner": 4, "admin": 3, "analyst": 2, "viewer": 1}


def key_verdicts(raw: DataFrame, api_keys: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Find the tenant of each request by its ``api_key``.

    Adds ``key_prefix``, ``organization_id`` (of accepted requests only) and
    ``reason``. Two active keys with one prefix are refused as ambiguous.
    """
    known = (
        active(api_keys)
        .filter("is_active")
        .groupBy(F.col("prefix").alias("key_prefix"))
        .agg(
            F.count(F.lit(1)).alias("_keys"),
            F.min(F.struct("organization_id", "hashed_key", "expires_at")).alias("_key"),
        )
    )
    key = F.col("api_key")
    well_formed = key.startswith(KEY_PREFIX) & (F.length(key) >= KEY_PREFIX_LENGTH)
    reason = (
        F.when(key.isNull(), "missing_key")
        .when(~well_formed, "invalid_format")
        .when(F.col("_key").isNull(), "unknown_key")
        .when(F.col("_keys") > 1, "ambiguous_key")
        .when(F.col("_key.hashed_key") != F.sha2(key, 256), "invalid_key")
        .when(F.col("_key.expires_at") < moment(as_of), "expired_key")
    )
    return (
        raw.withColumn("key_prefix", F.substring(key, 1, KEY_PREFIX_LENGTH))
        .join(known, "key_prefix", "left")
        .withColumn("reason", reason)
        .withColumn(
            "organization_id", F.when(F.col("reason").isNull(), F.col("_key.organization_id"))
        )
        .drop("_key", "_keys")
    )


def attribute_keys(
    raw: DataFrame, api_keys: DataFrame, as_of: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    return split(key_verdicts(raw, api_keys, as_of))


def admission_verdicts(
    requests: DataFrame,
    limit: int = REQUESTS_PER_MINUTE,
    prefix: str = "key_prefix",
    arrival: str = "received_at",
    request_id: str = "request_id",
    used: DataFrame | None = None,
) -> DataFrame:
    """Refuse all but the first ``limit`` requests per key and UTC minute.

    Requests already having a ``reason`` neither count nor change. ``used``
    (prefix, minute, used) holds requests counted before, as a stream needs;
    refused ones count too.

    Requests are counted first, and only key-minutes above the limit are
    looked at again: the rank filter keeps ``limit`` rows per task and
    key-minute, the last admitted request becomes the cutoff, and all requests
    are compared with the cutoffs. No request is moved between machines unless
    there are very many busy key-minutes, and no key-minute fills one task.
    """
    keys = [prefix, "_minute"]
    timed = requests.withColumn("_minute", F.date_trunc("minute", F.col(arrival)))
    if "reason" not in requests.columns:
        timed = timed.withColumn("reason", F.lit(None).cast("string"))
    counted = timed.filter(F.col("reason").isNull()).select(*keys, arrival, request_id)
    busy = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_requests"))
    left_over = F.lit(limit).cast("bigint")
    if used is not None:
        before = used.select(prefix, F.col("minute").alias("_minute"), F.col("used").alias("_used"))
        busy = busy.join(before, keys, "left")
        left_over = left_over - F.coalesce(F.col("_used"), F.lit(0))
    busy = (
        busy.withColumn("_free", left_over)
        .filter(F.col("_requests") > F.col("_free"))
        .select(*keys, "_free")
    )
    groups = busy.limit(MAX_SMALL_ROWS + 1).count()
    order = Window.partitionBy(*keys).orderBy(arrival, request_id)

    def first_ones(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)

    if groups <= MAX_SMALL_ROWS:
        ranked = first_ones(counted.join(F.broadcast(busy), keys))
    else:
        # Joining first would shuffle whole key-minutes; ranking first cuts them per task.
        ranked = first_ones(counted).join(busy, keys)
    last = ranked.filter(F.col("_rank") == F.greatest(F.col("_free"), F.lit(1)))
    position = F.struct(F.col(arrival), F.col(request_id))
    cutoffs = last.select(*keys, "_free", position.alias("_cut"))
    late = F.col("_cut").isNotNull() & ((F.col("_free") <= 0) | (position > F.col("_cut")))
    return (
        timed.join(small_side(cutoffs, groups), keys, "left")
        .withColumn("reason", F.coalesce("reason", F.when(late, F.lit("rate_limited"))))
        .drop("_minute", "_free", "_cut")
    )


def admit(requests: DataFrame, limit: int = REQUESTS_PER_MINUTE, **options) -> tuple[DataFrame, DataFrame]:
    """(admitted, throttled) of ``admission_verdicts``."""
    return split(admission_verdicts(requests, limit, **options))


def usable_sources(sources: DataFrame, source_type: str | None = None) -> DataFrame:
    usable = active(sources).filter("is_active")
    return usable if source_type is None else usable.filter(F.col("type") == source_type)


def gate_verdicts(
    events: DataFrame, sources: DataFrame, batch: str | None = None, source_type: str | None = None
) -> DataFrame:
    """Refuse events naming a source that is foreign, deleted, inactive or of another type.

    Events without a source pass. With ``batch``, one bad event refuses its batch.
    """
    known = usable_sources(sources, source_type).select(
        F.col("id").alias("data_source_id"), "organization_id", F.lit(True).alias("_known")
    )
    refused = F.col("data_source_id").isNotNull() & F.col("_known").isNull()
    checked = (
        events.join(known, ["data_source_id", "organization_id"], "left")
        .withColumn("reason", F.when(refused, F.lit("source_not_usable")))
        .select(*events.columns, "reason")
    )
    return whole_batches(checked, batch) if batch else checked


def gate_sources(
    events: DataFrame, sources: DataFrame, batch: str | None = None, source_type: str | None = None
) -> tuple[DataFrame, DataFrame]:
    return split(gate_verdicts(events, sources, batch, source_type))


def role_level(role: Column) -> Column:
    level = F.lit(0)
    for name, value in ROLE_LEVELS.items():
        level = F.when(role == name, F.lit(value)).otherwise(level)
    return level


def entitled(
    events: DataFrame, memberships: DataFrame, user: str, role: str = "viewer", superuser: bool = False
) -> DataFrame:
    """Events of all tenants in which ``user`` has at least ``role``; all for a superuser."""
    if superuser:
        return events
    held = active(memberships).filter(
        (F.col("user_id") == user) & (role_level(F.col("role")) >= ROLE_LEVELS[role])
    )
    return events.join(held, "organization_id", "left_semi")


def access_verdicts(attempts: DataFrame, memberships: DataFrame, role: str) -> DataFrame:
    """``allowed``, ``not_a_member`` or ``role_too_low`` for each (user, tenant) attempt."""
    held = (
        active(memberships)
        .groupBy("user_id", "organization_id")
        .agg(F.max(role_level(F.col("role"))).alias("_level"))
    )
    verdict = (
        F.when(F.coalesce(F.col("is_superuser"), F.lit(False)), "allowed")
        .when(F.col("_level").isNull(), "not_a_member")
        .when(F.col("_level") < ROLE_LEVELS[role], "role_too_low")
        .otherwise("allowed")
    )
    return (
        attempts.join(held, ["user_id", "organization_id"], "left")
        .withColumn("verdict", verdict)
        .drop("_level")
    )


def slugs(organizations: DataFrame) -> DataFrame:
    """A unique ``slug`` per organization.

    The lowest id keeps the plain slug; the others append their own id after
    ``--``. Plain slugs never contain two hyphens in a row, so no suffixed
    slug can meet another one. Only names used twice are joined back.
    """
    named = organizations.withColumn("_base", slug_base(F.col("name")))
    repeated = (
        named.groupBy("_base")
        .agg(F.count(F.lit(1)).alias("_uses"), F.min("id").alias("_first"))
        .filter(F.col("_uses") > 1)
        .drop("_uses")
    )
    slug = F.when(
        F.col("_first").isNull() | (F.col("id") == F.col("_first")), F.col("_base")
    ).otherwise(F.concat_ws("--", "_base", F.col("id").cast("string")))
    return named.join(repeated, "_base", "left").withColumn("slug", slug).drop("_base", "_first")

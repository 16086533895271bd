"""Many overlapping ranges from elementary pieces of time.

The ranges of a tenant are cut at all their ends. Between two cuts lies a
piece, and every range is a row of whole pieces. Each event is counted in its
one piece, however many ranges hold it. What counts once per range is found
from chains: the pieces in which one session or visitor occurs, in order. The
member of a chain at ``piece`` is the first within ``[low, high)`` if the one
before it lies before ``low``, and the only one if also the next lies beyond.
Chains are added up by (piece, before, behind), so ranges meet counts and never
events, sessions or visitors.

Times are microseconds since 1970; ranges hold their low end and not their high one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmetrics.functions.dates import micros_between
from eventmetrics.functions.payload import with_identity
from eventmetrics.operators.breakdown import label_of
from eventmetrics.operators.overview import keyed_rows
from eventmetrics.operators.scope import between

# The grain of metrics over a whole range; other grains are intervals.
WHOLE = "range"
COUNTS = ("page_views", "unique_visitors", "sessions", "bounces", "micros")


def pieces_of(ranges: DataFrame, *kinds: str) -> DataFrame:
    """Pieces (organization_id, piece, piece_end, ``kinds``) inside the ranges (organization_id, low, high, ``kinds``).

    A piece is named by its low end and given once for each kind that a range
    around it has; what lies in no range is no piece.
    """
    ends = F.explode(F.array("low", "high")).alias("piece")
    cuts = ranges.select("organization_id", ends).distinct()
    later = F.lead("piece").over(Window.partitionBy("organization_id").orderBy("piece"))
    parts = cuts.withColumn("piece_end", later).filter(F.col("piece_end").isNotNull())
    inside = (F.col("low") <= F.col("piece")) & (F.col("piece") < F.col("high"))
    return (
        parts.join(ranges, "organization_id")
        .filter(inside)
        .select("organization_id", "piece", "piece_end", *kinds)
        .distinct()
    )


def in_pieces(events: DataFrame, pieces: DataFrame, earliest: int, latest: int) -> DataFrame:
    """Events with their ``piece``, one row each; the bounds of all pieces reach the scan."""
    owner = pieces.select(F.col("organization_id").alias("_owner"), "piece", "piece_end").distinct()
    moment = F.unix_micros("timestamp")
    same = (F.col("organization_id") == F.col("_owner")) & (moment >= F.col("piece")) & (moment < F.col("piece_end"))
    scanned = between(events, F.timestamp_micros(F.lit(earliest)), F.timestamp_micros(F.lit(latest)))
    return scanned.join(owner, same).drop("_owner", "piece_end")


def chains(events: DataFrame, pieces: DataFrame) -> DataFrame:
    """Counts by (organization_id, grain, bucket, piece, before, behind).

    ``events`` carry their ``piece``. An event is repeated once for each grain
    that its piece is asked for in, of which there are as many as intervals.
    """
    grains = pieces.select("organization_id", "piece", "grain")
    bucket = F.when(F.col("grain") != WHOLE, F.expr("date_trunc(grain, timestamp)"))
    by = ["organization_id", "grain", "bucket"]
    asked = with_identity(events).join(grains, ["organization_id", "piece"]).withColumn("bucket", bucket)
    rows = keyed_rows(asked, [*by, "piece"])
    chain = Window.partitionBy(*by, "is_session", "session_id", "visitor_id").orderBy("piece")
    linked = rows.withColumns(
        {
            "before": F.lag("piece").over(chain),
            "behind": F.lead("piece").over(chain),
            "_gap": micros_between(F.lag("last_ts").over(chain), F.col("first_ts")),
        }
    )
    session = F.col("is_session") & F.col("session_id").isNotNull()
    visitor = ~F.col("is_session")

    def total(when: Column, value: Column | int) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("bigint")

    return linked.groupBy(*by, "piece", "before", "behind").agg(
        total(visitor, F.col("page_views")).alias("page_views"),
        total(visitor & F.col("visitor_id").isNotNull(), F.lit(1)).alias("unique_visitors"),
        total(session, F.lit(1)).alias("sessions"),
        total(session & (F.col("events") == 1), F.lit(1)).alias("bounces"),
        total(session, micros_between(F.col("first_ts"), F.col("last_ts"))).alias("micros"),
        total(session, F.col("_gap")).alias("gap"),
    )


def range_counts(links: DataFrame, ranges: DataFrame, by: list[str], periods: tuple[str, ...]) -> DataFrame:
    """COUNTS of each range (organization_id, grain, low, high, period) as columns ``<period>_<count>``.

    ``by`` are columns of the ranges that tell results apart; each result has
    one row for every bucket of its grain. A whole range without events has zeros.
    """
    none = [F.lit(0).cast("bigint").alias(c) for c in (*COUNTS, "gap")]
    no_time, no_piece = F.lit(None).cast("timestamp").alias("bucket"), F.lit(None).cast("bigint")
    empty = ranges.filter(F.col("grain") == WHOLE).select(
        "organization_id", "grain", no_time, F.col("low").alias("piece"), no_piece.alias("before"),
        no_piece.alias("behind"), *none,
    ).distinct()
    inside = (F.col("low") <= F.col("piece")) & (F.col("piece") < F.col("high"))
    met = links.unionByName(empty).join(ranges, ["organization_id", "grain"]).filter(inside)
    first = F.col("before").isNull() | (F.col("before") < F.col("low"))
    alone = first & (F.col("behind").isNull() | (F.col("behind") >= F.col("high")))
    parts = {
        "page_views": F.col("page_views"),
        "unique_visitors": F.when(first, F.col("unique_visitors")),
        "sessions": F.when(first, F.col("sessions")),
        "bounces": F.when(alone, F.col("bounces")),
        "micros": F.col("micros") + F.when(first, F.lit(0)).otherwise(F.col("gap")),
    }
    return met.groupBy(*by, "grain", "bucket").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("period") == p, part)), F.lit(0)).cast("bigint").alias(f"{p}_{name}")
            for p in periods
            for name, part in parts.items()
        ]
    )


def labels_in_pieces(rows: DataFrame, asked: DataFrame, value: Column) -> DataFrame:
    """Rows per (organization_id, property, piece, label); ``rows`` carry their piece, ``asked`` has its properties."""
    wanted = asked.select("organization_id", "piece", "property")
    return (
        rows.join(wanted, ["organization_id", "piece"])
        .select("organization_id", "property", "piece", label_of(value).alias("label"))
        .groupBy("organization_id", "property", "piece", "label")
        .agg(F.count(F.lit(1)).alias("rows"))
    )

"""The periodic alert sweep as a streaming query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from eventmetrics.operators import alerts as al
from eventmetrics.operators import panes as pn
from eventmetrics.streaming.snapshots import read_snapshot, write_snapshot

EVERY = "60 seconds"

# How late a snooze may be written and still count.
LATE = "7 DAYS"

# What tells snoozes apart.
SNOOZE_KEY = "organization_id string, alert_rule_id string, requested_at timestamp"

Loader = Callable[[SparkSession], DataFrame]


def put_rules(rules: DataFrame, path: str) -> None:
    """Store the rules a new sweep query starts from."""
    write_snapshot(rules.withColumn("swept_at", F.lit(None).cast("timestamp")), f"{path}/rules", -1)
    write_snapshot(rules.sparkSession.createDataFrame([], SNOOZE_KEY), f"{path}/snoozed", -1)


def with_state(rules: DataFrame, stored: DataFrame) -> DataFrame:
    """Rules as they are defined now, in the state their last sweep left them; new rules in their own."""
    state = stored.select(
        F.col("id").alias("_id"), F.col("current_state").alias("_state"), F.col("muted_until").alias("_until")
    )
    known = F.col("_id").isNotNull()
    return (
        rules.join(state, F.col("id") == F.col("_id"), "left")
        .withColumns(
            {
                "current_state": F.when(known, F.col("_state")).otherwise(F.col("current_state")),
                "muted_until": F.when(known, F.col("_until")).otherwise(F.col("muted_until")),
            }
        )
        .select(*rules.columns)
    )


def sweep(
    spark: SparkSession,
    load_events: Loader,
    path: str,
    version: int,
    as_of: int,
    load_snoozes: Loader | None = None,
    load_rules: Loader | None = None,
    totals: al.Totals = al.lookback_totals,
) -> None:
    """Sweep number ``version`` at ``as_of`` (microseconds since 1970).

    Reads rules of the sweep before, writes the evaluation once, and derives
    the history rows and the next rules from what was written. Each output is
    numbered and replaced as a whole, so running a sweep again is harmless.
    With ``load_rules`` definitions are read anew and only states carried over.
    A snooze is applied by the first sweep that sees it, however late it was
    written; those applied are remembered for ``LATE`` after they were asked
    for, and older ones that were never seen are not applied any more.
    ``totals`` says what ``load_events`` loads: events, or panes of them.
    """
    now = F.timestamp_micros(F.lit(as_of))
    stored = read_snapshot(spark, f"{path}/rules", version - 1)
    rules = stored.drop("swept_at") if load_rules is None else with_state(load_rules(spark), stored)
    applied = read_snapshot(spark, f"{path}/snoozed", version - 1)
    muted = None
    if load_snoozes is not None:
        key = applied.columns
        recent = F.col("requested_at") >= now - F.expr(f"INTERVAL {LATE}")
        asked = load_snoozes(spark).filter(recent & (F.col("requested_at") <= now)).join(applied, key, "left_anti")
        rules, muted = al.snooze(rules, asked, now)
        applied = applied.filter(recent).unionByName(asked.select(*key).distinct())
    values = al.alert_values(load_events(spark), rules, now, totals)
    write_snapshot(al.evaluate(rules, values, now), f"{path}/evaluated", version)
    evaluated = read_snapshot(spark, f"{path}/evaluated", version)
    history = al.transitions(evaluated, now)
    if muted is not None:
        history = history.unionByName(muted)
    history.write.mode("overwrite").parquet(f"{path}/history/sweep={version}")
    following = al.next_rules(evaluated, rules.columns).withColumn("swept_at", now)
    write_snapshot(following, f"{path}/rules", version)
    write_snapshot(applied, f"{path}/snoozed", version)


def hand_on(spark: SparkSession, path: str, version: int) -> None:
    """A batch without a tick: the rules as they are, under the next number."""
    for name in ("rules", "snoozed"):
        write_snapshot(read_snapshot(spark, f"{path}/{name}", version - 1), f"{path}/{name}", version)


def start_sweeps(
    clock: DataFrame,
    load_events: Loader,
    path: str,
    checkpoint: str,
    load_snoozes: Loader | None = None,
    load_rules: Loader | None = None,
    **trigger,
) -> StreamingQuery:
    """Sweep all rules at each trigger, at the newest ``timestamp`` of ``clock``.

    ``clock`` decides when a sweep runs: the ``rate`` source of ``wall_clock``
    fires whether or not events arrive, as recovery needs.
    """

    def run(batch: DataFrame, version: int) -> None:
        as_of = batch.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        if as_of is None:
            hand_on(batch.sparkSession, path, version)
            return
        sweep(batch.sparkSession, load_events, path, version, as_of, load_snoozes, load_rules)

    return (
        clock.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": EVERY}))
        .start()
    )


def start_pane_sweeps(
    arrivals: DataFrame,
    clock: DataFrame,
    path: str,
    checkpoint: str,
    load_snoozes: Loader | None = None,
    load_rules: Loader | None = None,
    **trigger,
) -> StreamingQuery:
    """Sweeps over sliding lookbacks that are kept up to date pane by pane.

    ``arrivals`` are events as they come in, ``clock`` has the ticks. A batch
    turns its own events into panes, which are written once, and a tick
    combines the panes of each lookback: no event is read twice, and late ones
    join the panes of their minute. Ticks count by whole minutes.
    """
    rows = arrivals.withColumn("tick", F.lit(None).cast("timestamp")).unionByName(
        clock.select(F.col("timestamp").alias("tick")), allowMissingColumns=True
    )
    layout = pn.panes(arrivals.sparkSession.createDataFrame([], arrivals.schema)).schema.add("pane_day", "date")

    def load_panes(spark: SparkSession) -> DataFrame:
        return spark.read.schema(layout).parquet(f"{path}/panes")

    def run(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        # Kept while its panes and its newest tick are taken; what is lost of it is read again.
        batch.persist()
        try:
            pn.write_panes(pn.panes(batch.filter("tick IS NULL").drop("tick")), f"{path}/panes", version)
            as_of = batch.agg(F.max(F.unix_micros(F.date_trunc("minute", F.col("tick"))))).first()[0]
        finally:
            batch.unpersist()
        if as_of is None:
            hand_on(spark, path, version)
            return
        sweep(spark, load_panes, path, version, as_of, load_snoozes, load_rules, al.lookback_totals_of_panes)

    return (
        rows.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": EVERY}))
        .start()
    )


def wall_clock(spark: SparkSession) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select("timestamp")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/history")

"""Alert rules as a state machine in keyed state: ticks and snoozes in, history out.

The state of a rule is a few numbers. Rules are kept in slots, each one value in
the state, so that a batch reads its own ticks and snoozes and each slot once,
and not the state rule by rule. ``operators.alerts.replay`` says the same of all sweeps at
once. A rule's inputs of one batch are put in order of time, a snooze before a
tick of the same moment; input of an earlier time than what a rule has seen is
late and left out, as it would have to change history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from eventmetrics.functions.dates import MICROS
from eventmetrics.operators.alerts import MUTED, RESOLVED, TRIGGERED, violated

# Parts of the rules; their number is part of a checkpoint, and more slots make them smaller.
SLOTS = 512
# No moment, where whole numbers have no null.
NEVER = -(2**63)
HELD = pa.schema([("rule", pa.string()), ("state", pa.string()), ("until_us", pa.int64()), ("seen_us", pa.int64())])
INPUTS = ["alert_rule_id", "at_us", "is_tick", "value", "violated", "until_us", "first_state", "first_until_us"]
HISTORY = (
    "alert_rule_id string, at timestamp, is_tick boolean, value double, violated boolean, "
    "state_before string, state_after string, history string"
)


def rule_inputs(rules: DataFrame, ticks: DataFrame, snoozes: DataFrame | None = None) -> DataFrame:
    """Ticks (alert_rule_id, at, value) and snoozes (alert_rule_id, at, snooze_minutes), as streams, with their rules.

    A tick is judged by its rule as it is defined when it comes in.
    """
    known = rules.select(
        F.col("id").alias("alert_rule_id"),
        "operator",
        "threshold",
        F.col("current_state").alias("first_state"),
        F.unix_micros("muted_until").alias("first_until_us"),
    )
    us = F.unix_micros("at")
    inputs = ticks.select(
        "alert_rule_id",
        us.alias("at_us"),
        F.lit(True).alias("is_tick"),
        F.col("value").cast("double").alias("value"),
        F.lit(None).cast("bigint").alias("until_us"),
    )
    if snoozes is not None:
        until = us + F.col("snooze_minutes").cast("bigint") * (60 * MICROS)
        inputs = inputs.unionByName(
            snoozes.select("alert_rule_id", us.alias("at_us"), F.lit(False).alias("is_tick"), until.alias("until_us")),
            allowMissingColumns=True,
        )
    judged = F.when(F.col("is_tick"), violated(F.col("value"), F.col("threshold"), F.col("operator")))
    return inputs.join(known, "alert_rule_id").withColumn("violated", judged).select(*INPUTS)


class RuleStates(StatefulProcessor):
    """States of the rules of one slot: what each is, until when it is muted, and when it was last judged."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rules binary")

    def _before(self) -> dict[str, tuple]:
        if not self.held.exists():
            return {}
        table = pa.ipc.open_stream(pa.py_buffer(bytes(self.held.get()[0]))).read_all()
        rule, *rest = (c.to_pylist() for c in table.columns)
        return dict(zip(rule, zip(*rest, strict=True), strict=True))

    def _keep(self, held: dict[str, tuple]) -> None:
        self._remind(min((until for _, until, _ in held.values() if until != NEVER), default=None))
        columns = [list(held), *([x[k] for x in held.values()] for k in range(3))]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.table(columns, schema=HELD))
        self.held.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        inputs = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "is_tick"], kind="stable")
        held = self._before()
        kept, states = [], []
        columns = ("alert_rule_id", "at_us", "is_tick", "violated", "until_us", "first_state", "first_until_us")
        for rule, at, is_tick, violates, end, *first in zip(*(inputs[c].tolist() for c in columns), strict=True):
            state, until, seen = held.get(rule) or (*first, NEVER)
            if at < seen:
                kept.append(False)
                continue
            before, history = state, None
            if not is_tick:
                state, until, history = MUTED, end, MUTED
            else:
                live = state == MUTED and until > at
                if not (live and violates):
                    state, until = TRIGGERED if violates else RESOLVED, NEVER
                    # A mute that ran out is dropped without a word before the value is judged.
                    was = RESOLVED if before == MUTED and not live else before
                    history = state if state != was else None
            held[rule] = (state, until, at)
            kept.append(True)
            states.append((before, state, history))
        self._keep(held)
        found = inputs[["alert_rule_id", "at_us", "is_tick", "value", "is_nan", "violated"]][kept].reset_index(drop=True)
        yield found.join(pd.DataFrame(states, columns=["state_before", "state_after", "history"], dtype=object))

    def _remind(self, until: int | None) -> None:
        """One timer, at the first end of the mutes there are now."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(-(-until // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Mutes have run out while no tick came: their rules rest, without a history row."""
        held, now = self._before(), expiredTimerInfo.getExpiryTimeInMs() * 1000
        ended = [(r, until) for r, (state, until, _) in held.items() if state == MUTED and NEVER < until <= now]
        for rule, _ in ended:
            held[rule] = (RESOLVED, NEVER, held[rule][2])
        self._keep(held)
        found = pd.DataFrame(ended, columns=["alert_rule_id", "at_us"])
        none = pd.Series([None] * len(found), dtype=object)
        blank = dict.fromkeys(("is_tick", "value", "is_nan", "violated"), none)
        yield found.assign(**blank, state_before=MUTED, state_after=RESOLVED, history=none)

    def close(self) -> None:
        pass


STATES = HISTORY.replace("at timestamp", "at_us long").replace("value double", "value double, is_nan boolean")


def rule_states(inputs: DataFrame, clock: str = "ProcessingTime", slots: int | None = None) -> DataFrame:
    """Stream of one row per input, and one without ``is_tick`` for a mute that ran out by the clock.

    ``clock`` is "ProcessingTime", or "None" for inputs of the past, where no
    timer may fire: ticks decide all the same, as each looks at the mute's end.
    """
    times = {c: F.coalesce(c, F.lit(NEVER)) for c in ("at_us", "until_us", "first_until_us")}
    slot = F.pmod(F.xxhash64("alert_rule_id"), F.lit(slots or SLOTS)).cast("int")
    found = (
        inputs.withColumns(times | {"is_nan": F.isnan("value"), "slot": slot})
        .groupBy("slot")
        .transformWithStateInPandas(
            RuleStates() if clock != "None" else _WithoutTimers(), outputStructType=STATES, outputMode="Update", timeMode=clock
        )
    )
    # A frame in Python has one mark for a missing number and for none at all.
    value = F.when(F.col("is_nan"), F.lit(float("nan"))).otherwise(F.col("value"))
    at_us = F.when(F.col("at_us") != NEVER, F.col("at_us"))
    return found.withColumns({"value": value, "at_us": at_us}).drop("is_nan")


class _WithoutTimers(RuleStates):
    def _remind(self, until: int | None) -> None:
        pass


def start_rule_states(inputs: DataFrame, path: str, checkpoint: str, clock: str = "ProcessingTime", **trigger) -> StreamingQuery:
    """Append history below ``path``, a folder per batch, replaced if the batch is run again."""

    def run(batch: DataFrame, version: int) -> None:
        rows = batch.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")
        rows.write.mode("overwrite").parquet(f"{path}/batch={version}")

    return (
        rule_states(inputs, clock)
        .writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )

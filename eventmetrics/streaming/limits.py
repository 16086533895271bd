"""Request limits in state: one counter per key and minute, kept in slots of keys.

A key's requests of one minute are admitted in order of arrival until the limit
is reached; a micro-batch goes on from the counter the one before left. Inside
each task all but the first ``limit`` requests of a key and minute are told at
once, since as many came before them; they are dealt out over lanes of their
own and never meet the counter. A key with a third of all requests is therefore
a few rows in one place and the rest everywhere. The counters of a slot are one
value in the state, so a batch reads and writes ``slots`` values at most, not one
for each key and minute; more slots make them smaller.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How long a counter is kept after its last request, by the clock of the machines: late
# requests of a minute still count, older counters are dropped.
KEEP_MS = 3_600_000
# Parts of the counters; each is one value in the state, read and written once a batch.
SLOTS = 256
LANES = 64
OVER = "over_limit"
COUNTER = np.dtype([("key_hash", "i8"), ("minute_no", "i8"), ("used", "i8"), ("seen_ms", "i8")])


def _lanes(limit: int, slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lane 0 for requests that may be admitted, others for those that ``limit`` earlier ones precede."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["key_hash", "minute_no", "at_us", "request_id", "api_key"]
            rows = pd.DataFrame({n: batch.column(batch.schema.get_field_index(n)).to_pandas() for n in names})
            order = rows.sort_values(["at_us", "request_id"], kind="stable")
            nth = order.groupby(["key_hash", "minute_no"], sort=False).cumcount().reindex(rows.index)
            late = (nth >= limit).to_numpy() | rows["api_key"].isna().to_numpy()
            lanes = np.where(late, 1 + np.arange(len(rows)) % (LANES - 1), 0).astype(np.int32)
            slot = np.where(late, 0, rows["key_hash"].to_numpy() % slots).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(slot), pa.array(lanes)], [*batch.schema.names, "slot", "lane"]
            )

    return deal


class Counter(StatefulProcessor):
    """Counts requests per key and minute up to the limit and marks those beyond; one slot's counters at a time."""

    def __init__(self, limit: int, keep_ms: int, columns: list[str]) -> None:
        self.limit, self.keep_ms, self.columns = limit, keep_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "counters binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1]:
            for part in rows:
                yield part.assign(**{OVER: True})[self.columns]
            return
        # At most the limit for each key, minute and batch that a task was given.
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "request_id"], kind="stable")
        blob = self.held.get()[0] if self.held.exists() else b""
        before = pd.DataFrame(np.frombuffer(bytes(blob), COUNTER))
        same = ["key_hash", "minute_no"]
        groups = frame.groupby(same, sort=False)
        nth = groups.cumcount().to_numpy()
        used = frame[same].merge(before, on=same, how="left")["used"].fillna(0).to_numpy()
        now = int(time.time() * 1000)
        after = groups.size().reset_index(name="used").assign(seen_ms=now)
        both = pd.concat([before[before["seen_ms"] > now - self.keep_ms], after], ignore_index=True)
        merged = both.groupby(same, sort=False).agg(used=("used", "sum"), seen_ms=("seen_ms", "max")).reset_index()
        merged["used"] = merged["used"].clip(upper=self.limit)
        self.held.update((merged[list(COUNTER.names)].to_records(index=False).astype(COUNTER).tobytes(),))
        yield frame.assign(**{OVER: used + nth >= self.limit})[self.columns]

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limit: int, keep_ms: int = KEEP_MS, slots: int = SLOTS) -> DataFrame:
    """A stream of raw requests with ``over_limit``, true beyond ``limit`` per ``api_key`` and UTC minute.

    Every request counts for the very key it came with, valid or not: who sends
    a wrong secret only uses up that wrong key. Requests without a key do not
    count.
    """
    us = F.unix_micros("received_at")
    own = requests.columns
    minute = F.floor(us / 60_000_000)
    keyed = requests.withColumns({"key_hash": F.xxhash64("api_key"), "minute_no": minute, "at_us": us}).drop("received_at")
    more = [T.StructField("slot", T.IntegerType()), T.StructField("lane", T.IntegerType())]
    laned = keyed.mapInArrow(_lanes(limit, slots), T.StructType([*keyed.schema.fields, *more]))
    kept = [c for c in own if c != "received_at"]
    layout = T.StructType(
        [
            *[requests.schema[c] for c in kept],
            T.StructField("at_us", T.LongType()),
            T.StructField(OVER, T.BooleanType()),
        ]
    )
    return (
        laned.groupBy("slot", "lane")
        .transformWithStateInPandas(
            Counter(limit, keep_ms, [*kept, "at_us", OVER]),
            outputStructType=layout,
            outputMode="Update",
            timeMode="None",
        )
        .withColumn("received_at", F.timestamp_micros("at_us"))
        .select(*own, OVER)
    )

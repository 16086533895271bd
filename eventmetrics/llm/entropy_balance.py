"""Mixing sources to target weights by entropy balancing.

Document rates start at one and change as little as possible, in relative
entropy, while each source's words meet its target and no rate passes
``MOST``. The optimum is an exponential tilt, ``rate = min(MOST, exp(dual *
size / scale))``, with one dual variable per source. Newton iterations find
all duals at once: each sums two numbers per source over the (source, size)
counts, so an iteration costs one small aggregation whatever the corpus holds.
Rates become whole copies by error feedback in bounded groups.

Defined results: a null text has size 0; a null source is a source and sorts
last; sources without words have target 0; rows that repeat a document get
equal copies; an empty table gives an empty mix. Copies depend on the rows
alone, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventmetrics.llm.common import free_name, words_of, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
TOLERANCE = 1e-6
ITERATIONS = 60
# Documents whose copies are rounded together; a source has as many groups as it needs.
GROUP = 400


def _key(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _identity(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(id_col, text_col, source_col)


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Different documents: doc_id, source, identity, size, times (rows that repeat it)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        _identity(id_col, text_col, source_col).alias("identity"),
        F.size(words_of(F.col(text_col))).cast("long").alias("size"),
    )
    return written(rows.groupBy("doc_id", "source", "identity", "size").agg(F.count("*").alias("times")), "mix-units")


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their rank by code point, null last, without one task for all of them."""
    placed = written(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sorted"
    )
    before, offsets = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):
        offsets.append((part, before))
        before += n
    starts = placed.sparkSession.createDataFrame(offsets, "part int, before long")
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        placed.withColumn("nth", F.row_number().over(inside))
        .join(starts, "part")
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
        .drop("part", "nth", "before")
    )


def targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, key, source_size, n_docs, target): shares by weight, stopped at ``most`` times the source.

    The level at which weights are paid rises until no further source stops,
    one aggregation over the sources for each rise.
    """
    sized = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n_docs")
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written(
        _numbered(sized)
        .withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
        .withColumn("key", _key(F.col("source")))
        .drop("rank"),
        "mix-sources",
    )
    goal = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        stops = F.lit(level) * F.col("weight") >= most * F.col("source_size")
        stopped, paying = ranked.agg(
            F.sum(F.when(stops, most * F.col("source_size"))), F.sum(F.when(~stops, F.col("weight")))
        ).first()
        rest = goal - float(stopped or 0)
        following = rest / paying if paying else math.inf
        if paying is None or following <= level * (1 + 1e-15):
            break
        level = following
    level = min(level, 1e300)
    target = F.least(F.lit(level) * F.col("weight"), most * F.col("source_size"))
    return ranked.select("source", "key", "source_size", "n_docs", target.cast("double").alias("target"))


def duals(units: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """``goals`` with the dual variable of each source and the scale of its sizes.

    Newton steps on the convex dual, kept inside a bracket that shrinks with
    every step; a source at its stop has an infinite dual.
    """
    counts = written(
        units.where("size > 0").groupBy(_key(F.col("source")).alias("key"), "size").agg(F.sum("times").alias("n")),
        "mix-counts",
    )
    scales = counts.groupBy("key").agg(
        (F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")) / F.sum(F.col("n") * F.col("size"))).alias("scale")
    )
    state = written(
        goals.join(scales, "key", "left").select(
            "*",
            F.lit(0.0).alias("dual"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            (F.col("target") >= most * F.col("source_size")).alias("done"),
        ),
        "mix-state",
    )
    for _ in range(ITERATIONS):
        open_state = state.where(~F.col("done"))
        tilt = F.least(F.col("dual") * F.col("size") / F.col("scale"), F.lit(math.log(most)))
        words = F.col("n") * F.col("size") * F.exp(tilt)
        free = tilt < math.log(most)
        sums = (
            counts.join(open_state.select("key", "dual", "scale"), "key")
            .groupBy("key")
            .agg(
                F.sum(words).alias("words"),
                F.sum(F.when(free, words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
            )
        )
        off = F.col("words") - F.col("target")
        near = F.abs(off) <= TOLERANCE * F.col("target")
        low = F.when(off < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("dual") - off / F.col("slope"))
        # Where a step leaves the bracket: its middle, or twice as far where one end is open.
        middle = (
            F.when(F.col("low").isNull(), F.least(F.col("high") * 2, F.col("high") - 1))
            .when(F.col("high").isNull(), F.greatest(F.col("low") * 2, F.col("low") + 1))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (newton > F.coalesce("low", F.lit(-math.inf))) & (newton < F.coalesce("high", F.lit(math.inf)))
        stepped = (
            open_state.join(sums, "key", "left")
            .withColumn("done", near | F.col("words").isNull())
            .withColumn("low", low)
            .withColumn("high", high)
            .withColumn("dual", F.when(F.col("done") | off.isNull(), F.col("dual")).when(inside, newton).otherwise(middle))
            .select(*state.columns)
        )
        state = written(state.where("done").unionByName(stepped), "mix-state")
        if state.where(~F.col("done")).isEmpty():
            break
    at_stop = F.col("target") >= most * F.col("source_size")
    return state.select(
        "source", "key", "source_size", "n_docs", "target", "scale",
        F.when(at_stop, F.lit(math.inf)).otherwise(F.col("dual")).alias("dual"),
    )


def round_copies(sizes: np.ndarray, rates: np.ndarray, most: int) -> np.ndarray:
    """Whole copies next to the rates; what one document leaves open the next ones make up for."""
    copies = np.zeros(len(sizes), np.int64)
    left = 0.0
    for i in np.argsort(-sizes, kind="stable"):
        size, low = float(sizes[i]), math.floor(rates[i])
        wanted = rates[i] * size + left
        up = rates[i] > low and abs(wanted - (low + 1) * size) < abs(wanted - low * size)
        copies[i] = low + up
        left = wanted - copies[i] * size
    # A small group can end with a gap that no later document was left to close.
    while True:
        change = np.where(left > 0, (copies < most).astype(np.int64), -(copies > 0).astype(np.int64))
        gap = np.abs(left - change * sizes)
        best = int(np.argmin(gap)) if len(gap) else 0
        if not len(gap) or gap[best] >= abs(left) - 1e-6:
            return copies
        copies[best] += change[best]
        left -= float(change[best] * sizes[best])


def _round_group(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "identity"], ascending=[False, True], kind="stable")
        rows["copies"] = round_copies((rows["size"] * rows["times"]).to_numpy(), rows["rate"].to_numpy(), most)
        return rows.drop(columns=["group"])

    return run


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """Per different document: doc_id, source, identity, size, times, source_size, target, rate, copies."""
    units = _units(docs, id_col, text_col, source_col)
    solved = written(duals(units, targets(units, weights, share, most), most), "mix-duals")
    tilt = F.least(F.col("dual") * F.col("size") / F.col("scale"), F.lit(math.log(most)))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("dual") == math.inf, F.lit(most)).otherwise(
        F.least(F.exp(tilt), F.lit(most))
    )
    rated = (
        units.withColumn("key", _key(F.col("source")))
        .join(solved.drop("source"), "key")
        .withColumn("rate", rate.cast("double"))
        .withColumn("group", F.pmod(F.xxhash64("identity"), F.ceil(F.col("n_docs") / GROUP)))
        .drop("scale", "dual", "n_docs")
    )
    schema = rated.drop("group").schema.add("copies", "long")
    return rated.groupBy("key", "group").applyInPandas(_round_group(int(most)), schema).drop("key")


def report(docs: DataFrame, **names: str) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, rate, copies, taken."""
    found = mixed(docs, **names)
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix: each document as often as it has copies, with all its columns."""
    found = written(mixed(docs, id_col, text_col, source_col).where("copies > 0"), "mix-copies")
    key, other, number, copies = (
        free_name(docs.columns, wish) for wish in ("mix_identity", "mix_other", "mix_number", "mix_copies")
    )
    side = found.select(F.col("identity").alias(other), F.col("doc_id").alias(number), F.col("copies").alias(copies))
    # Copies differ between documents of one source and size, so each row has to meet its own: one
    # shuffle of the rows. The merge keeps the plan the same at every size.
    joined = docs.withColumn(key, _identity(id_col, text_col, source_col)).join(
        side.hint("merge"), (F.col(key) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(number))
    )
    repeated = joined.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return repeated.select(*docs.columns)

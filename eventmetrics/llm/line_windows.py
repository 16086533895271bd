"""Line dedup by overlapping windows of three lines, in DataFrame operations only.

Every three consecutive lines are hashed. Of equal windows the first one, by
(document, position), stays; the lines under any later one are removed, each
line once however many windows cover it.

Defined results: a null text has no lines; texts of fewer than three lines have
no window and stay whole; windows without a word are not compared; a document
is a (doc_id, text) pair, so rows that repeat both count once and get equal
results, rows that share an id but not the text are apart, and a null id sorts
first. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmetrics.llm.bitmaps import flagged_members
from eventmetrics.llm.common import BLANKS, let, without, written

LINES = 3


def lines_of(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, key) of every window; ``docs`` has doc_id and text."""

    def keys(lines: Column) -> Column:
        def key(i: Column) -> Column:
            joined = F.array_join(F.slice(lines, i + 1, F.lit(LINES)), "\n")
            return F.struct(
                i.alias("pos"), F.when(F.length(without(joined, BLANKS)) > 0, F.unhex(F.md5(joined))).alias("key")
            )

        none = F.array().cast("array<struct<pos:int,key:binary>>")
        last = F.size(lines) - LINES
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), key)).otherwise(none)

    found = docs.select(
        "doc_id", F.xxhash64("text").alias("version"), F.explode(let(lines_of(F.col("text")), keys)).alias("w")
    )
    return found.select("doc_id", "version", "w.pos", "w.key").where("key IS NOT NULL")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, removed): the line numbers that go, per document that loses any."""
    seen = written(windows(docs), "line-windows")
    place = F.struct("doc_id", "version", "pos")
    # Aggregated per task first: a window that fills a third of the table costs one row per task.
    firsts = written(
        seen.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last"),
        "line-firsts",
    )
    later = seen.join(firsts, "key").where(place != F.col("first"))
    return later.groupBy("doc_id", "version").agg(
        F.sort_array(
            F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + (LINES - 1)))))
        ).alias("removed")
    )


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with the numbers of the lines they lose; only those that lose any are shuffled."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = F.xxhash64("doc_id", "version")
    gone = written(removed_lines(own), "line-removed")
    split, flag = flagged_members(own.withColumn("version", F.xxhash64("text")), key, gone, key)
    side = gone.select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"), "removed")
    whole = split.where(~F.col(flag)).select("doc_id", "text", F.lit(None).cast("array<int>").alias("removed"))
    cut = split.where(F.col(flag)).join(
        side.hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")),
        "left",
    )
    return whole.unionAll(cut.select("doc_id", "text", "removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, kept_text (null for null), n_lines, n_removed, n_spans of removed lines."""
    gone = F.coalesce(F.col("removed"), F.array().cast("array<int>"))

    def result(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            F.when(F.col("removed").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
            .alias("kept_text"),
        )

    starts = F.filter(gone, lambda p, j: (j == 0) | (F.get(gone, j - 1) < p - 1))
    return (
        _joined(docs, id_col, text_col)
        .select(
            "doc_id",
            let(lines_of(F.col("text")), result).alias("r"),
            F.size(gone).cast("long").alias("n_removed"),
            F.size(starts).cast("long").alias("n_spans"),
        )
        .select("doc_id", "r.n_lines", "n_removed", "n_spans", "r.kept_text")
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup_lines`` with the SHA-256 of what is left in place of the text."""
    return dedup_lines(docs, id_col, text_col).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )

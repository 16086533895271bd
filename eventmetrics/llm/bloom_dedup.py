"""Exact dedup behind a two-pass Bloom filter, in DataFrame operations only.

Pass one sets two bits per text hash and keeps the bits that were hit twice or
more, as a table of bitmaps. Pass two probes it: a text that is repeated has
both its bits in the filter, so any other row is unique for certain and passes
straight through; only the rest is shuffled and compared by its full hash.

Defined results: null counts as the empty text; texts are equal when they are
after replacing each run of blanks by one space; the smallest id stays, and a
null id stays only if no other row of the group has an id. Rows that repeat id
and text stand for one document: ``report`` returns each, ``distinct_rows``
keeps one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmetrics.llm.bitmaps import below, filter_bits, probe, repeated_filter
from eventmetrics.llm.common import BLANK_RUN, free_name, written

def text_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " "), 256)


def _positions(sha: Column, bits: int) -> list[Column]:
    """Two independent bit numbers from a hex digest; ``bits`` is a power of two."""
    return [below(F.conv(F.substring(sha, start, 15), 16, 10).cast("long"), bits) for start in (1, 17)]


def _hashes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, DataFrame]:
    """Written (doc_id, text_sha256), the filter's size, the written filter."""
    keyed = written(
        docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_sha256")), "hashes"
    )
    bits = filter_bits(keyed.count())
    return keyed, bits, written(repeated_filter(keyed, _positions(F.col("text_sha256"), bits)), "filter")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed, bits, found = _hashes(docs, id_col, text_col)
    flagged, flag = probe(keyed, _positions(F.col("text_sha256"), bits), found, bits)
    unique = flagged.where(~F.col(flag)).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    maybe = flagged.where(F.col(flag)).drop(flag)
    # Written, so that the join deals out both sides anew and can split a hot hash.
    groups = written(
        maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    repeated = maybe.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    return unique.unionByName(repeated).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of each text, unique rows without a shuffle."""
    keyed, bits, found = _hashes(docs, id_col, text_col)
    sha = free_name(docs.columns, "sha")
    flagged, flag = probe(docs.withColumn(sha, text_hash(F.col(text_col))), _positions(F.col(sha), bits), found, bits)
    unique = flagged.where(~F.col(flag)).drop(flag, sha)
    narrow, narrow_flag = probe(keyed, _positions(F.col("text_sha256"), bits), found, bits)
    keep, keep_id = free_name(flagged.columns, "keep_sha"), free_name(flagged.columns, "keep_id")
    groups = written(
        narrow.where(F.col(narrow_flag))
        .groupBy(F.col("text_sha256").alias(keep))
        .agg(F.min("doc_id").alias(keep_id)),
        "groups",
    )
    stays = flagged.where(F.col(flag)).drop(flag).join(
        groups, (F.col(sha) == F.col(keep)) & F.col(id_col).eqNullSafe(F.col(keep_id)), "left_semi"
    )
    return unique.unionByName(stays.dropDuplicates([sha]).drop(sha))

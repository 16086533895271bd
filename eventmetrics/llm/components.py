"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmetrics.llm.common import written


def _checksum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _hang(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """Each neighbour of a node hung on the node's lowest one."""
    return edges.join(lowest, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that is not itself the smallest of its component.

    Each round joins nodes with their smallest neighbour; the number of rounds
    grows with the logarithm of the number of nodes. Minima are aggregated per
    task before the shuffle and both join sides are dealt out anew, so a node
    with a third of all links is split. Rounds are written to the shared folder.
    """
    edges = written(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    before = _checksum(edges)
    while before[0]:
        # Large star: neighbours above a node go to the smallest node around it.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        lowest = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = written(
            _hang(both.where("v > u"), lowest).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large"
        )
        # Small star: a node and its smaller neighbours go to the smallest of them.
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        lowest = written(down.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        hung = _hang(down, lowest).where("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = written(hung.unionAll(lowest.select("m", "u")).distinct(), "links")
        after = _checksum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))

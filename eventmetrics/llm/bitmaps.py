"""Bloom filters as small tables of bitmaps, built and probed by Spark's own functions.

A filter is a table (chunk, bitmap) of at most ``bits / 8`` bytes, a size known
before it is built. Up to ``BROADCAST_BYTES`` it is broadcast and no probed row
moves; a larger one is joined by its chunk number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmetrics.llm.common import free_name, written

# With two bits set per key about 1.5 % of other keys are taken for members.
BITS_PER_KEY = 16
CHUNK_BITS = 32768  # what one bitmap of Spark's bitmap functions holds
BROADCAST_BYTES = 32 * 1024 * 1024


def filter_bits(keys: int) -> int:
    bits = CHUNK_BITS
    while bits < keys * BITS_PER_KEY:
        bits *= 2
    return bits


def below(number: Column, bits: int) -> Column:
    """A long cut to a bit number; ``bits`` is a power of two."""
    return number.bitwiseAND(F.lit(bits - 1).cast("long"))


def positions_of_key(key: Column, bits: int) -> list[Column]:
    return [below(F.xxhash64(key, F.lit(salt)), bits) for salt in (1, 2)]


def _table(bit_rows: DataFrame) -> DataFrame:
    return bit_rows.groupBy(F.floor(F.col("bit") / CHUNK_BITS).alias("chunk")).agg(
        F.bitmap_construct_agg(F.col("bit") % CHUNK_BITS).alias("bitmap")
    )


def member_filter(keys: DataFrame, positions: list[Column]) -> DataFrame:
    """The bits that any row sets."""
    return _table(keys.select(F.explode(F.array(*positions)).alias("bit")))


def repeated_filter(keys: DataFrame, positions: list[Column]) -> DataFrame:
    """The bits that two rows or more set."""
    hit = keys.select(F.explode(F.array(*positions)).alias("bit"))
    return _table(hit.groupBy("bit").count().where("count > 1"))


def probe(df: DataFrame, positions: list[Column], found: DataFrame, bits: int) -> tuple[DataFrame, str]:
    """``df`` with a flag, are all these bits in the filter? Also the flag's name."""
    taken = list(df.columns)
    names = []
    for position in positions:
        name = free_name(taken, "maybe")
        chunk, bitmap = free_name(taken, "chunk"), free_name(taken, "bitmap")
        side = found.select(F.col("chunk").alias(chunk), F.col("bitmap").alias(bitmap))
        if bits // 8 <= BROADCAST_BYTES:
            side = F.broadcast(side)
        own = free_name([*taken, chunk, bitmap], "own_chunk")
        bit = position % CHUNK_BITS
        # Spark's bitmaps fill each byte from its lowest bit.
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        df = (
            df.withColumn(own, F.floor(position / CHUNK_BITS))
            .join(side, F.col(own) == F.col(chunk), "left")
            .withColumn(name, F.coalesce(F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1, F.lit(False)))
            .drop(own, chunk, bitmap)
        )
        taken.append(name)
        names.append(name)
    flag = free_name(taken, "maybe_member")
    both = F.lit(True)
    for name in names:
        both = both & F.col(name)
    return df.withColumn(flag, both).drop(*names), flag


def flagged_members(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, str]:
    """``df`` with a flag that is true for every row whose key is in ``wanted`` (written), and for few others.

    Beyond the size that may be broadcast the flag is true for all rows.
    """
    bits = filter_bits(wanted.count())
    if bits // 8 > BROADCAST_BYTES:
        flag = free_name(df.columns, "maybe_member")
        return df.withColumn(flag, F.lit(True)), flag
    found = written(member_filter(wanted, positions_of_key(wanted_key, bits)), "member-filter")
    return probe(df, positions_of_key(key, bits), found, bits)


def rows_with_key(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is in the one-column table ``wanted`` (written, distinct).

    A semi join, before which a filter drops nearly all other rows where they
    are, so that wide rows nobody asked for are not shuffled.
    """
    (name,) = wanted.columns
    other = free_name(df.columns, "wanted_key")
    keys = wanted.select(F.col(name).alias(other))
    likely, flag = flagged_members(df, F.col(key), keys, F.col(other))
    return likely.where(F.col(flag)).drop(flag).join(keys.hint("merge"), F.col(key) == F.col(other), "left_semi")

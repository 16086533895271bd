"""SimHash near-dedup by exact comparison of tiles.

A fingerprint holds the majority of each bit over the XXH64 hashes of a text's
runs of three words. Rows with equal fingerprints are one class from the start.
Two fingerprints that differ in at most ``RADIUS`` bits have population counts
that differ by no more than that, in the whole and summed over any split into
parts. Classes therefore lie in cells by the population counts of their four
16-bit parts, and a cell is cut by hash into tiles of about ``TILE``
fingerprints. Tile pairs whose counts differ by more than the radius are never
built; of the others every pair of fingerprints is compared with exclusive-or
and bit counts, and a tile pair returns a forest of its links, not the links.
All fingerprints are compared that can be within the radius, so the result is
exact.

Work and bounds: a task holds two tiles. Both sides of a pair are dealt by
the second tile, so a cell with a third of all fingerprints is many keys. At n
classes the tile pairs compare about 5 % of n * n / 2 pairs if bits are
independent, and ship 8 bytes * 65 * n, or n / ``TILE`` times that beyond a
tile per cell. Memory for fingerprints is about ten times the longest text.

Defined results: a null text, or one without words, has fingerprint zero and
is linked like any other; fewer than three words make one run; a row without
an id gets its component's smallest id, null if there is none; equal rows get
equal results; ids may be of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmetrics.llm.common import written
from eventmetrics.llm.components import components
from eventmetrics.llm.tokens import BLANK, LOWER, chunks, text_bytes

WIDTH = 3
SEED = 42
RADIUS = 3
PARTS = 4
PART_BITS = 64 // PARTS
TILE = 16384
BLOCK = 1 << 20  # comparisons at once
TEXT_BYTES = 2 * 1024 * 1024
LONG = 256  # longer runs are hashed one by one

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
LANES = np.uint64(0x0101010101010101)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _one_length(data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """XXH64 of ``n`` bytes from each start; eight bytes follow the last one."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    four = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    at, end = start, start + n
    if n >= 32:
        seed = np.uint64(SEED)
        lanes = [np.full(len(start), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        for _ in range(n // 32):
            lanes = [_turn(v + eight[at + 8 * j] * P2, 31) * P1 for j, v in enumerate(lanes)]
            at = at + 32
        h = sum((_turn(v, r) for v, r in zip(lanes, (1, 7, 12, 18), strict=True)), np.zeros(len(start), np.uint64))
        for v in lanes:
            h = (h ^ (_turn(v * P2, 31) * P1)) * P1 + P4
    else:
        h = np.full(len(start), np.uint64(SEED) + P5, np.uint64)
    h = h + np.uint64(n)
    left = n % 32
    for _ in range(left // 8):
        h = _turn(h ^ (_turn(eight[at] * P2, 31) * P1), 27) * P1 + P4
        at = at + 8
    if left % 8 >= 4:
        h = _turn(h ^ (four[at].astype(np.uint64) * P1), 23) * P2 + P3
        at = at + 4
    for _ in range(left % 4):
        h = _turn(h ^ (data[at].astype(np.uint64) * P5), 11) * P1
        at = at + 1
    assert len(at) == 0 or at[0] == end[0]
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 of each substring, those of one length together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.empty(len(start), np.uint64)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    with np.errstate(over="ignore"):
        for n, some in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
            if n <= LONG:
                out[some] = _one_length(padded, start[some], n)
            else:
                out[some] = [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), SEED) for s in start[some].tolist()]
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words parted by one space, start and length of each run, and each text's number of runs."""
    word = ~BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - begin
    place = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
    plain = np.full(place[-1], 32, np.uint8)
    plain[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = LOWER[data[word]]
    of_text = np.searchsorted(begin, offsets)
    words = np.diff(of_text)
    runs = np.where(words >= WIDTH, words - WIDTH + 1, (words > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(runs)])[:-1]
    head = np.arange(int(runs.sum())) + np.repeat(of_text[:-1] - before, runs)
    tail = head + np.repeat(np.minimum(words, WIDTH) - 1, runs)
    return plain, place[head], place[tail] + size[tail] - place[head], runs


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text."""
    n = len(offsets) - 1
    plain, start, length, runs = _runs(data, offsets)
    counts = np.zeros((n, 64), np.int64)
    if len(start):
        hashes = xxh64(plain, start, length)
        # Sums of single bits, eight to a number, over at most 255 runs of one text.
        text = np.repeat(np.arange(n), runs)
        place = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(runs)])[:-1], runs)
        cuts = np.flatnonzero(place % 255 == 0)
        for j in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(j)) & LANES, cuts)
            np.add.at(counts[:, j::8], text[cuts], sums.view(np.uint8).reshape(-1, 8))
    return np.packbits(2 * counts > runs[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", TEXT_BYTES):
            found = fingerprints(*text_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's smallest known one) after the links a-b between labels."""
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            lower = label[label]
            if np.array_equal(lower, label):
                break
            label = lower
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label


def linked(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles, or within one."""
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(nodes))
    step = max(1, BLOCK // max(1, len(b)))
    for lo in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[lo : lo + step, None] ^ b[None, :]) <= RADIUS)
        x, y = label[i + lo], label[j + shift]
        apart = x != y
        if apart.any():
            label = merge(label, x[apart], y[apart])
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _linked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = ((c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(0), batch.column(1)))
        same = batch.column(2).to_pylist()
        found = [
            linked(one[0][one[1][r] : one[1][r + 1]], two[0][two[1][r] : two[1][r + 1]], same[r])
            for r in range(batch.num_rows)
        ]
        if found:
            a, b = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _cell(fingerprint: Column) -> Column:
    """The population counts of the parts, as the digits of one number."""
    part = (1 << PART_BITS) - 1
    cell = F.lit(0).cast("long")
    for j in range(PARTS):
        bits = F.shiftrightunsigned(fingerprint, PART_BITS * j).bitwiseAND(F.lit(part).cast("long"))
        cell = cell * (PART_BITS + 1) + F.bit_count(bits)
    return cell


def _steps() -> list[tuple[int, ...]]:
    """Differences of population counts within the radius, one of each opposite two."""
    near = [d for d in product(range(-RADIUS, RADIUS + 1), repeat=PARTS) if sum(map(abs, d)) <= RADIUS]
    return [d for d in near if d >= (0,) * PARTS]


def _tile_pairs(classes: DataFrame) -> DataFrame:
    """(one, two, same): the fingerprints of tiles whose population counts are within the radius."""
    base = PART_BITS + 1
    cells = classes.select("print", _cell(F.col("print")).alias("cell"))
    # At most base ** PARTS (83,521) rows of two numbers: that is what may be broadcast.
    sizes = written(cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("tiles")), "tile-counts")
    tiles = written(
        cells.join(F.broadcast(sizes), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("print"), F.col("tiles")).alias("tile"))
        .agg(F.collect_list("print").alias("prints")),
        "tiles",
    )
    digits = [F.floor(F.col("cell") / base ** (PARTS - 1 - j)) % base for j in range(PARTS)]
    ways = F.array(
        *[
            F.when(
                F.array_min(F.array(*[x + s for x, s in zip(digits, step, strict=True)])).between(0, PART_BITS)
                & F.array_max(F.array(*[x + s for x, s in zip(digits, step, strict=True)])).between(0, PART_BITS),
                F.col("cell") + sum(s * base ** (PARTS - 1 - j) for j, s in enumerate(step)),
            )
            for step in _steps()
        ]
    )
    other = sizes.toDF("other", "other_tiles")
    one = (
        tiles.select(F.col("cell").alias("own"), "tile", F.col("prints").alias("one"), F.explode(F.array_compact(ways)).alias("other"))
        .join(F.broadcast(other), "other")
        .withColumn("other_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_tiles") - 1)))
        .where("other != own OR other_tile >= tile")
    )
    two = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("other_tile"), F.col("prints").alias("two"))
    return one.join(two.hint("merge"), ["other", "other_tile"]).select(
        "one", "two", F.expr("other = own AND other_tile = tile").alias("same")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("print", T.LongType())])
    prints = written(docs.mapInArrow(_fingerprint_batches, kind), "prints")
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "print-classes")
    links = written(_tile_pairs(classes).mapInArrow(_linked_batches, "a long, b long"), "print-links")
    labels = components(links)
    placed = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "component", F.coalesce("component", "print")
    )
    lowest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = placed.join(lowest, "component").select("print", "component_id")
    return prints.join(found, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )

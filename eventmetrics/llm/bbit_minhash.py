"""MinHash near-dedup with b-bit signatures.

A text's set is its distinct runs of five words. 128 minima per set make bands
for candidates (``bands_for``); of each minimum four low bits are packed into a
signature, whose agreement, corrected for chance agreement of four bits, drops
candidates far below the threshold. The rest is confirmed on the full sets, by
whole-number arithmetic. Links make components.

Texts with equal sets are one class from the start and only the class's
smallest id goes on, so exact copies never meet in a bucket. A bucket of up to
``SMALL_BUCKET`` classes compares each pair. In a larger one each class is
compared with the two most central ones; then the classes which still lie in
different components are compared exactly, on their full sets, in bounded
blocks that return no more links than they join components.

Bands and signature cut follow from ``percent``. A pair at the threshold shares
no band with probability ``BAND_MISS`` at most (24 bands of four at 85: 2e-8; 32
bands of four at 80: 5e-8), and falls below the signature cut with less than
``CUT_MISS``. 128 minima do that from 12 percent on; less is refused.

Defined results: a null text or one without words has the empty set and is
linked with nothing; a text of fewer than five words has one run; a row with a
null id gets its class's component if some row of its class has an id, else
null, and is kept in that case; rows that repeat an id and a text get equal results (``kept_rows``
returns one of them), and an id with different texts links them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmetrics.llm import tokens
from eventmetrics.llm.bitmaps import rows_with_key
from eventmetrics.llm.common import free_name, written
from eventmetrics.llm.components import components

WIDTH = 5
MINIMA = 128
BITS = 4
PERCENT = 85
# Chances that a pair at the threshold shares no band, and that its signatures agree too little.
BAND_MISS, CUT_MISS = 1e-7, 1e-8
SMALL_BUCKET = 16
BLOCK = 256
STRIDE = 1 << 14  # shingles per step, so that a step stays in cache

SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("signature", T.ArrayType(T.LongType())),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("members", T.BinaryType())])


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and minima to a band: the longest bands, eight at a time, that keep ``BAND_MISS``."""
    for rows in (4, 3, 2, 1):
        for bands in range(8, MINIMA // rows + 1, 8):
            if (1 - (percent / 100) ** rows) ** bands <= BAND_MISS:
                return bands, rows
    raise ValueError(f"{MINIMA} minima do not find pairs of {percent} percent")


def cut_for(percent: int) -> float:
    """The least estimate that goes on: a pair at the threshold is below it with a chance under ``CUT_MISS``."""
    chance = 1.0 / (1 << BITS)
    agree = percent / 100 + (1 - percent / 100) * chance
    count, below = 0, 0.0
    while count < MINIMA:
        below += comb(MINIMA, count) * agree**count * (1 - agree) ** (MINIMA - count)
        if below >= CUT_MISS:
            break
        count += 1
    # Half a minimum lower, so that rounding does not decide.
    return ((count - 0.5) / MINIMA - chance) / (1 - chance)


def minima(values: np.ndarray, places: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each text with values and each factor, the smallest product."""
    full = np.flatnonzero(np.diff(places))
    out = np.empty((len(full), len(factors)), np.uint64)
    at = 0
    while at < len(full):
        lo = places[full[at]]
        end = max(at + 1, int(np.searchsorted(places[full], lo + STRIDE)))
        hi = places[full[end - 1] + 1]
        part, begins = values[lo:hi], places[full[at:end]] - lo
        product = np.empty_like(part)
        for k, factor in enumerate(factors):
            np.multiply(part, factor, out=product)
            out[at:end, k] = np.minimum.reduceat(product, begins)
        at = end
    return out


def _sets(batch: pa.RecordBatch, powers: tokens.Powers) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tokens.text_bytes(batch.column(1))
    words, _, _, first = tokens.split_words(data, offsets, powers)
    return tokens.distinct_sorted(*tokens.shingles(words, first, WIDTH))


def _sketch(n_bands: int, n_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, factors = tokens.Powers(), tokens.constants(MINIMA, 9)
        salts = tokens.constants(n_bands * n_rows, 10)
        for whole in batches:
            for batch in tokens.chunks(whole, "text"):
                members, places = _sets(batch, powers)
                full = np.flatnonzero(np.diff(places))
                n = batch.num_rows
                low = minima(members, places, factors)
                grouped = (low[:, : n_bands * n_rows] * salts).reshape(len(full), n_bands, n_rows)
                grouped = grouped.sum(axis=2, dtype=np.uint64)
                keys = tokens.mix(grouped + np.arange(n_bands, dtype=np.uint64) * salts[0])
                spread = tokens.mix(low)
                planes = [
                    np.packbits(((spread >> np.uint64(p)) & np.uint64(1)).astype(bool), axis=1).view(np.int64)
                    for p in range(BITS)
                ]
                signature = np.ascontiguousarray(np.concatenate(planes, axis=1)) if len(full) else np.zeros((0, 8), np.int64)
                digest = np.zeros((n, 2), np.uint64)
                if len(full):
                    digest[full, 0] = np.add.reduceat(tokens.mix(members), places[full])
                    digest[full, 1] = np.bitwise_xor.reduceat(tokens.mix(members * factors[0]), places[full])
                sizes = np.diff(places)
                per_row = lambda width: np.concatenate([[0], np.cumsum((sizes > 0) * width)])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array([row.tobytes() for row in digest], pa.binary()),
                        tokens.list_column(signature.reshape(-1), per_row(BITS * MINIMA // 64), pa.int64()),
                        tokens.list_column(keys.reshape(-1).view(np.int64), per_row(n_bands), pa.int64()),
                    ],
                    names=[f.name for f in SKETCH],
                )

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = tokens.Powers()
    for whole in batches:
        for batch in tokens.chunks(whole, "text"):
            members, places = _sets(batch, powers)
            rows = [members[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.binary())], names=[f.name for f in SETS]
            )


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: agreeing minima, less those that agree by chance."""
    words = MINIMA // 64
    differing = F.lit(0)
    for word in range(words):
        unlike = F.lit(0).cast("long")
        for plane in range(BITS):
            i = plane * words + word
            unlike = unlike.bitwiseOR(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
        differing = differing + F.bit_count(unlike)
    chance = 1.0 / (1 << BITS)
    return ((1.0 - differing / MINIMA) - chance) / (1.0 - chance)


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), np.uint64)
                b = np.frombuffer(right[i].as_buffer(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good[i] = 100 * shared >= percent * (len(a) + len(b) - shared)
            yield batch.select([0, 1]).filter(pa.array(good))

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(
        _confirm(percent), "a long, b long"
    )


class Forest:
    """Union-find over the labels seen in one block."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def block_links(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members with different labels, as many as it takes to join them.

    Sets become rows of bits over the values that two members share, so all
    intersections are counts of common bits.
    """
    values, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(seen > 1) - 1
    width = int(column[-1]) + 1 if len(values) else 0
    if not width:
        return []
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = seen[inverse] > 1
    bits = np.zeros((len(sets), (width + 63) // 64 * 8), np.uint8)
    at = column[inverse[shared]]
    np.bitwise_or.at(bits, (owner[shared], at // 8), (1 << (at % 8)).astype(np.uint8))
    packed, sizes = bits.view(np.uint64), np.array([len(s) for s in sets])
    forest, links = Forest(), []
    tags = np.array(labels)
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(tags[i + 1 :] != tags[i]) + i + 1
        if not len(rest):
            continue
        common = np.bitwise_count(packed[rest] & packed[i]).sum(axis=1, dtype=np.int64)
        for j in rest[similar(common, sizes[i], sizes[rest], percent)]:
            if forest.join(labels[i], labels[int(j)]):
                links.append((ids[i], ids[int(j)]))
    return links


def _block_task(percent: int):
    def run(table: pa.Table) -> pa.Table:
        # The same class may come with both blocks of a pair.
        rows = {}
        for doc, label, members in zip(
            table["doc_id"].to_pylist(), table["label"].to_pylist(), table["members"].to_pylist(), strict=True
        ):
            rows[doc] = (label, np.frombuffer(members, np.uint64))
        ids = sorted(rows)
        found = block_links(ids, [rows[d][0] for d in ids], [rows[d][1] for d in ids], percent)
        return pa.table({name: pa.array([x[k] for x in found], pa.int64()) for k, name in enumerate("ab")})

    return run


def _sketches(docs: DataFrame, percent: int) -> DataFrame:
    return written(docs.select("doc_id", "text").mapInArrow(_sketch(*bands_for(percent)), SKETCH), "sketches")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    wanted = written(wanted.distinct(), "wanted")
    rows = rows_with_key(docs.select("doc_id", "text"), "doc_id", wanted)
    sets = rows.mapInArrow(_members, SETS)
    return written(sets.groupBy("doc_id").agg(F.first("members").alias("members")), "sets")


def _labelled(nodes: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """``nodes`` with the component of each, itself where it has no link."""
    found = labels.select(F.col("node").alias("label_node"), "component")
    return (
        nodes.join(found, F.col(node) == F.col("label_node"), "left")
        .withColumn("label", F.coalesce("component", node))
        .drop("label_node", "component")
    )


def _links_of_large(members: DataFrame, links: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """Links that large buckets hold beyond those to their central classes.

    Buckets that meet are one group. A group is cut into blocks of about
    ``BLOCK`` classes and each pair of blocks is one bounded task.
    """
    stars = members.select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))
    group = _labelled(members.select("doc_id").distinct(), components(stars), "doc_id").withColumnRenamed(
        "label", "group"
    )
    known = written(_labelled(group, components(links), "doc_id"), "large-members")
    sizes = written(
        known.groupBy("group").agg(
            F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
        ),
        "large-groups",
    ).where("low != high")
    mixed = written(known.join(sizes, "group").select("doc_id", "group", "label", "n"), "large-mixed")
    if mixed.isEmpty():
        return None
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    paired = (
        mixed.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "doc_id",
            "label",
            "group",
            F.least("own", "other").alias("first_block"),
            F.greatest("own", "other").alias("second_block"),
        )
    )
    sets = _sets_of(docs, mixed.select("doc_id"))
    return (
        paired.join(sets, "doc_id")
        .groupBy("group", "first_block", "second_block")
        .applyInArrow(_block_task(percent), "a long, b long")
    )


def _pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b, of small buckets in full and of large ones with central classes."""
    small = members.where(F.col("n") <= SMALL_BUCKET)
    lists = small.groupBy("key").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    in_small = lists.select(
        F.explode(
            F.flatten(
                F.transform(
                    "ids", lambda x, i: F.transform(F.slice("ids", F.lit(1), i), lambda y: F.struct(y.alias("a"), x.alias("b")))
                )
            )
        ).alias("p")
    ).select("p.a", "p.b")
    large = members.where(F.col("n") > SMALL_BUCKET)
    # The class that lies in the fullest buckets is the one most others resemble.
    weight = large.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    centre = written(
        large.join(weight, "doc_id").groupBy("key").agg(
            F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("c")
        ).select("key", (-F.col("c.minus")).alias("centre")),
        "centres",
    )
    with_centre = large.join(centre, "key")
    in_large = with_centre.select(F.col("lead").alias("x"), "doc_id").unionAll(with_centre.select("centre", "doc_id"))
    stars = in_large.where("x != doc_id").select(
        F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")
    )
    return in_small.unionAll(stars).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = _sketches(docs, percent)
    full = sketches.where("n_shingles > 0")
    classes = written(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = written(
        full.join(
            classes.withColumnRenamed("set_key", "rep_key"),
            (F.col("set_key") == F.col("rep_key")) & (F.col("doc_id") == F.col("rep")),
            "left_semi",
        ).dropDuplicates(["set_key"]),
        "class-sketches",
    )
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = written(
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).where("n > 1"), "buckets"
    )
    members = written(keyed.join(buckets, "key"), "bucket-members")
    side = reps.select("doc_id", "n_shingles", "signature")
    sketch_a = side.toDF("a", "size_a", "sig_a")
    sketch_b = side.toDF("b", "size_b", "sig_b")
    small_size, large_size = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    pairs = written(
        written(_pairs(members), "pairs")
        .join(sketch_a, "a")
        .join(sketch_b, "b")
        .where(
            (100 * small_size >= percent * large_size)
            & (estimate(F.col("sig_a"), F.col("sig_b")) >= cut_for(percent))
        )
        .select("a", "b")
        .distinct(),
        "likely-pairs",
    )
    sets = _sets_of(docs, pairs.select("a").unionAll(pairs.select("b")))
    links = written(confirmed(pairs, sets, percent), "near-links")
    large = members.where(F.col("n") > SMALL_BUCKET)
    if not large.isEmpty():
        more = _links_of_large(large, links, docs, percent)
        if more is not None:
            links = links.unionAll(written(more, "large-links"))
    copies = full.join(classes, "set_key").where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.unionAll(copies))
    placed = (
        sketches.join(
            labels.select(F.col("node").alias("own_node"), "component"), F.col("doc_id") == F.col("own_node"), "left"
        )
    )
    without_id = placed.where("doc_id IS NULL").join(classes, "set_key", "left")
    ranked = _labelled(without_id.drop("component"), labels, "rep").select(
        "doc_id", "n_shingles", F.col("label").alias("component_id")
    )
    named = placed.where("doc_id IS NOT NULL").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    return named.unionAll(ranked).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One whole row of each group, and the rows without an id that no row with one resembles."""
    found = near_duplicates(docs, id_col, text_col, percent)
    name = free_name(docs.columns, "dropped_id")
    dropped = written(found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "dropped")
    return docs.join(dropped, F.col(id_col).cast("long") == F.col(name), "left_anti")

"""Dedup of repeated passages by the common-prefix interval tree of a suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts at some
other place, in the same text or another. Every such string contains an
anchor: the place with the smallest hash among the short strings in it, the
first one of equals. So a string belongs to one anchor, and equal strings to
anchors with equal hashes, at the same distance. The stretch of text made of
all strings of one anchor is its context.

1. One pass finds all anchors. Those whose hash stands once drop out.
2. Equal contexts of equal anchors cover each other whole.
3. Different contexts of equal anchors are brought together as bytes, each once.
   A bounded group of them gets an enhanced suffix array (order, common
   prefixes, byte to the left); a stack scan walks the intervals of common
   prefixes, and those whose left bytes differ are the maximal repeats, with
   all their places.
4. An anchor with more than ``MOST_CONTEXTS`` different contexts (a frequent
   line within different texts) does not fit a group: its strings are counted
   by hash instead, first the parts that neighbouring strings have in common,
   then the strings whose part was found twice.

Defined results: null is the empty text; texts shorter than ``LENGTH`` bytes
lose nothing; each row is a text of its own, so rows that repeat each other
lose everything from ``LENGTH`` bytes on; rows are told apart by (doc_id,
text), null ids included; matches are judged on the input. Only id and text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmetrics.llm import tokens
from eventmetrics.llm.bitmaps import flagged_members
from eventmetrics.llm.common import written

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1  # short strings in a string of LENGTH bytes
MOST_CONTEXTS = 4000
CELL = 16  # neighbouring strings that are first counted by their common part
PIECE = 1 << 18
POSITION_BITS = 24

ANCHORS = (
    "doc_id long, version long, anchors array<struct<anchor:long,context:long,place:int,low:int,high:int>>"
)
CONTEXTS = "anchor long, copies long, doc_id long, version long, place int, low int, body binary"
SPANS = "doc_id long, version long, low int, high int"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima within blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = np.full((n + width - 1) // width * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


class Anchors(NamedTuple):
    """Anchors of texts that lie one after the other; places count from the first byte of all."""

    text: np.ndarray
    anchor: np.ndarray
    context: np.ndarray
    place: np.ndarray
    low: np.ndarray  # first string of the anchor
    high: np.ndarray  # last one


def find_anchors(data: np.ndarray, offsets: np.ndarray, powers: tokens.Powers) -> Anchors:
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Anchors(none, none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    sums = powers.prefix(data)
    starts = np.arange(len(data) - GRAM + 1)
    grams = tokens.mix((sums[GRAM:] - sums[:-GRAM]) * powers.down[starts])
    mask = np.uint64((1 << POSITION_BITS) - 1)
    owner = (sliding_min((grams & ~mask) | starts.astype(np.uint64), SPAN) & mask).astype(np.int64)
    string = np.arange(len(owner))
    text = np.searchsorted(offsets, string, "right") - 1
    inside = np.flatnonzero(string + LENGTH <= offsets[text + 1])
    if not len(inside):
        return Anchors(none, none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    owner, text = owner[inside], text[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    low, high, place = inside[first], inside[last], owner[first]
    end = high + LENGTH
    body = (sums[end] - sums[low]) * powers.down[low]
    shape = ((place - low) * 1024 + (end - low)).astype(np.uint64)
    context = tokens.mix(tokens.mix(body) + shape * np.uint64(tokens.BASE))
    return Anchors(text[first], grams[place], context, place, low, high)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = tokens.Powers()
    item = pa.struct(
        [("anchor", pa.int64()), ("context", pa.int64()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]
    )
    for whole in batches:
        for batch in tokens.chunks(whole, "text"):
            data, offsets = tokens.text_bytes(batch.column(2))
            if len(data) >= 1 << POSITION_BITS:
                found = [_long_text(data, powers)]  # a slice this large is a single text
            else:
                found = [find_anchors(data, offsets, powers)]
            f = Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)))
            at = offsets[f.text]
            rows = pa.StructArray.from_arrays(
                [
                    pa.array(f.anchor.view(np.int64)),
                    pa.array(f.context.view(np.int64)),
                    *(pa.array((x - at).astype(np.int32)) for x in (f.place, f.low, f.high)),
                ],
                fields=list(item),
            )
            places = np.searchsorted(f.text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(places), rows)],
                names=["doc_id", "version", "anchors"],
            )


def _long_text(data: np.ndarray, powers: tokens.Powers) -> Anchors:
    """Anchors of one very long text, part by part; an anchor that a cut divides counts as two."""
    size, parts = tokens.PIECE_BYTES, []
    for begin in range(0, max(1, len(data) - LENGTH + 1), size):
        part = data[begin : begin + size + LENGTH - 1]
        f = find_anchors(part, np.array([0, len(part)]), powers)
        parts.append(f._replace(place=f.place + begin, low=f.low + begin, high=f.high + begin))
    return Anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)))


class Enhanced(NamedTuple):
    order: np.ndarray  # places in the order of what follows them
    common: np.ndarray  # bytes in common with the one before
    left: np.ndarray  # the byte before, or a value of its own where a body begins


def enhanced_suffixes(bodies: list[np.ndarray]) -> tuple[Enhanced, np.ndarray]:
    """Order, common prefixes and left bytes over all places with LENGTH bytes left, and where bodies begin.

    Ranks by 8, 16, ... bytes; two equal ranks side by side give the next. The
    ranks kept from each round give the common prefix of neighbours, longest
    step first. No common prefix reaches past the end of a body.
    """
    sizes = np.array([len(b) for b in bodies])
    begins = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    symbols = np.zeros(total + 8, np.uint64)
    for begin, body in zip(begins, bodies, strict=True):
        symbols[begin : begin + len(body)] = body
    # A byte and whether there is one, so that ends differ from all bytes: 9 bits, 7 to a word.
    symbols[:total] += np.uint64(1)
    symbols[begins + sizes] = 0
    word = np.zeros(total, np.uint64)
    for k in range(7):
        word = (word << np.uint64(9)) | symbols[k : k + total]
    ranks, reach = [], 7
    key = word
    longest = int(sizes.max())
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.ones(total, np.int64)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(total, np.uint64)
        rank[order] = np.cumsum(new)
        ranks.append((reach, rank.astype(np.uint32)))
        if reach >= longest:
            break
        ahead = np.zeros(total, np.uint64)
        ahead[: max(0, total - reach)] = rank[reach:]
        key = (rank << np.uint64(32)) | ahead
        reach *= 2
    ends = np.repeat(begins + sizes, sizes + 1)
    rest = ends - np.arange(total)
    whole = order[rest[order] >= LENGTH]
    a, b = whole[:-1].copy(), whole[1:].copy()
    limit = np.minimum(rest[a], rest[b])
    common = np.zeros(len(a), np.int64)
    for step, rank in reversed(ranks):
        same = (common < limit) & (rank[np.minimum(a, total - 1)] == rank[np.minimum(b, total - 1)])
        common[same] += step
        a[same] += step
        b[same] += step
    # All ends look alike, so a step may run over two of them into the bodies behind.
    common = np.minimum(common, limit)
    for _ in range(6):  # what is left is shorter than the first step
        same = (common < limit) & (symbols[np.minimum(a, total)] == symbols[np.minimum(b, total)])
        common[same] += 1
        a[same] += 1
        b[same] += 1
        a[~same] = b[~same] = total
        limit[~same] = common[~same]
    left = symbols[whole - 1].astype(np.int64) if len(whole) else np.zeros(0, np.int64)
    at_begin = np.isin(whole, begins)
    left[at_begin] = -1
    return Enhanced(whole, np.concatenate([[0], common]) if len(whole) else common, left), begins


def diverse(left: np.ndarray) -> bool:
    """Do the strings go on differently to the left? A body's begin may go on in any way."""
    return bool(left.min() < 0 or left.min() != left.max())


def maximal_repeats(suffixes: Enhanced) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of all strings of LENGTH bytes or more that no byte to the left or right extends.

    One stack holds the open intervals of common prefixes. Stretches of the
    order whose left bytes all agree hold no maximal repeat and are passed over.
    """
    order, common, left = suffixes
    if len(order) < 2:
        return
    linked = common >= LENGTH
    starts = np.flatnonzero(~linked)
    stops = np.append(starts[1:], len(order))
    lowest, highest = np.minimum.reduceat(left, starts), np.maximum.reduceat(left, starts)
    for run in np.flatnonzero((stops - starts > 1) & ((lowest < 0) | (lowest != highest))):
        begin, stop = int(starts[run]), int(stops[run])
        heights = common[begin + 1 : stop].tolist()
        stack = [(LENGTH - 1, begin)]  # (length, first place in the order)
        for k, height in enumerate([*heights, 0], begin + 1):
            first = k - 1
            while stack[-1][0] > height and stack[-1][0] >= LENGTH:
                length, first = stack.pop()
                if diverse(left[first:k]):
                    yield length, order[first:k]
            if height > stack[-1][0] and height >= LENGTH:
                stack.append((height, first))


def covered_spans(bodies: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(body, low, high) of the bytes that maximal repeats cover; one span at most for each body."""
    suffixes, begins = enhanced_suffixes(bodies)
    low = np.full(len(bodies), np.iinfo(np.int64).max)
    high = np.full(len(bodies), -1)
    for length, places in maximal_repeats(suffixes):
        body = np.searchsorted(begins, places, "right") - 1
        np.minimum.at(low, body, places - begins[body])
        np.maximum.at(high, body, places - begins[body] + length)
    for body in np.flatnonzero(high >= 0):
        # The strings of one body start within fewer than LENGTH bytes, so they leave no gap.
        yield int(body), int(low[body]), int(high[body])


def _suffix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of bodies; rows come ordered by anchor, and an anchor's rows stay in one piece."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        found = covered_spans([np.frombuffer(r[6], np.uint8) for r in rows])
        out = [(rows[i][2], rows[i][3], rows[i][5] + lo, rows[i][5] + hi) for i, lo, hi in found if rows[i][1] == 1]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
            names=["doc_id", "version", "low", "high"],
        )

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= PIECE and row[0] != held[-1][0]:
                yield spans(held)
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield spans(held)


def _body_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts as bytes, from texts with their lists of contexts."""
    names = [f.split()[0] for f in CONTEXTS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc_id, version, text, wanted in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True
        ):
            data = memoryview(text.as_buffer())
            for w in wanted:
                body = bytes(data[w["low"] : w["high"] + LENGTH])
                rows.append((w["anchor"], w["copies"], doc_id, version, w["place"], w["low"], body))
                size += len(body)
            if size >= PIECE:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


CELLS = "doc_id long, version long, low int, cell long, strings array<struct<at:int,string:long>>"


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of a context as hashes, in cells of CELL neighbours, each with the hash of their common part."""
    powers = tokens.Powers()
    kind = pa.list_(pa.struct([("at", pa.int32()), ("string", pa.int64())]))
    for batch in batches:
        out: list[tuple] = []
        for anchor, _, doc_id, version, place, low, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(body, np.uint8)
            sums = powers.prefix(data)
            starts = np.arange(len(data) - LENGTH + 1)
            strings = tokens.mix((sums[starts + LENGTH] - sums[starts]) * powers.down[starts])
            ahead = place - (low + starts)  # how far before its anchor a string begins
            salt = np.uint64(anchor & (2**64 - 1))
            strings = tokens.mix(strings + salt * (ahead.astype(np.uint64) + np.uint64(1)))
            for cell in np.unique(ahead // CELL).tolist():
                # Strings of this cell begin from place - last to place - first.
                first, last = cell * CELL, cell * CELL + CELL - 1
                lo, hi = place - first - low, place - last - low + LENGTH
                mine = np.flatnonzero(ahead // CELL == cell)
                part = (sums[hi : hi + 1] - sums[lo : lo + 1]) * powers.down[lo : lo + 1]
                key = tokens.mix(tokens.mix(part) + salt * (np.uint64(cell) + np.uint64(1)))
                hashes = strings[mine].view(np.int64).tolist()
                out.append(
                    (doc_id, version, low, int(key.view(np.int64)[0]),
                     [{"at": i, "string": h} for i, h in zip(mine.tolist(), hashes, strict=True)])
                )
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "version", "low", "cell", "strings"]
        )


def _spans_by_count(bodies: DataFrame) -> DataFrame:
    """Spans of the contexts of anchors with very many contexts; each context comes once."""
    cells = written(bodies.mapInArrow(_cell_batches, CELLS), "repeat-cells")
    twice = written(cells.groupBy("cell").count().where("count > 1").select("cell"), "repeat-parts")
    kept = cells.join(twice.hint("merge"), "cell", "left_semi")
    strings = written(
        kept.select("doc_id", "version", "low", F.explode("strings").alias("s")).select("doc_id", "version", "low", "s.at", "s.string"),
        "repeat-strings",
    )
    repeated = written(strings.groupBy("string").count().where("count > 1").select("string"), "repeat-found")
    hits = strings.join(repeated.hint("merge"), "string", "left_semi")
    return hits.groupBy("doc_id", "version", "low").agg(F.min("at").alias("a"), F.max("at").alias("b")).select(
        "doc_id", "version", (F.col("low") + F.col("a")).alias("low"), (F.col("low") + F.col("b") + LENGTH).alias("high")
    )


def _with_text(docs: DataFrame, side: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts with a column of ``side`` (written; per doc_id and version), and the texts that have none for certain."""
    key = F.xxhash64("doc_id", "version")
    split, flag = flagged_members(docs, key, side, key)
    other = side.withColumnRenamed("doc_id", "side_id").withColumnRenamed("version", "side_version")
    joined = split.where(F.col(flag)).join(
        other.hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("side_id")) & (F.col("version") == F.col("side_version")),
        "left",
    )
    return joined.select("doc_id", "version", "text", *columns), split.where(~F.col(flag)).drop(flag)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, low, high) of repeated bytes; spans may overlap. ``docs``: doc_id, version, text."""
    anchors = written(docs.mapInArrow(_anchor_batches, ANCHORS), "anchors")
    each = anchors.select("doc_id", "version", F.explode("anchors").alias("x")).select("doc_id", "version", "x.*")
    repeated = written(
        each.select("anchor").groupBy("anchor").count().where("count > 1").select("anchor"), "repeated-anchors"
    )
    likely, flag = flagged_members(each, F.col("anchor"), repeated, F.col("anchor"))
    seen = written(likely.where(F.col(flag)).drop(flag), "anchor-places")
    contexts = written(
        seen.groupBy("anchor", "context").agg(
            F.count("*").alias("copies"), F.min(F.struct("doc_id", "version", "place", "low", "high")).alias("one")
        ),
        "contexts",
    )
    copied = contexts.where("copies > 1").select("anchor", "context")
    whole = seen.join(copied.hint("merge"), ["anchor", "context"], "left_semi").select(
        "doc_id", "version", "low", (F.col("high") + LENGTH).alias("high")
    )
    several = written(
        contexts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchors-with-contexts"
    )
    wanted = written(
        contexts.join(several.hint("merge"), "anchor")
        .groupBy("one.doc_id", "one.version")
        .agg(
            F.collect_list(
                F.struct("anchor", "copies", "kinds", F.col("one.place").alias("place"), F.col("one.low").alias("low"), F.col("one.high").alias("high"))
            ).alias("wanted")
        ),
        "contexts-by-text",
    )
    texts, _ = _with_text(docs, wanted, ["wanted"])
    few = F.filter("wanted", lambda w: w["kinds"] <= MOST_CONTEXTS)
    many = F.filter("wanted", lambda w: w["kinds"] > MOST_CONTEXTS)
    bodies = texts.withColumn("wanted", few).where("size(wanted) > 0").mapInArrow(_body_batches, CONTEXTS)
    trees = (
        bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_suffix_batches, SPANS)
    )
    spans = whole.unionAll(trees)
    if not several.where(F.col("kinds") > MOST_CONTEXTS).isEmpty():
        crowded = texts.withColumn("wanted", many).where("size(wanted) > 0").mapInArrow(_body_batches, CONTEXTS)
        spans = spans.unionAll(_spans_by_count(crowded))
    return spans


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in tokens.chunks(whole, "text", 4 * PIECE)):
        out: list[tuple] = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = bytes(text.as_buffer()) if text.is_valid else b""
            kept, at, removed, runs, open_to = [], 0, 0, 0, -1
            for span in sorted((s["low"], s["high"]) for s in spans or ()):
                if span[0] > open_to:
                    runs += 1
                    kept.append(data[at : span[0]])
                    removed += span[1] - span[0]
                elif span[1] > open_to:
                    removed += span[1] - open_to
                open_to = max(open_to, span[1])
                at = open_to
            left = b"".join([*kept, data[at:]])
            out.append((doc_id, len(data), removed, runs, left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left, as binary)."""
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("version"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    spans = written(
        repeated_spans(own).groupBy("doc_id", "version").agg(F.collect_set(F.struct("low", "high")).alias("spans")),
        "repeat-spans",
    )
    cut, whole = _with_text(own, spans, ["spans"])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    none = F.lit(0).cast("long")
    untouched = whole.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        none.alias("n_removed"),
        none.alias("n_spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    return untouched.unionAll(cut.select("doc_id", "text", "spans").mapInArrow(_cut_batches, schema))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``without_repeats`` with the SHA-256 of the bytes left in their place."""
    return without_repeats(docs, id_col, text_col).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )

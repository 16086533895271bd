"""CSV records from files that are read in pieces, quoted line breaks included.

Whether a line break ends a record depends on all quotes before it, but each
piece of a file changes that in one of four ways: for either state it may begin
in (at a record's start, inside quotes) it ends in one of the two. One pass
finds this for all pieces, running compositions over a file's pieces give the
state each begins in, and a second pass cuts and parses records in all pieces at
once. What a record has in other pieces than its first is put together from
fragments, one per piece at most. Records are parsed as Python's csv module
does, so they are the same as if one reader had gone through the file.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from eventmetrics.session import work_dir

PIECE = "file string, start long"
RECORD = f"{PIECE}, place int, nth long, fields array<string>, text string"
# Order of what a piece holds: the end of an earlier record, records, the beginning of the next one.
HEAD, WHOLE, TAIL = 0, 1, 2


def open_after(line: str, inside: bool) -> bool:
    """Does a quoted field go on behind this line, if one did (``inside``) or did not before it?"""
    at, end = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':  # a quote inside the quotes
                at += 2
                continue
            inside, at = False, at + 1
            # Whatever follows a closing quote belongs to the field, up to the comma.
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at or at > end:
            return False


def parsed(lines: Iterable[str]) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return csv.reader(line + "\n" for line in lines)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start, lines) for each run of lines of one piece."""
    for batch in batches:
        if batch.num_rows:
            file, start, lines = batch.columns
            ends = pc.run_end_encode(pc.binary_join_element_wise(file, start.cast(pa.string()), "\n")).run_ends
            begin = 0
            for end in ends.to_pylist():
                yield file[begin].as_py(), start[begin].as_py(), lines.slice(begin, end - begin)
                begin = end


def _marked(lines: pa.Array) -> Iterator[tuple[str, bool]]:
    """Lines, and whether they have a quote at all."""
    return zip(lines.to_pylist(), pc.match_substring(lines, '"').to_pylist(), strict=True)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece: the state it ends in for either state before it, and the header if it begins the file."""
    now, closed, quoted, header, done = None, False, True, [], True

    def row() -> pa.RecordBatch:
        text = "\n".join(header) if done and now[1] == 0 and header else None
        values = [*now, closed, quoted, text]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
            ["file", "start", "after_record", "after_quote", "header"],
        )

    for file, start, lines in _pieces(batches):
        if (file, start) != now:
            if now is not None:
                yield row()
            now, closed, quoted, header, done = (file, start), False, True, [], False
        for line, has_quote in _marked(lines):
            if has_quote:
                closed, quoted = open_after(line, closed), open_after(line, quoted)
            if not done and (header or line.strip("\r")):
                header.append(line)
                done = not closed
    if now is not None:
        yield row()


def _cut(inside_at: set[tuple[str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of each piece, and its fragments of records that other pieces share."""

    def rows(key: tuple[str, int], place: int, first: int, fields: list, texts: list) -> pa.RecordBatch:
        n = len(fields)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]] * n, pa.string()),
                pa.array([key[1]] * n, pa.int64()),
                pa.array([place] * n, pa.int32()),
                pa.array(range(first, first + n), pa.int64()),
                pa.array(fields, pa.list_(pa.string())),
                pa.array(texts, pa.string()),
            ],
            ["file", "start", "place", "nth", "fields", "text"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, held, inside, nth = None, None, [], False, 0

        def rest() -> Iterator[pa.RecordBatch]:
            if head is not None:  # the whole piece lies inside quotes
                yield rows(now, HEAD, 0, [None], ["\n".join(head)])
            elif held:
                yield rows(now, TAIL, 0, [None], ["\n".join(held)])

        for file, start, lines in _pieces(batches):
            if (file, start) != now:
                yield from rest()
                now, held, nth = (file, start), [], 0
                inside = now in inside_at
                head = [] if inside else None
            whole = []
            for line, has_quote in _marked(lines):
                if has_quote:
                    inside = open_after(line, inside)
                if head is not None:
                    head.append(line)
                    if not inside:
                        yield rows(now, HEAD, 0, [None], ["\n".join(head)])
                        head = None
                else:
                    held.append(line)
                    if not inside:
                        whole += held
                        held = []
            fields = [f for f in parsed(whole) if f]
            if fields:
                yield rows(now, WHOLE, nth, fields, [None] * len(fields))
                nth += len(fields)
        if now is not None:
            yield from rest()

    return cut


def _parse_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A column of texts, one record each, as fields."""
    for batch in batches:
        fields = [next(parsed([t]), []) if t is not None else None for t in batch.column(batch.num_columns - 1).to_pylist()]
        names = [*batch.schema.names[:-1], "fields"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fields, pa.list_(pa.string()))], names)


def _states(effects: DataFrame) -> DataFrame:
    """Pieces with ``inside``: do they begin inside quotes?

    The state before a piece is what the last piece with one outcome for both
    states left, turned over as often as pieces since then turn it over.
    """
    in_order = Window.partitionBy("file").orderBy("start")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("after_record") == F.col("after_quote"), F.col("after_record"))
    turns = F.when(F.col("after_record") & ~F.col("after_quote"), 1).otherwise(0)
    counted = effects.withColumns({"_fixed": fixed, "_turns": F.sum(turns).over(in_order)})
    last = F.last(F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_turns")), ignorenulls=True).over(before)
    until = F.coalesce(F.lag("_turns").over(in_order), F.lit(0))
    since = F.col("_until") - F.coalesce(F.col("_last._turns"), F.lit(0))
    state = F.coalesce(F.col("_last._fixed"), F.lit(False))
    return (
        counted.withColumns({"_last": last, "_until": until})
        .withColumn("inside", F.when(since % 2 == 1, ~state).otherwise(state))
        .select("file", "start", "inside", "header")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, names, fields) of all records below ``path``: each file's header row and a record's fields.

    One row per piece of a file goes through the window that joins them, and
    the pieces that begin inside quotes go to all tasks.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    folder = work_dir(spark, "csv-pieces")
    found = lines.mapInArrow(_effects, f"{PIECE}, after_record boolean, after_quote boolean, header string")
    _states(found).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    inside = {(row.file, row.start) for row in pieces.filter("inside").select("file", "start").collect()}
    records = lines.mapInArrow(_cut(inside), RECORD)
    # A record begins with a tail and takes the heads of the pieces that follow.
    begun = Window.partitionBy("file").orderBy("start", "place")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start", "place", "text"))), lambda p: p["text"])
    shared = (
        records.filter(F.col("place") != WHOLE)
        .withColumn("_record", F.sum(F.when(F.col("place") == TAIL, 1).otherwise(0)).over(begun))
        .groupBy("file", "_record")
        .agg(F.min("start").alias("start"), F.array_join(parts, "\n").alias("text"))
        .select("file", "start", "text")
        .mapInArrow(_parse_texts, f"{PIECE}, fields array<string>")
    )
    first = pieces.filter("start = 0")
    names = (
        first.filter("header IS NOT NULL")
        .select("file", "header")
        .mapInArrow(_parse_texts, "file string, fields array<string>")
        .toDF("file", "names")
    )
    whole = records.filter((F.col("place") == WHOLE) & ((F.col("start") > 0) | (F.col("nth") > 0)))
    every = whole.select("file", "start", "fields").unionAll(shared)
    if not first.filter("header IS NULL").isEmpty():
        # Header rows that go beyond their file's first piece: records put together that begin in it.
        long = shared.filter("start = 0").join(first.filter("header IS NULL").select("file"), "file", "left_semi")
        names = names.unionAll(long.select("file", "fields"))
        is_name = first.filter("header IS NULL").select("file", "start")
        every = every.join(is_name, ["file", "start"], "left_anti")
    return every.join(names, "file").select("file", "names", "fields")

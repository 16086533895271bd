"""Collocations by dynamic itemset counting.

Texts are turned into word hashes once, dealt over ``SHARDS`` shards that are
scanned one after the other, round and round. Words are counted from the first
scan on. At each stop the phrases that have reached ``LEAST`` so far become
known, and a phrase of two to four words is counted from the first scan at whose
start both its subphrases (without the last and without the first word) are
known, until it has seen each shard once. Words, pairs and longer phrases are
so counted in the same scans. The first round stops after each shard, later ones,
in which little becomes known, at their end. When nothing has become known for a
whole round, all phrases are complete.

* What a scan has to count is told by Bloom filters over the known phrases.
  Those of a shard's earlier visits stay at hand, and an occurrence that passed
  one of them was counted then. So every phrase is counted at most once per
  shard, whatever the filters take for known besides; a phrase that occurs
  ``LEAST`` times is never missed, since its subphrases do so as well.
* A filter is built in slices of the hash range of at most ``FILTER_BYTES``; a
  shard is scanned once per slice. One slice holds 16.7 million known phrases.
* A phrase that has reached ``LEAST`` has at least ``LEAST / SHARDS`` in one
  scan. A filter over the phrases that do picks their counts out of all scans
  before anything is summed, so rare phrases are shuffled once, when counted.
* Phrases travel as 64-bit hashes, with one place where each occurs. Words are
  looked up there for the frequent phrases, one row each, and their letters for
  those that may be among the best. Counts tell phrases apart by that hash.

Defined results: a null text is empty, a null language is ``und``; a piece has
only the phrases within it; equal rows count each; tables without a phrase of
``LEAST`` occurrences give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmetrics.llm.bitmaps import CHUNK_BITS, filter_bits, member_filter
from eventmetrics.llm.common import written
from eventmetrics.llm.tokens import LOWER, Powers, chunks, constants, mix, text_bytes
from eventmetrics.session import work_dir

LEAST = 30
LONGEST = 4
SHARDS = 4
BEST = 2000
COVER = 80  # percent of a phrase's occurrences within a longer one, from which on it goes
SCALE = 2_000_000
FILTER_BYTES = 32 * 1024 * 1024
TEXT_BYTES = 512 * 1024
HELD = 1_000_000  # phrases a task holds before it hands them on
SALTS = 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09]] = True
CUT = np.zeros(256, bool)
CUT[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
END = np.uint64(0)  # stands after each piece
# ``mark`` is 8 times a row of the word table and the number of words: short rows, as all counts are moved.
COUNTS = "key long, count long, mark long"
FACTORS = constants(LONGEST, 13)


def words(data: np.ndarray, offsets: np.ndarray, salts: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Each word's hash (salted by its text's language, never zero), first byte and end byte, its text, and
    whether a piece ends after it."""
    word = ~(SPACE | CUT)[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = powers.prefix(LOWER[data])
    text = np.searchsorted(offsets, begin, "right") - 1
    value = (sums[end] - sums[begin]) * powers.down[begin] + (end - begin).astype(np.uint64)
    hashes = mix(mix(value) ^ salts[text])
    hashes[hashes == END] = np.uint64(1)
    cuts = np.concatenate([[0], np.cumsum(CUT[data])])
    closes = np.ones(len(begin), bool)
    closes[:-1] = (text[1:] != text[:-1]) | (cuts[begin[1:]] != cuts[end[:-1]])
    return hashes, begin, end, text, closes


def _with_ends(hashes: np.ndarray, closes: np.ndarray) -> np.ndarray:
    return np.insert(hashes, np.flatnonzero(closes) + 1, END)


def _salts(langs: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 3) for x in langs], np.uint64)


def _by_language(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """The languages in a batch, and each row's number among them."""
    coded = batch.column(0).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, at, lang, n_words, words): word hashes of some texts of one language, END after each piece.

    ``at`` numbers the rows.
    """
    powers, task = Powers(), TaskContext.get().partitionId()
    shard, at = task, task << 32
    for batch in batches:
        for part in chunks(batch, "text", TEXT_BYTES):
            langs, kind = _by_language(part)
            hashes, _, _, text, closes = words(*text_bytes(part.column(1)), _salts(langs)[kind], powers)
            mine = [kind[text] == g for g in range(len(langs))]
            lists = [_with_ends(hashes[m], closes[m]) for m in mine]
            places = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            shard, at = (shard + 1) % SHARDS, at + len(langs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(langs), pa.int32()),
                    pa.array(range(at - len(langs), at), pa.int64()),
                    pa.array(langs, pa.string()),
                    pa.array([int(m.sum()) for m in mine], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(lists).view(np.int64))),
                ],
                ["shard", "at", "lang", "n_words", "words"],
            )


def _word_table(docs: DataFrame) -> DataFrame:
    path = work_dir(docs.sparkSession, "llm-word-hashes")
    rows = docs.mapInArrow(_word_batches, "shard int, at long, lang string, n_words long, words array<long>")
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def phrase_keys(row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the phrases of ``n`` words that begin at these places."""
    if n == 1:
        return row[at]
    total = np.full(len(at), n, np.uint64)
    for j in range(n):
        total += row[at + j] * FACTORS[j]
    return mix(total)


def _within_pieces(row: np.ndarray) -> list[np.ndarray]:
    """Where phrases of 1, 2, ... words begin that lie within a piece."""
    fits = [row != END]
    for n in range(1, LONGEST):
        longer = fits[-1].copy()
        longer[-n:] = False
        longer[:-n] &= row[n:] != END
        fits.append(longer)
    return fits


@dataclass(frozen=True)
class Known:
    """A Bloom filter over phrase hashes, in slices of the hash range."""

    slices: tuple[Broadcast, ...]
    bits: int

    def has(self, keys: np.ndarray, piece: int) -> np.ndarray:
        """Are these in the slice, and perhaps in the filter?"""
        n = len(self.slices)
        piece %= n
        table = self.slices[piece].value
        found = np.ones(len(keys), bool) if n == 1 else (keys >> np.uint64(60)) % np.uint64(n) == np.uint64(piece)
        for shift in (0, 32):
            place = (keys >> np.uint64(shift)) & np.uint64(self.bits - 1)
            byte = table[(place >> np.uint64(3)).astype(np.int64)]
            found &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def known(keys: DataFrame, filter_bytes: int, most_slices: int = 16) -> Known:
    """A filter over the column ``key``. Its slices, of bounded size, pass through the driver."""
    bits, n = filter_bits(keys.count()), 1
    while bits > 8 * filter_bytes and n < most_slices:
        bits, n = bits // 2, n * 2
    bits = min(bits, 8 * filter_bytes)  # beyond so many slices they get fuller and let more pass, which is counted in vain

    def low(shift: int, mask: int) -> Column:
        return F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(mask).cast("long"))

    slices = []
    for piece in range(n):
        found = member_filter(keys.where(low(60, n - 1) == piece), [low(0, bits - 1), low(32, bits - 1)])
        table = np.zeros(bits // 8, np.uint8)
        for chunk, bitmap in found.collect():
            begin = chunk * CHUNK_BITS // 8
            # Spark's bitmaps fill each byte from its lowest bit.
            table[begin : begin + len(bitmap)] = np.frombuffer(bitmap, np.uint8)[: len(table) - begin]
        slices.append(keys.sparkSession.sparkContext.broadcast(table))
    return Known(tuple(slices), bits)


def _active(row: np.ndarray, fits: list[np.ndarray], filters: Known, piece: int) -> list[np.ndarray]:
    """Where phrases of two words and more begin whose subphrases pass the filter.

    With several slices only the first subphrase is looked up, by the slice it lies in.
    """
    whole = len(filters.slices) == 1
    ask, out = fits[0], []
    for n in range(1, LONGEST):
        at = np.flatnonzero(ask)
        passes = np.zeros(len(row), bool)
        passes[at] = filters.has(phrase_keys(row, at, n), piece)
        active = fits[n] & passes
        if whole:
            active[:-1] &= passes[1:]
        out.append(active)
        ask = active if whole else fits[n]
    return out


class Held:
    """Phrases with their counts and a row that has them, added up until there are too many to hold."""

    def __init__(self) -> None:
        self.new: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, n: int, keys: np.ndarray, at: int) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.new.append((n, keys, counts, np.full(len(keys), at)))
        self.size += len(keys)

    def fold(self) -> None:
        total = []
        for n in range(1, LONGEST + 1):
            some = [parts for m, *parts in self.new if m == n]
            if some:
                keys, counts, at = (np.concatenate(column) for column in zip(*some, strict=True))
                keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
                total.append((n, keys, np.bincount(which, counts.astype(float)).astype(np.int64), at[first]))
        self.new, self.size = total, sum(len(keys) for _, keys, _, _ in total)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for n, keys, counts, at in self.new:
            columns = [pa.array(keys.view(np.int64)), pa.array(counts), pa.array(at * 8 + n)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "count", "mark"])
        self.new, self.size = [], 0


def _counter(now: Known | None, visits: dict[int, list[Known | None]], piece: int) -> Callable:
    """Counts the phrases that are active now and were not at an earlier visit to their shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for i in range(batch.num_rows):
                shard, at = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                row = batch.column(2).slice(i, 1).flatten().to_numpy().view(np.uint64)
                if not len(row):
                    continue
                earlier = visits[shard]
                fits = _within_pieces(row)
                if not earlier and piece == 0:
                    held.add(1, row[fits[0]], at)
                if now is not None:
                    active = _active(row, fits, now, piece)
                    for before in earlier:
                        if before is not None:
                            for new, old in zip(active, _active(row, fits, before, piece), strict=True):
                                new &= ~old
                    for n, places in enumerate(active, 2):
                        if places.any():
                            held.add(n, phrase_keys(row, np.flatnonzero(places), n), at)
                if held.size > HELD:
                    held.fold()
                    if held.size > HELD // 2:
                        yield from held.rows()
        held.fold()
        yield from held.rows()

    return count


def _picked(filters: Known, piece: int) -> Callable:
    """Counts of the phrases that pass the filter."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(filters.has(keys, piece)))

    return pick


def frequent_phrases(table: DataFrame, least: int = LEAST, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(key, n, count, at) of the phrases of up to four words that occur ``least`` times, from the word table."""
    spark = table.sparkSession
    folder = work_dir(spark, "llm-phrase-counts")
    visits: dict[int, list[Known | None]] = {shard: [] for shard in range(SHARDS)}
    now, size, step = None, None, 0
    total = [F.sum("count").alias("count"), F.min("mark").alias("mark")]
    words_and_row = [F.col("mark").bitwiseAND(F.lit(7).cast("long")).cast("tinyint").alias("n"), F.shiftright("mark", 3).alias("at")]
    while True:
        # Stops after each shard of the first round, then after each round: little becomes known by then.
        shards = [step] if step < SHARDS else list(visits)
        rows = table.where(F.col("shard").isin(shards)).select("shard", "at", "words")
        scans = [rows.mapInArrow(_counter(now, dict(visits), j), COUNTS) for j in range(len(now.slices) if now else 1)]
        reduce(DataFrame.unionAll, scans).groupBy("key").agg(*total).write.parquet(f"{folder}/scan={step}")
        for shard in shards:
            visits[shard] = [*visits[shard], now]
        counted = spark.read.schema(COUNTS + ", scan int").parquet(folder).drop("scan")
        # Of ``least`` occurrences in all, so many lie in one scan.
        likely = written(counted.where(F.col("count") >= -(-least // SHARDS)).select("key").distinct(), "likely")
        of_likely = known(likely, filter_bytes)
        picked = [counted.mapInArrow(_picked(of_likely, j), COUNTS) for j in range(len(of_likely.slices))]
        found = written(
            reduce(DataFrame.unionAll, picked)
            .groupBy("key")
            .agg(*total)
            .where(F.col("count") >= least)
            .select("key", words_and_row[0], "count", words_and_row[1]),
            "frequent",
        )
        extended = found.where(F.col("n") < LONGEST)
        before, size = size, extended.count()
        # Done when a whole round has made nothing known.
        if step >= SHARDS and size == before:
            return found
        now = known(extended, filter_bytes)
        step += 1


def _parts(n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """First parts and rests of all cuts, and inner phrases of two words or more, as (begin, words)."""
    inner = [(i, m) for m in range(2, n) for i in range(n - m + 1)]
    return [(0, k) for k in range(1, n)], [(k, n - k) for k in range(1, n)], inner


STRUCTURE = "key long, n tinyint, lang string, w array<long>, firsts array<long>, rests array<long>, inner array<long>"


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of each row (lang, words, keys, sizes) by one place where they stand: words and hashes of parts."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang = batch.column(0)[i].as_py()
            row, keys, sizes = (
                batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in range(1, 4)
            )
            row, keys = row.view(np.uint64), keys.view(np.uint64)
            fits = _within_pieces(row)
            for n in range(2, LONGEST + 1):
                wanted = keys[sizes == n]
                if not len(wanted):
                    continue
                at = np.flatnonzero(fits[n - 1])
                here, first = np.unique(phrase_keys(row, at, n), return_index=True)
                at = at[first[np.searchsorted(here, wanted)]]
                lists = [[(j, 1) for j in range(n)], *_parts(n)]
                columns = []
                for parts in lists:
                    values = [phrase_keys(row, at + begin, m) for begin, m in parts]
                    flat = np.stack(values, axis=1).ravel() if values else np.zeros(0, np.uint64)
                    places = np.arange(len(at) + 1, dtype=np.int32) * len(parts)
                    columns.append(pa.ListArray.from_arrays(pa.array(places), pa.array(flat.view(np.int64))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(wanted.view(np.int64)),
                        pa.array(np.full(len(at), n, np.int8)),
                        pa.array([lang] * len(at), pa.string()),
                        *columns,
                    ],
                    ["key", "n", "lang", "w", "firsts", "rests", "inner"],
                )


def _structure(table: DataFrame, found: DataFrame) -> DataFrame:
    """``STRUCTURE`` of the frequent phrases of two words and more, each from one row of the word table."""
    asked = found.where("n > 1").groupBy("at").agg(F.collect_list("key").alias("keys"), F.collect_list("n").alias("sizes"))
    rows = table.select("at", "lang", "words").join(asked, "at").select("lang", "words", "keys", "sizes")
    return rows.mapInArrow(_looked_up, STRUCTURE)


def _letters(filters: Known, piece: int) -> Callable:
    """(hash, word) of the words that pass the filter, once per task."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, done = Powers(), np.zeros(0, np.uint64)
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                langs, kind = _by_language(part)
                data, offsets = text_bytes(part.column(1))
                hashes, begin, end, _, _ = words(data, offsets, _salts(langs)[kind], powers)
                keys, first = np.unique(hashes, return_index=True)
                new = filters.has(keys, piece) & ~np.isin(keys, done)
                if new.any():
                    lower = LOWER[data].tobytes()
                    texts = [lower[begin[i] : end[i]].decode() for i in first[new].tolist()]
                    done = np.union1d(done, keys[new]) if len(done) < HELD else keys[new]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(texts)], ["hash", "word"])

    return spell


def _spelled(docs: DataFrame, phrases: DataFrame, filter_bytes: int) -> DataFrame:
    """``phrases`` (lang, w and more) with ``phrase``, their words joined by spaces."""
    needed = written(phrases.select(F.explode("w").alias("key")).distinct(), "needed-words")
    filters = known(needed, filter_bytes)
    scans = [docs.mapInArrow(_letters(filters, j), "hash long, word string") for j in range(len(filters.slices))]
    letters = written(
        reduce(DataFrame.unionAll, scans).groupBy("hash").agg(F.min("word").alias("word")), "word-letters"
    )
    row = phrases.withColumn("id", F.monotonically_increasing_id())
    joined = (
        row.select("id", F.posexplode("w").alias("nth", "hash"))
        .join(letters, "hash")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "word"))).alias("parts"))
        .select("id", F.array_join(F.transform("parts", lambda p: p["word"]), " ").alias("phrase"))
    )
    return row.join(joined, "id").drop("id", "w")


def _exact(number: Column) -> Column:
    return number.cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    best: int = BEST,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Per language its ``best`` phrases: lang, rank, phrase, a, l, r, n, score."""
    plain = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    table = _word_table(plain)
    found = frequent_phrases(table, least, filter_bytes)
    phrases = written(
        _structure(table, found).join(found.select("key", "n", F.col("count").alias("a")), ["key", "n"]), "phrases"
    )
    part = found.select("key", F.col("n").alias("m"), "count")
    cuts = (
        phrases.select("key", "n", "a", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.col("n") - 1).alias("k"), "firsts", "rests")).alias("c"))
        .select("key", "n", "a", F.col("c.k").cast("int").alias("k"), F.col("c.firsts").alias("first"), F.col("c.rests").alias("rest"))
        .join(part.toDF("first", "k", "l"), ["first", "k"])
        .withColumn("m", F.col("n") - F.col("k"))
        .join(part.toDF("rest", "m", "r"), ["rest", "m"])
        # Whole numbers throughout: decimals hold what passes 64 bits.
        .withColumn("top", F.lit(SCALE).cast("decimal(7,0)") * _exact(F.col("a")))
        .withColumn("bottom", _exact(F.col("l")) + _exact(F.col("r")))
        .withColumn("score", F.expr("top DIV bottom"))
    )
    scored = cuts.groupBy("key", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = (
        phrases.where("n > 2")
        .select(F.explode("inner").alias("key"), F.col("a").alias("longer"))
        .groupBy("key")
        .agg(F.max("longer").alias("longer"))
    )
    kept = (
        phrases.select("key", "n", "lang", "w", "a")
        .join(scored, ["key", "n"])
        .join(inner, "key", "left")
        .where(F.col("longer").isNull() | (100 * _exact(F.col("longer")) < COVER * _exact(F.col("a"))))
        .select("lang", "w", "a", "low.l", "low.r", "low.score", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    )
    order = [F.desc("score"), F.desc("a")]
    # The best of each of a language's parts hold the best of the language, with all that tie with the
    # last of them: no language is sorted in one task.
    tied = F.rank()
    few = kept.withColumn("rank", tied.over(Window.partitionBy("lang", "salt").orderBy(*order))).where(
        F.col("rank") <= best
    )
    few = few.withColumn("rank", tied.over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    named = _spelled(plain, written(few.drop("salt", "rank"), "best-phrases"), filter_bytes)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase")))
    totals = table.groupBy("lang").agg(F.sum("n_words").alias("total"))
    return (
        named.withColumn("rank", place)
        .where(F.col("rank") <= best)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    )

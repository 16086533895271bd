"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Used inside tasks on Arrow batches. Work is cut into pieces of half a megabyte
at blanks, so memory follows the piece and not the batch or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 512 * 1024
BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of BASE and of its inverse, as long as the longest piece so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                run = np.full(n, base, dtype=np.uint64)
                run[0] = 1
                setattr(self, name, np.multiply.accumulate(run))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums whose differences, times a power, are the hashes of all substrings."""
        self.reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return sums


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and where each text begins; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if not len(column) or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cuts of about ``size`` bytes, at text starts or blanks."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(n, begin + size)
        while end < n:
            here = np.flatnonzero(BLANK[data[end : end + size]])
            at = end + int(here[0]) if len(here) else n
            text = np.searchsorted(starts, end)
            at = min(at, int(starts[text]) if text < len(starts) else n)
            if at < n or end + size >= n:
                end = at
                break
            end += size
        yield begin, end
        begin = end


def split_words(
    data: np.ndarray, offsets: np.ndarray, powers: Powers, piece: int = PIECE_BYTES
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and the number of each text's first word."""
    hashes, begins, ends = [], [], []
    for lo, hi in _pieces(data, offsets[:-1], piece):
        part = data[lo:hi]
        word = ~BLANK[part]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = offsets[(offsets > lo) & (offsets < hi)] - lo
        first[edges] = word[edges]
        last[edges - 1] = word[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = powers.prefix(LOWER[part])
        value = (sums[end] - sums[start]) * powers.down[start]
        hashes.append(mix(value + (end - start).astype(np.uint64) * np.uint64(BASE)))
        begins.append(start + lo)
        ends.append(end + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, offsets)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the number of each text's first one.

    A text of fewer words has one run of all its words, one without words none.
    """
    lengths = np.diff(first)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    places = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    factors = constants(width, 5)
    out = np.empty(places[-1], np.uint64)
    if len(words) >= width:
        run = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            run += words[j : j + len(run)] * factors[j]
        whole = np.flatnonzero(lengths >= width)
        take = np.arange(int(counts[whole].sum())) + np.repeat(
            first[whole] - np.concatenate([[0], np.cumsum(counts[whole])[:-1]]), counts[whole]
        )
        put = np.ones(len(out), bool)
        put[places[:-1][(lengths > 0) & (lengths < width)]] = False
        out[put] = run[take]
    for d in np.flatnonzero((lengths > 0) & (lengths < width)):
        short = words[first[d] : first[d + 1]]
        out[places[d]] = (short * factors[: len(short)]).sum(dtype=np.uint64) + np.uint64(len(short)) * factors[-1]
    return mix(out), places


def distinct_sorted(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, without repeats, and where each text begins."""
    values = values.copy()
    for a, b in zip(places[:-1], places[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    inner = places[:-1]
    new[inner[inner < len(values)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return values[new], kept[places]


def chunks(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, one row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    _, offsets = text_bytes(texts)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def list_column(values: np.ndarray, places: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(values, kind))

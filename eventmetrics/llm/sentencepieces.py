"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut before each word-start mark that no piece can span; different
segments of a batch are searched once each. Segments of equal length advance
together: for every end position the hashes of all substrings that end there
probe the sorted keys of the pieces of that length, and a vectorised maximum
keeps score and back pointer. Characters without a piece become byte pieces.

The scores are those of the model file. Files of the merge kind hold ranks, not
scores; there the log of Zipf's law over the rank is the score, and the best
segmentation under it is a unigram one, which differs from merging by rank.
Decoding gives the text back byte for byte in either case.

Defined results: null and empty texts have no pieces and decode to the empty
text; the word-start mark (U+2581) inside a text decodes to a blank, as always
with these models; of equally good segmentations of a segment the one whose last
piece is longest wins. Null ids and repeated rows are encoded like any other row. Only id and text are read.
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

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
CHUNK_BYTES = 1024 * 1024
RANKS_AT = -1e8  # merge files give pieces that merging cannot reach a score below this


class Pieces(NamedTuple):
    """A vocabulary, ready for probing and for decoding."""

    texts: list[str]
    keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes, ids, scores
    byte_ids: np.ndarray  # id of the piece of each byte
    data: np.ndarray  # decoded bytes of all pieces, one after the other
    places: np.ndarray
    unknown: float

    @property
    def longest(self) -> int:
        return max(self.keys)


def build(texts: list[str], scores: list[float], byte_of: dict[int, int], hidden: set[int]) -> Pieces:
    """``byte_of``: byte value of byte pieces by id; ``hidden``: ids that never stand for text."""
    powers = tokens.Powers()
    by_length: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        if i not in byte_of and i not in hidden:
            by_length.setdefault(len(text), []).append(i)
    keys = {}
    for length, ids in by_length.items():
        points = np.frombuffer("".join(texts[i] for i in ids).encode("utf-32-le"), np.uint32)
        sums, starts = powers.prefix(points), np.arange(len(ids)) * length
        hashes = tokens.mix((sums[starts + length] - sums[starts]) * powers.down[starts])
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError(f"two pieces of {length} characters share a hash")
        order = np.argsort(hashes)
        keys[length] = (hashes[order], np.array(ids)[order], np.array(scores, np.float32)[ids][order])
    decoded = [
        bytes([byte_of[i]]) if i in byte_of else b"" if i in hidden else t.replace(MARK, " ").encode()
        for i, t in enumerate(texts)
    ]
    byte_ids = np.full(256, -1)
    for i, value in byte_of.items():
        byte_ids[value] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no piece for some bytes, so unknown characters would be lost")
    shown = [s for i, s in enumerate(scores) if i not in byte_of and i not in hidden]
    return Pieces(
        texts,
        keys,
        byte_ids,
        np.frombuffer(b"".join(decoded), np.uint8),
        np.concatenate([[0], np.cumsum([len(d) for d in decoded])]),
        min(shown) - UNKNOWN_PENALTY,
    )


def load(path: str = DEFAULT_MODEL) -> Pieces:
    """Read a model file. Its texts must be taken as they are, with a mark before the first word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "a  ﬁ① b "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError(f"{path} changes texts before it splits them")
    n = model.get_piece_size()
    byte_of = {i: int(model.id_to_piece(i)[3:5], 16) for i in range(n) if model.is_byte(i)}
    hidden = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    texts, scores = [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]
    if any(MARK in t.lstrip(MARK) for i, t in enumerate(texts) if i not in hidden):
        raise ValueError(f"{path} has pieces that span words")
    return build(texts, zipf(scores, byte_of.keys() | hidden), byte_of, hidden)


def zipf(scores: list[float], without: set[int]) -> list[float]:
    """Scores of a merge file, which are negative ranks, as logs of 1 / (rank + 2); others as they are."""
    shown = [s for i, s in enumerate(scores) if i not in without]
    ranks = all(s == int(s) and s <= 0 for s in shown) and len(set(shown)) > len(shown) // 2
    if not ranks:
        return scores
    lowest = min(s for s in shown if s > RANKS_AT)
    return [-float(np.log(2.0 - max(s, lowest))) for s in scores]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _segments(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where segments begin: at marks that do not follow a mark, and at texts."""
    mark = points == ord(MARK)
    begin = mark.copy()
    begin[1:] &= ~mark[:-1]
    begin[text_starts] = True
    return np.flatnonzero(begin)


def viterbi(points: np.ndarray, starts: np.ndarray, length: int, sums: np.ndarray, down: np.ndarray, pieces: Pieces):
    """Best pieces of segments of one length: ids in reading order (-1: unknown), where each ends, how many."""
    n = len(starts)
    best = np.full((length + 1, n), -np.inf, np.float32)
    best[0] = 0
    back = np.zeros((length + 1, n), np.int32)
    chosen = np.full((length + 1, n), -1, np.int32)
    unknown = np.float32(pieces.unknown)
    for end in range(1, length + 1):
        for begin in range(max(0, end - pieces.longest), end):
            if (end - begin) in pieces.keys:
                keys, ids, scores = pieces.keys[end - begin]
                hashes = tokens.mix((sums[starts + end] - sums[starts + begin]) * down[starts + begin])
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                score = best[begin] + scores[at]
                better = np.flatnonzero((keys[at] == hashes) & (score > best[end]))
                best[end, better] = score[better]
                back[end, better] = begin
                chosen[end, better] = ids[at[better]]
        # A single character that is no piece.
        alone = np.flatnonzero(~_is_piece(points[starts + end - 1], pieces))
        score = best[end - 1, alone] + unknown
        better = alone[score > best[end, alone]]
        best[end, better] = best[end - 1, better] + unknown
        back[end, better] = end - 1
        chosen[end, better] = -1
    ids = np.zeros((length, n), np.int32)
    ends = np.zeros((length, n), np.int32)
    at, count, live = np.full(n, length), np.zeros(n, np.int64), np.arange(n)
    while len(live):
        ids[count[live], live] = chosen[at[live], live]
        ends[count[live], live] = at[live]
        count[live] += 1
        at[live] = back[at[live], live]
        live = live[at[live] > 0]
    return ids, ends, count


def _is_piece(points: np.ndarray, pieces: Pieces) -> np.ndarray:
    keys = pieces.keys.get(1)
    if keys is None:
        return np.zeros(len(points), bool)
    hashes = tokens.mix(points.astype(np.uint64) + np.uint64(1))
    at = np.minimum(np.searchsorted(keys[0], hashes), len(keys[0]) - 1)
    return keys[0][at] == hashes


def _bytes_of(points: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Byte pieces of characters, and how many each has."""
    ids, counts = [], []
    for point in points.tolist():
        data = chr(point).encode()
        ids += [pieces.byte_ids[b] for b in data]
        counts.append(len(data))
    return np.array(ids, np.int32), np.array(counts, np.int64)


def encode_texts(texts: list[str], pieces: Pieces, powers: tokens.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text begins."""
    marked = [MARK + t if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).copy()
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    points[points == 0x20] = ord(MARK)
    lengths = np.array([len(t) for t in marked], np.int64)
    text_places = np.concatenate([[0], np.cumsum(lengths)])
    begins = _segments(points, text_places[:-1][lengths > 0])
    sizes = np.diff(np.append(begins, len(points)))
    sums = powers.prefix(points)
    hashes = tokens.mix((sums[begins + sizes] - sums[begins]) * powers.down[begins] + sizes.astype(np.uint64))
    _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
    own_begins, own_sizes = begins[first], sizes[first]
    parts, own_counts = [], np.zeros(len(first), np.int64)
    order = np.argsort(own_sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(own_sizes[order])) + 1
    for group in np.split(order, cuts):
        length = int(own_sizes[group[0]])
        step = max(1, (1 << 19) // (length + 1))
        for lo in range(0, len(group), step):
            part = group[lo : lo + step]
            ids, ends, count = viterbi(points, own_begins[part], length, sums, powers.down, pieces)
            # Back to front, then segment by segment.
            row = np.repeat(count, count) - 1 - _ragged(np.zeros(len(part), np.int64), count)
            column = np.repeat(np.arange(len(part)), count)
            flat, lost = ids[row, column], None
            unknown = np.flatnonzero(flat < 0)
            if len(unknown):
                at = own_begins[part][column[unknown]] + ends[row[unknown], column[unknown]] - 1
                lost, widths = _bytes_of(points[at], pieces)
                spread = np.ones(len(flat), np.int64)
                spread[unknown] = widths
                places = np.cumsum(spread) - spread
                wide = np.empty(int(spread.sum()), np.int32)
                wide[_ragged(places[unknown], widths)] = lost
                known = np.flatnonzero(flat >= 0)
                wide[places[known]] = flat[known]
                count = np.bincount(column, weights=spread, minlength=len(part)).astype(np.int64)
                flat = wide
            own_counts[part] = count
            parts.append(flat)
    # ``parts`` follow ``order``; find each segment's run in it.
    whole = np.concatenate(parts)
    run_starts = np.empty(len(first), np.int64)
    run_starts[order] = np.cumsum(own_counts[order]) - own_counts[order]
    counts = own_counts[same]
    found = whole[_ragged(run_starts[same], counts)]
    until = np.concatenate([[0], np.cumsum(counts)])
    return found, until[np.searchsorted(begins, text_places)]


def decode_ids(ids: np.ndarray, places: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins; the first mark of a text goes."""
    lengths = (pieces.places[1:] - pieces.places[:-1])[ids]
    data = pieces.data[_ragged(pieces.places[ids], lengths)]
    until = np.concatenate([[0], np.cumsum(lengths)])[places]
    full = np.flatnonzero(np.diff(until))
    leading = full[data[until[full]] == 0x20]
    keep = np.ones(len(data), bool)
    keep[until[leading]] = False
    return data[keep], until - np.searchsorted(until[leading], until, "left")


def _encode_batches(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = tokens.Powers()
        for whole in batches:
            for batch in tokens.chunks(whole, "text", CHUNK_BYTES):
                ids, places = encode_texts([t or "" for t in batch.column(1).to_pylist()], pieces, powers)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), tokens.list_column(ids, places, pa.int32())], names=["doc_id", "piece_ids"]
                )

    return run


def _decode_batches(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            offsets = column.offsets.to_numpy()
            ids = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            data, places = decode_ids(ids, offsets - offsets[0], pieces)
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digest_batches(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = tokens.Powers()
        for whole in batches:
            for batch in tokens.chunks(whole, "text", CHUNK_BYTES):
                ids, places = encode_texts([t or "" for t in batch.column(1).to_pylist()], pieces, powers)
                data, until = decode_ids(ids, places, pieces)
                given, offsets = tokens.text_bytes(batch.column(1))
                rows = range(batch.num_rows)
                raw = ids.astype("<i4")
                decoded = [data[until[i] : until[i + 1]].tobytes() for i in rows]
                sha = lambda blob: hashlib.sha256(blob).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.diff(places), pa.int64()),
                        pa.array([sha(raw[places[i] : places[i + 1]].tobytes()) for i in rows]),
                        pa.array([sha(d) for d in decoded]),
                        pa.array([decoded[i] == given[offsets[i] : offsets[i + 1]].tobytes() for i in rows]),
                    ],
                    names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    return run


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, piece_ids."""
    return _own(docs, id_col, text_col).mapInArrow(_encode_batches(pieces), "doc_id long, piece_ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Per row of (doc_id, piece_ids): doc_id, text."""
    return encoded.select("doc_id", "piece_ids").mapInArrow(_decode_batches(pieces), "doc_id long, text string")


def report(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, without moving the ids: how many, their SHA-256 (little-endian int32), that of the
    decoded text, and whether decoding gave the text back."""
    schema = "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return _own(docs, id_col, text_col).mapInArrow(_digest_batches(pieces), schema)

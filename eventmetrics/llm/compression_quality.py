"""Quality classifier by compression.

One zstandard dictionary is built from good labelled texts and one from bad
ones. A text is compressed with both, in blocks of equal length so that long
texts are judged like short ones; the difference of the two sizes over the
text's own size says which kind it resembles (a text that is mere repetition
compresses well with either and comes out near zero), and a logistic curve,
fitted on texts the dictionaries have not seen, turns it into a probability.

The fit uses a bounded sample of labelled rows: per class the rows with the
smallest hashes of their id, up to ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES``
bytes. Class shares come from all labels. Scoring reads every whole text.

Defined results: null and empty texts have difference 0 and get the curve's
value there; without labels of both classes every score is the share of good
labels (0.5 without any); an id whose labels disagree is not learnt from;
repeated rows get equal scores; a null id is scored like any other, and held
out (it has no remainder).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 8_000_000
BLOCK = 2048
DICTIONARY_BYTES = 65536
LEVEL = 3
FOLDS = 5
THRESHOLD = 0.3


class Model(NamedTuple):
    """``good`` and ``bad`` are dictionaries, empty for a constant score."""

    good: bytes
    bad: bytes
    bias: float
    slope: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def blocks(text: bytes) -> Iterator[bytes]:
    for at in range(0, len(text), BLOCK):
        yield text[at : at + BLOCK]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the blocks themselves where there are too few to train on."""
    samples = [b for text in texts for b in blocks(text)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Sizes:
    """Compressed sizes of texts under two dictionaries."""

    def __init__(self, model: Model) -> None:
        self.compressors = []
        for content in (model.good, model.bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def difference(self, text: bytes) -> float:
        good, bad = (sum(len(c.compress(b)) for b in blocks(text)) for c in self.compressors)
        return (bad - good) / len(text) if text else 0.0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a weighted logistic curve, by Newton steps with a light ridge."""
    beta = np.zeros(2)
    rows = np.stack([np.ones_like(x), x], axis=1)
    ridge = np.diag([1e-6, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        gradient = rows.T @ (weight * (y - p)) - ridge @ beta
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge
        step = np.linalg.solve(curve, gradient)
        beta += np.clip(step, -5 / max(1e-9, np.std(x)), 5 / max(1e-9, np.std(x)))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _sample(docs: DataFrame, labels: DataFrame, quality: int) -> list[bytes]:
    """Texts of one class in the order of their hashes, within the two bounds."""
    order = F.xxhash64("doc_id")
    ids = labels.where(F.col("quality") == quality).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
    picked = docs.join(F.broadcast(ids.select(F.col("doc_id").alias("picked"))), F.col("doc_id") == F.col("picked"))
    sizes = picked.select("doc_id", order.alias("place"), F.octet_length("text").alias("bytes"))
    # One row for each picked id and repeat of it, cut to the row bound.
    total, chosen = 0, set()
    for doc_id, _, size in sorted(map(tuple, sizes.orderBy("place", "doc_id").limit(SAMPLE_ROWS).collect()), key=lambda r: r[1:2] + r[:1]):
        total += size or 0
        if total > SAMPLE_BYTES and chosen:
            break
        chosen.add(doc_id)
    if not chosen:
        return []
    rows = picked.where(F.col("doc_id").isin(sorted(chosen))).dropDuplicates(["doc_id"]).select(order.alias("place"), "doc_id", "text")
    return [(t or "").encode() for _, _, t in sorted(map(tuple, rows.collect()), key=lambda r: r[:2])]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the labelled rows that are not held out."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
    )
    shares = {int(q): n for q, n in known.groupBy("quality").count().collect()}
    good_share = shares.get(1, 0) / (shares.get(1, 0) + shares.get(0, 0)) if shares else 0.5
    texts = {q: _sample(docs, known, q) for q in (1, 0)}
    if min(map(len, texts.values())) < 2:
        share = min(max(good_share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", math.log(share / (1 - share)), 0.0)
    # Even rows make the dictionaries, odd rows the curve.
    bare = Model(dictionary(texts[1][::2]), dictionary(texts[0][::2]), 0.0, 0.0)
    sizes = Sizes(bare)
    x = {q: np.array([sizes.difference(t) for t in texts[q][1::2]]) for q in (1, 0)}
    weight = np.concatenate([np.full(len(x[q]), (shares[q] / sum(shares.values())) / len(x[q])) for q in (1, 0)])
    n = len(x[1]) + len(x[0])
    y = np.concatenate([np.ones(len(x[1])), np.zeros(len(x[0]))])
    bias, slope = logistic(np.concatenate([x[1], x[0]]), y, weight * n)
    return bare._replace(bias=bias, slope=slope)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model) if model.good else None
        for batch in batches:
            x = np.zeros(batch.num_rows)
            if sizes:
                for i, text in enumerate(batch.column(1)):
                    x[i] = sizes.difference(memoryview(text.as_buffer()) if text.is_valid else b"")
            score = 1 / (1 + np.exp(-np.clip(model.bias + model.slope * x, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(x)], names=["doc_id", "score", "difference"]
            )

    return run


def scored(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, difference."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = own.mapInArrow(_score(model), "doc_id long, score double, difference double")
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "difference",
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))

"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host, then a path that must begin the URL's path; it fits the host
and all its subdomains, and the longest fitting rule decides. The URLs that
rules decide are the labelled ones. Trees learn from their lexical features:
lengths, depth, digit ratio, character entropy, parameter counts, and, for the
suffix of the host, how many URLs have it and which share of the labelled ones
is blocked. Suffix statistics count all URLs; the trees are fitted on a bounded
sample, the ``SAMPLE_ROWS`` labelled URLs with the smallest hashes.

Defined results: a null URL and one without ``://`` have an empty host and path
and get a verdict like any other; without labelled URLs of both kinds the
verdict is that of the only kind, or allow; repeated URLs get equal verdicts; a
null id is passed on. Only id and url are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmetrics.llm.common import written

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 40, 3, 32, 0.2, 20
PRIOR = 20.0  # labelled URLs a suffix must have to count as much as all others together
BLOCK_FROM = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "url_length host_length path_length depth labels digit_ratio entropy host_entropy n_parameters query_length "
    "n_hyphens longest_label suffix_count suffix_share"
).split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, "([^.]*)$", 1)


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def features(url: str, host: str, path: str, count: float, share: float) -> list[float]:
    """One value for each of FEATURES. ``share``: blocked among the labelled URLs of the host's suffix."""
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".")
    return [
        len(url),
        len(host),
        len(path),
        sum(1 for part in path.split("/") if part),
        len(labels),
        sum(c.isdigit() for c in url) / max(1, len(url)),
        _entropy(url),
        _entropy(host),
        sum(1 for part in query.split("&") if part),
        len(query),
        url.count("-"),
        max(map(len, labels)),
        np.log1p(count),
        share,
    ]


class Tree(NamedTuple):
    """A complete tree: for each inner node a feature and a bound (go right above it), for each leaf a value."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray


class Model(NamedTuple):
    bias: float
    trees: list[Tree]


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for _ in range(DEPTH):
        node = 2 * node + 1 + (x[rows, tree.feature[node]] > tree.bound[node])
    return node - (2**DEPTH - 1)


def margins(model: Model, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model.bias)
    for tree in model.trees:
        total += tree.leaf[leaf_of(tree, x)]
    return total


def _bounds(x: np.ndarray) -> list[np.ndarray]:
    """Where bins end: quantiles of each feature, each value once."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]


def _grow(binned: np.ndarray, bounds: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> Tree:
    """A tree that follows the gradient: at each node the split with the largest gain over histograms."""
    inner = 2**DEPTH - 1
    feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(binned), np.int64)
    for n in range(inner):
        rows = np.flatnonzero(node == n)
        best = (1e-9, 0, np.inf, BINS)
        g, h = gradient[rows], weight[rows]
        for f, cuts in enumerate(bounds):
            size = len(cuts) + 1
            counts = np.cumsum(np.bincount(binned[rows, f], minlength=size))[:-1]
            left_g = np.cumsum(np.bincount(binned[rows, f], g, size))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], h, size))[:-1]
            score = lambda a, b: a * a / (b + 1.0)
            gain = score(left_g, left_h) + score(g.sum() - left_g, h.sum() - left_h) - score(g.sum(), h.sum())
            gain[(counts < LEAST) | (len(rows) - counts < LEAST)] = 0
            if len(gain) and gain.max() > best[0] + 1e-12:
                at = int(gain.argmax())
                best = (float(gain[at]), f, float(cuts[at]), at)
        feature[n], bound[n] = best[1], best[2]
        node[rows] = 2 * n + 1 + (binned[rows, best[1]] > best[3])
    leaf = node - inner
    g = np.bincount(leaf, gradient, inner + 1)
    h = np.bincount(leaf, weight, inner + 1)
    return Tree(feature, bound, RATE * g / (h + 1.0))


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees for the log odds of ``y``; none where there is one kind of label only."""
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.0
    bias = float(np.log(max(share, 1e-6) / max(1e-6, 1 - share)))
    model = Model(bias, [])
    if not 0 < y.sum() < len(y):
        return model
    bounds = _bounds(x)
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T, strict=True)], axis=1)
    margin = np.full(len(y), bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, bounds, y - p, p * (1 - p))
        model.trees.append(tree)
        margin += tree.leaf[leaf_of(tree, x)]
    return model


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    columns = [batch.column(i).to_pylist() for i in range(1, 6)]
    rows = [features(u or "", h, p, c, s) for u, h, p, c, s in zip(*columns, strict=True)]
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch)
        places = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
        values = pa.ListArray.from_arrays(places, pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["label", "x"])


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(margins(model, _matrix(batch)), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 2, 3, 6, 7)), pa.array(score)],
                names=["page_id", "host", "path", "rule", "rule_verdict", "block_score"],
            )

    return run


def labelled(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, rule_verdict, suffix), written."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    fitted = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return written(
        fitted.select("page_id", "url", "host", "path", F.col("fit.rule"), F.col("fit.verdict").alias("rule_verdict"), suffix(F.col("host")).alias("suffix")),
        "urls",
    )


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """(suffix, n, n_labelled, n_blocked) over all URLs, written."""
    return written(
        urls.groupBy(F.col("suffix").alias("known_suffix")).agg(
            F.count("*").alias("n"),
            F.count("rule_verdict").alias("n_labelled"),
            F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("n_blocked"),
        ),
        "suffixes",
    )


def _inputs(urls: DataFrame, statistics: DataFrame, base: float) -> DataFrame:
    """Feature inputs: the count of a URL's suffix and its blocked share, drawn to that of all labelled URLs."""
    share = (F.col("n_blocked") + PRIOR * base) / (F.col("n_labelled") + PRIOR)
    joined = urls.join(statistics, F.col("suffix") == F.col("known_suffix"))
    return joined.withColumn("count", F.col("n").cast("double")).withColumn("share", share.cast("double"))


def fit(urls: DataFrame, statistics: DataFrame, base: float) -> Model:
    """Boosted trees on a bounded sample of the labelled URLs."""
    sample = (
        urls.where("rule_verdict IS NOT NULL")
        .orderBy(F.xxhash64("url"), "url", "page_id")
        .limit(SAMPLE_ROWS)
    )
    rows = _inputs(sample, statistics, base).select(
        (F.col("rule_verdict") == "block").cast("double").alias("label"), "url", "host", "path", "count", "share"
    )
    found = rows.mapInArrow(_feature_batches, "label double, x array<double>").collect()
    # Rows come in any order; sorted, so that sums and with them the trees are the same in each run.
    table = np.array(sorted([r.label, *r.x] for r in found), float).reshape(len(found), len(FEATURES) + 1)
    return boost(table[:, 1:], table[:, 0])


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, block_score (of the trees)."""
    urls = labelled(pages, rules, id_col, url_col)
    statistics = suffix_statistics(urls)
    n_labelled, n_blocked = statistics.agg(F.sum("n_labelled"), F.sum("n_blocked")).first()
    base = (n_blocked or 0) / n_labelled if n_labelled else 0.0
    model = fit(urls, statistics, base)
    rows = _inputs(urls, statistics, base).select(
        "page_id", "url", "host", "path", "count", "share", "rule", "rule_verdict"
    )
    scored = rows.mapInArrow(
        _score_batches(model),
        "page_id long, host string, path string, rule string, rule_verdict string, block_score double",
    )
    guess = F.when(F.col("block_score") >= BLOCK_FROM, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", guess).alias("verdict"), "block_score"
    )

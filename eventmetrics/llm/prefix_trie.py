"""Prefix trie of conversations by collapsing whole sequences.

Conversations are rebuilt (``rebuilt``), identical ones become one weighted
sequence with the list of conversations that end there, sequences that are
proper prefixes of others are told from leaves by an anti-join, and weighted
prefixes are aggregated to nodes. Turns are narrow rows throughout (two hashes
and a word count); no conversation, node or end list is gathered into one row.

* A prefix is known by two 64-bit polynomial hashes, so prefixes of a rebuilt
  conversation follow from running sums: head of one, tail of another. The sums
  run over turns that are dealt out by range, so a conversation with a third of
  all turns lies in many tasks; one row per task (how its last conversation
  stands) passes through the driver to join the pieces.
* The words below a node, each distinct node counted once, need no walk over
  ancestors: each node belongs to the sequence with its smallest conversation,
  and what a sequence owns is the end of its path. Sums over sequences of owned
  words, corrected on the owner's own path, give each subtree.
* End lists are joined to text in ranges of 65,536 ids; the hash of a list then
  runs over these texts in order, batch by batch.

Defined results: rows without a conversation id are left out; null roles and
texts are empty; turns that tie are ordered by role, then by their content's
hash, so repeated rows are turns of their own and equal tables give equal tries;
ids are whole numbers (others fail in the cast); an empty table has no nodes,
not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmetrics.llm.common import words_of, written

FAMILY = 20  # conversations c - c % FAMILY ... share the head of the first one
HEADS = 4  # a head has 0 to HEADS - 1 turns
RANGE_BITS = 16
BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)  # odd, so they have inverses modulo 2**64
WRAP = 2**64

KEY = ["depth", "a", "b"]
SUMS = ("a", "pa", "b", "pb")  # up to and with a turn, and up to the turn before
TURN = "conv long, place long, n_words long, words long, a long, pa long, b long, pb long"
PREFIX = "seq long, depth long, a long, b long, n_words long, before long, pa long, pb long"


def _powers(n: int, base: int) -> np.ndarray:
    run = np.full(max(1, n), base, np.uint64)
    run[0] = 1
    return np.multiply.accumulate(run)


def _power_of(exponent: np.ndarray, base: int) -> np.ndarray:
    """base ** exponent modulo 2**64, for small exponents of either sign."""
    values, which = np.unique(exponent, return_inverse=True)
    return np.array([pow(base, int(e), WRAP) for e in values], np.uint64)[which] if len(values) else np.zeros(0, np.uint64)


def _signed(x: int) -> int:
    return x - WRAP if x >= WRAP // 2 else x


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _frame(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], list(columns)
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's place in its conversation and sums up to it, counted from this task's first turn."""
    part = TaskContext.get().partitionId()
    conv, turns, words, sums = None, 0, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _columns(batch)
        n = batch.num_rows
        new = np.ones(n, bool)
        new[1:] = x["conv"][1:] != x["conv"][:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        goes_on = first == 0 if x["conv"][0] == conv else np.zeros(n, bool)
        place = np.arange(n) - first + np.where(goes_on, turns, 0)
        total = np.cumsum(x["n_words"])
        out = {
            "part": np.full(n, part, np.int32),
            "conv": x["conv"],
            "place": place,
            "n_words": x["n_words"],
            "words": total - (total - x["n_words"])[first] + np.where(goes_on, words, 0),
        }
        for s, name in enumerate("ab"):
            with np.errstate(over="ignore"):
                term = x[f"h{name}"].view(np.uint64) * _powers(int(place.max()) + 1, BASES[s])[place]
                run = np.cumsum(term)
                out[name] = run - (run - term)[first] + np.where(goes_on, np.uint64(sums[s]), np.uint64(0))
                out[f"p{name}"] = out[name] - term
        conv, turns, words = x["conv"][-1], int(place[-1]) + 1, int(out["words"][-1])
        sums = [int(out["a"][-1]), int(out["b"][-1])]
        yield _frame(out)


def _joined_up(carry: dict[int, tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds what earlier tasks hold of a task's first conversation."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(batch)
            x = {k: v.view(np.uint64).copy() if k in SUMS else v.copy() for k, v in x.items()}
            for part in np.unique(x["part"]).tolist():
                if part not in carry:
                    continue
                conv, turns, words, *sums = carry[part]
                here = np.flatnonzero((x["part"] == part) & (x["conv"] == conv))
                x["place"][here] += turns
                x["words"][here] += words
                for name in SUMS:
                    base, s = BASES[name[-1] == "b"], sums[name[-1] == "b"]
                    with np.errstate(over="ignore"):
                        x[name][here] = x[name][here] * np.uint64(pow(base, turns, WRAP)) + np.uint64(s)
            del x["part"]
            yield _frame(x)

    return add


def _turns(conversations: DataFrame) -> DataFrame:
    """Each turn (``TURN``) with its place and sums up to it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    narrow = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("ha"),
        F.xxhash64(F.lit(7), text, role).alias("hb"),
        F.size(words_of(text)).cast("long").alias("n_words"),
    )
    order = ["conv", "turn", "role", "ha", "hb"]
    pieces = written(
        narrow.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", "ha", "hb", "n_words")
        .mapInArrow(_running, f"part int, {TURN}"),
        "turn-pieces",
    )
    # One row per task of the sort.
    last = F.max_by(F.struct("conv", (F.col("place") + 1).alias("turns"), "words", "a", "b"), F.struct("conv", "place"))
    parts = pieces.groupBy("part").agg(F.min("conv").alias("first"), last.alias("last")).orderBy("part").collect()
    carry, state = {}, None
    for part in parts:
        conv, turns, words, *sums = part.last
        sums = [s % WRAP for s in sums]
        if state and state[0] == part.first:
            carry[part.part] = state
            if conv == part.first:  # the whole task is one conversation
                sums = [
                    (s * pow(base, state[1], WRAP) + before) % WRAP
                    for s, base, before in zip(sums, BASES, state[3:], strict=True)
                ]
                turns, words = turns + state[1], words + state[2]
        state = (conv, turns, words, *sums)
    return pieces.mapInArrow(_joined_up(carry), TURN)


STATE = ("words", "a", "b")


def _shift(x: dict[str, np.ndarray], name: str, base: int) -> np.ndarray:
    """A sum over a conversation's own turns, as a sum over the rebuilt one: head before, own head taken off."""
    power = _power_of(x["head"] - x["own_head"], base)
    with np.errstate(over="ignore"):
        own, head = (x[f"{p}_{name[-1]}"].view(np.uint64) for p in ("own", "head"))
    with np.errstate(over="ignore"):
        return (x[name].view(np.uint64) - own) * power + head


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each rebuilt conversation's length, words and hashes."""
    for batch in batches:
        x = _columns(batch)
        yield _frame(
            {
                "conv": x["conv"],
                "depth": x["head"] + x["turns"] - x["own_head"],
                "a": _shift(x, "a", BASES[0]),
                "b": _shift(x, "b", BASES[1]),
                "words": x["words"] - x["own_words"] + x["head_words"],
            }
        )


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sequence's prefixes that end in its conversation's own turns."""
    for batch in batches:
        x = _columns(batch)
        yield _frame(
            {
                "seq": x["conv"],
                "depth": x["head"] + x["place"] + 1 - x["own_head"],
                "a": _shift(x, "a", BASES[0]),
                "b": _shift(x, "b", BASES[1]),
                "n_words": x["n_words"],
                "before": x["words"] - x["own_words"] + x["head_words"] - x["n_words"],
                "pa": _shift(x, "pa", BASES[0]),
                "pb": _shift(x, "pb", BASES[1]),
            }
        )


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def _with_heads(turns: DataFrame) -> DataFrame:
    """Per conversation: turns, sums over all, lengths of both heads and sums over them; a list of the head's states."""
    early = [
        F.max(F.when(F.col("place") == i, F.col(s))).alias(f"{s}_{i + 1}") for i in range(HEADS - 1) for s in STATE
    ]
    convs = written(
        turns.groupBy("conv").agg(
            (F.max("place") + 1).alias("turns"), *[F.max_by(s, "place").alias(s) for s in STATE], *early
        ),
        "conversation-sums",
    )
    zero = F.lit(0).cast("long")

    def states(row: str) -> Column:
        """Sums after 0, 1, ... turns; null beyond the conversation's end."""
        return F.array(
            F.struct(*[zero.alias(s) for s in STATE]),
            *[F.struct(*[F.col(f"{row}.{s}_{i}").alias(s) for s in STATE]) for i in range(1, HEADS)],
        )

    asked = head_length(F.col("c.conv"))
    joined = convs.alias("c").join(convs.alias("base"), F.col("c.conv") - F.col("c.conv") % FAMILY == F.col("base.conv"), "left")
    rows = joined.select(
        "c.conv",
        "c.turns",
        *[f"c.{s}" for s in STATE],
        F.least(asked, F.coalesce("base.turns", zero)).alias("head"),
        F.least(asked, "c.turns").alias("own_head"),
        states("c").alias("own"),
        states("base").alias("heads"),
    )
    return rows.select(
        "*",
        *[F.expr(f"own[CAST(own_head AS INT)].{s}").alias(f"own_{s}") for s in STATE],
        *[F.expr(f"heads[CAST(head AS INT)].{s}").alias(f"head_{s}") for s in STATE],
    ).drop("own")


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of equal keys that follow each other, joined by commas."""
    key, digest, done = None, None, []
    for batch in batches:
        *keys, texts = (c.to_pylist() for c in batch.columns)
        for *now, text in zip(*keys, texts, strict=True):
            if now == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256()
            digest.update(text.encode())
        if done:
            yield _rows(done)
            done = []
    if key is not None:
        yield _rows([(*key, digest.hexdigest())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*KEY, "ends_sha256"])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """Per sequence the hash of its conversations, in order of their numbers."""
    ranges = ends.groupBy(*KEY, F.shiftright("conv", RANGE_BITS).alias("range")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids")
    )
    return (
        ranges.repartition(*KEY)
        .sortWithinPartitions(*KEY, "range")
        .select(*KEY, "ids")
        .mapInArrow(_hash_lists, "depth long, a long, b long, ends_sha256 string")
    )


def _weighted_prefixes(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each conversation's end, distinct sequences with weights, and the sequences' prefixes."""
    turns = _turns(conversations)
    convs = written(_with_heads(turns), "conversation-heads")
    shifts = ["head", "own_head", *[f"{p}_{s}" for p in ("own", "head") for s in STATE]]
    ends = written(
        convs.select("conv", "turns", *STATE, *shifts).mapInArrow(
            _ends, "conv long, depth long, a long, b long, words long"
        ),
        "ends",
    )
    seqs = written(
        ends.groupBy(*KEY).agg(
            F.min("conv").alias("seq"), F.count("*").alias("weight"), F.min("words").alias("seq_words")
        ),
        "sequences",
    )
    one_each = convs.join(seqs.select(F.col("seq").alias("conv")), "conv", "left_semi")
    tails = (
        turns.join(one_each.select("conv", *shifts), "conv")
        .where("place >= own_head")
        .mapInArrow(_tails, PREFIX)
    )
    head = one_each.select(
        F.col("conv").alias("seq"),
        F.posexplode(F.slice("heads", F.lit(1), (F.col("head") + 1).cast("int"))).alias("depth", "state"),
        "heads",
    ).withColumn("up", F.expr("CASE WHEN depth > 0 THEN heads[depth - 1] ELSE heads[0] END"))
    heads = head.select(
        "seq",
        F.col("depth").cast("long").alias("depth"),
        "state.a",
        "state.b",
        (F.col("state.words") - F.col("up.words")).alias("n_words"),
        F.col("up.words").alias("before"),
        F.col("up.a").alias("pa"),
        F.col("up.b").alias("pb"),
    )
    return ends, seqs, written(tails.unionAll(heads), "prefixes")


def trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    plain = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    ends, seqs, prefixes = _weighted_prefixes(plain)
    whole = seqs.select("seq", "weight", "seq_words", F.col("depth").alias("length"))
    nodes = written(
        prefixes.join(whole, "seq")
        .groupBy(*KEY)
        .agg(
            F.min("seq").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.sum(F.col("weight") * F.col("seq_words")).alias("all_words"),
            F.min_by("seq_words", "seq").alias("owner_words"),
            *[F.min(c).alias(c) for c in ("n_words", "before", "pa", "pb")],
            F.max(F.col("depth") < F.col("length")).alias("goes_on"),
        ),
        "nodes",
    )
    leaves = written(
        seqs.join(nodes.where("goes_on").select(*KEY), KEY, "left_anti").select("seq", F.lit(1).alias("leaf")), "leaves"
    )
    owned = nodes.groupBy(F.col("conv_id").alias("seq")).agg(F.min_by("before", "depth").alias("begins"))
    share = (
        whole.join(owned, "seq", "left")
        .join(leaves, "seq", "left")
        .select(
            "seq",
            F.coalesce(F.col("seq_words") - F.col("begins"), F.lit(0)).alias("own_words"),
            F.coalesce("leaf", F.lit(0)).alias("leaf"),
        )
    )
    below = (
        prefixes.select("seq", *KEY)
        .join(written(share, "shares"), "seq")
        .groupBy(*KEY)
        .agg(
            F.sum("own_words").alias("own_words"),
            F.min_by("own_words", "seq").alias("owner_own_words"),
            F.sum("leaf").alias("n_leaves"),
        )
    )
    found = nodes.join(below, KEY).join(_end_hashes(ends), KEY, "left").select(
        *KEY,
        "conv_id",
        "n_convs",
        "n_leaves",
        "pa",
        "pb",
        # Words below over members, less words below over distinct nodes.
        (
            F.col("all_words")
            - F.col("n_convs") * F.col("before")
            - (F.col("own_words") - F.col("owner_own_words") + F.col("owner_words") - F.col("before"))
        ).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    found = written(found, "node-values")
    up = [F.col("depth") - 1, F.col("pa"), F.col("pb")]
    parent = ["up_depth", "pa", "pb"]
    children = found.where("depth > 0").groupBy(up[0].alias("up_depth"), "pa", "pb").agg(F.count("*").alias("n_children"))
    # Only nodes with children are anybody's parent.
    tops = found.select(F.col("depth").alias("up_depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), "conv_id").join(
        children, parent
    )
    tops = written(tops, "parents")
    return (
        found.withColumn("up_depth", up[0])
        .join(tops.select(*parent, F.col("conv_id").alias("parent_conv_id")), parent, "left")
        .join(tops.select(F.col("up_depth").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children"), KEY, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            F.col("n_leaves").cast("long").alias("n_leaves"),
            "saved_tokens",
            "ends_sha256",
        )
    )

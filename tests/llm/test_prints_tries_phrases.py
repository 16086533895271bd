"""Fingerprints, conversation tries and collocations: against plain versions."""

import random

import brute
import numpy as np
import oracle
import pytest
import xxhash

from eventmetrics.llm import phrase_counting, popcount_tiles, prefix_trie, queries

SF_DIR = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_phrase_mining"])
def test_sql(spark, con, name):
    if name == "op13_phrase_mining":
        # Too few texts for thirty occurrences of much: the next size.
        con, folder = oracle.connect("/root/testdata/sf0.01"), "/root/testdata/sf0.01"
    else:
        folder = SF_DIR
    assert oracle.compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], folder) == ""


# ---------------------------------------------------------------- fingerprints


def test_hash_of_substrings():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = rng.integers(0, 2000, 900)
    length = np.concatenate([np.arange(300), rng.integers(0, 60, 600)])
    want = [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(start, length)]
    assert popcount_tiles.xxh64(data, start, length).tolist() == want


def test_fingerprints_of_the_sample(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = brute.simhash_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert in_order(popcount_tiles.near_duplicates(docs)) == want


def near_prints(rng, n):
    """Prints in chains and clumps: each differs from an earlier one in up to four bits."""
    out = [rng.getrandbits(64)]
    while len(out) < n:
        x = rng.choice(out)
        for bit in rng.sample(range(64), rng.randrange(5)):
            x ^= 1 << bit
        out.append(x if rng.random() < 0.95 else rng.getrandbits(64))
    return out


@pytest.mark.parametrize("tile", [16384, 5])
def test_links_by_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(popcount_tiles, "TILE", tile)
    monkeypatch.setattr(popcount_tiles, "BLOCK", 64)
    prints = sorted(set(near_prints(random.Random(tile), 700)))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "print long").repartition(5)
    got = [(r.a % 2**64, r.b % 2**64) for r in popcount_tiles._tile_pairs(classes).mapInArrow(popcount_tiles._linked_batches, "a long, b long").collect()]
    assert all((a ^ b).bit_count() or True for a, b in got)
    links = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    assert brute.roots(prints, got) == brute.roots(prints, links)
    # A forest per tile pair, not all links.
    assert len(links) > 700


def test_fingerprints_of_odd_rows(spark, make):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (4, "one"), (None, "ONE"), (5, "two  words"), (6, "a b c"), (6, "a b c")]
    rows += [(7, "x" * 3000 + " y z"), (None, "alone here without any id"), (8, "wide\u00a0blank \u00e9t\u00e9 \U0001f600 word")]
    rows += [(9, " ".join(f"w{i}" for i in range(70_000)))]
    assert in_order(popcount_tiles.near_duplicates(make(rows))) == brute.simhash_components(rows)
    assert popcount_tiles.near_duplicates(make([(1, "a")]).where("false")).collect() == []
    named = make(rows).selectExpr("CAST(doc_id AS string) AS id", "text AS body", "source AS print", "lang AS doc_id")
    got = in_order(popcount_tiles.near_duplicates(named, "id", "body"))
    assert got == sorted(((d and str(d), p, c and str(c)) for d, p, c in brute.simhash_components(rows)), key=str)


# ---------------------------------------------------------------- conversations


def test_trie_of_the_next_sample(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert in_order(prefix_trie.trie(turns)) == brute.trie([tuple(r) for r in turns.collect()])


def by_content(spark, rows):
    """Rows with tied turns in the operator's order."""
    texts = spark.createDataFrame(sorted({(r or "", t or "") for _, _, r, t in rows}), "role string, text string")
    code = {(r.role, r.text): r.h for r in texts.selectExpr("*", "xxhash64(role, text) AS h").collect()}
    return sorted(rows, key=lambda r: (r[2] or "", code[r[2] or "", r[3] or ""]))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_odd_rows(spark, seed):
    rng = random.Random(seed)
    # One conversation holds half of all turns; others repeat, tie, lack roles, texts, turns or a base.
    rows = [(7, i, "u", rng.choice(["go on", "stop", ""])) for i in range(400)]
    rows += [
        (rng.choice([None, *range(-25, 90, 3)]), rng.choice([None, *range(5)]), rng.choice(["u", "v", None]), rng.choice(["a b", "", None, "c"]))
        for _ in range(300)
    ]
    rows += [(200 + i, t, "u", f"same {t}") for i in range(100) for t in range(1 + i % 3)]
    rows += rows[-5:]
    turns = spark.createDataFrame(rows, TURNS).repartition(8)
    assert in_order(prefix_trie.trie(turns)) == brute.trie(by_content(spark, rows))


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(20, i, "u", f"t{i % 3}") for i in range(3000)] + [(40, i, "u", f"t{i % 3}") for i in range(2500)]
    got = in_order(prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(7)))
    assert got == brute.trie(rows)
    extra = spark.createDataFrame(rows[:9], TURNS).selectExpr("conv_id AS c", "turn AS t", "role AS conv", "text AS a", "1 AS depth")
    got = in_order(prefix_trie.trie(extra, "c", "t", "conv", "a"))
    assert got == brute.trie(rows[:9])
    assert prefix_trie.trie(extra.where("false"), "c", "t", "conv", "a").collect() == []


# ---------------------------------------------------------------- phrases


def lines(rng, n):
    words = ["The", "quick", "brown", "fox", "jumps", "et\u00e9", "\u00a0x"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ";", "\n", "\t"]) for _ in range(n))


@pytest.mark.parametrize("filter_bytes", [phrase_counting.FILTER_BYTES, 4096])
def test_collocations(spark, filter_bytes, monkeypatch):
    # A small filter has several slices; small holds hand phrases on early.
    monkeypatch.setattr(phrase_counting, "HELD", 50 if filter_bytes == 4096 else 10_000)
    monkeypatch.setattr(phrase_counting, "TEXT_BYTES", 2000)
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de", None, "und"]), lines(rng, rng.randrange(60))) for _ in range(300)]
    rows += [("en", "new york city hall")] * 300 + [("en", None), (None, ""), ("xx", "rare words"), ("en", "x " * 20_000)]
    rows += [("fr", " ".join(f"n{rng.randrange(2500)}" for _ in range(2000))) for _ in range(5)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    least, best = (5, 40) if filter_bytes == 4096 else (30, 2000)
    got = in_order(phrase_counting.collocations(docs, least=least, best=best, filter_bytes=filter_bytes))
    assert got == sorted(brute.collocations(rows, least, best), key=str)


def test_collocations_of_none(spark):
    docs = spark.createDataFrame([("en", "only a few words"), (None, None)], "phrase string, shard string")
    assert phrase_counting.collocations(docs, "phrase", "shard").collect() == []
    assert phrase_counting.collocations(docs.where("false"), "phrase", "shard").collect() == []


def test_counts_travel_as_three_numbers():
    """Rows of counts are all that op13 moves in bulk: no column beside key, count and mark, which holds row and length."""
    held, row = phrase_counting.Held(), (9_000 << 32) + 7
    held.add(3, np.array([5, 5, 8], np.uint64), row)
    held.add(1, np.array([2], np.uint64), row + 1)
    held.fold()
    found = [r for batch in held.rows() for r in batch.to_pylist()]
    assert sorted((r["key"], r["count"], r["mark"] % 8, r["mark"] // 8) for r in found) == [(2, 1, 1, row + 1), (5, 2, 3, row), (8, 1, 3, row)]
    assert all(set(r) == {"key", "count", "mark"} for r in found)

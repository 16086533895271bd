"""Quality rules, exact dedup, line windows: against SQL on the sample, and odd rows."""

import hashlib
import re

import oracle
import pytest

from __spark_entry__ import oracle_sql, queries
from eventmetrics.llm import bitmaps, bloom_dedup, line_windows, quality_rules

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_line_window_dedup", "op6_exact_dedup", "op10_quality_rules"])
def test_against_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF_DIR), queries()[name], oracle_sql()[name], SF_DIR) == ""


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_odd_rows(make):
    rows = [(3, "a  b"), (1, "a b"), (2, "a\n\tb"), (5, None), (4, ""), (6, " a b"), (None, "a b"), (7, "only"), (7, "only")]
    got = sorted(bloom_dedup.report(make(rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [
        (1, 1, 4, True),
        (2, 1, 4, False),
        (3, 1, 4, False),
        (4, 4, 2, True),
        (5, 4, 2, False),
        (6, 6, 1, True),
        (7, 7, 2, True),
        (7, 7, 2, True),
        (None, 1, 4, False),
    ]
    assert got[0].text_sha256 == sha("a b") and got[3].text_sha256 == sha("")
    left = bloom_dedup.distinct_rows(make(rows))
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 6, 7]
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_exact_dedup_beyond_the_broadcast_bound(make, monkeypatch):
    rows = [(i, f"text {i % 40}") for i in range(60)]
    monkeypatch.setattr(bitmaps, "BROADCAST_BYTES", 0)
    got = bloom_dedup.report(make(rows)).collect()
    assert sorted(r.doc_id for r in got if r.kept) == list(range(40))


def lines_plain(rows):
    """{doc_id: kept text} by the definition."""
    first, gone = {}, {d: set() for d, _ in rows}
    for d, t in sorted(rows):
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            if not re.search(r"[^\x20\x09-\x0D]", "".join(key)):
                continue
            if first.setdefault(key, (d, i)) != (d, i):
                gone[d] |= {i, i + 1, i + 2}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def test_line_windows(make):
    rows = [
        (1, "a\nb\nc\nd"),
        (2, "x\nb\nc\nd\ny"),
        (3, "a\nb"),
        (4, "r\nr\nr\nr\nr"),
        (5, "\n\n\n\n"),
        (6, "a\nb\nc\nq\na\nb\nc\nd"),
        (7, ""),
    ]
    got = {r.doc_id: r for r in line_windows.dedup_lines(make(rows)).collect()}
    assert {d: r.kept_text for d, r in got.items()} == lines_plain(rows)
    assert (got[2].n_lines, got[2].n_removed, got[2].n_spans) == (5, 3, 1)
    assert (got[6].n_removed, got[6].n_spans) == (7, 2) and got[3].n_removed == 0


def test_line_windows_odd_rows(make):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd"), (2, None)]
    got = sorted((r.doc_id or 0, r.n_removed, r.n_lines) for r in line_windows.report(make(rows)).collect())
    assert got == [(0, 0, 4), (1, 3, 3), (1, 3, 3), (2, 0, 0)]


def repeat_words_plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({p + k for places in at.values() if len(places) > 1 for p in places for k in range(8)})


def test_quality_rules_odd_rows(make):
    good = "The cat and the dog of this town went to the sea with a boat that was red and it was for all of us."
    rows = [(1, good), (2, None), (3, ""), (4, " ".join(["same"] * 50)), (5, good + " " + good), (None, good), (1, good)]
    docs = make(rows).withColumnRenamed("n_chars", "measures").withColumnRenamed("lang", "m")
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        r = by_id[d]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_repeat_words == repeat_words_plain(text)
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
    assert by_id[1].kept and by_id[None].kept and not by_id[2].kept and "repeated_windows" in by_id[5].failed_rules
    kept = quality_rules.kept_rows(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]


def test_quality_rules_run_no_python(make):
    plan = quality_rules.judge(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize(
    "operator",
    [bloom_dedup.report, bloom_dedup.distinct_rows, line_windows.report, quality_rules.judge, quality_rules.kept_rows],
)
def test_empty_tables(make, operator):
    assert operator(make([])).collect() == []

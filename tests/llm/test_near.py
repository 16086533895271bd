"""Near copies, repeated passages, near passages: against plain versions."""

import hashlib
import random

import brute
import numpy as np
import pytest

from eventmetrics.llm import bbit_minhash, compact_windows, repeat_intervals, tokens
from eventmetrics.llm.components import components


@pytest.fixture(scope="module")
def sample(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def variants(rng, n, words=60, changes=2):
    """Texts that change a few words of one another."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            text[rng.randrange(words)] = f"v{rng.randrange(9)}"
        out.append(" ".join(text) + (f" end{k % 3}" if k % 2 else ""))
    return out


def check_near(make, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bbit_minhash.near_duplicates(make(rows)).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in brute.near_duplicates(rows).items()}


def test_near_duplicates_of_the_sample(make, sample):
    rows = [*sample, (10_001, None), (10_002, ""), (10_003, "two words"), (10_004, "TWO  words"), (10_005, " \n")]
    check_near(make, rows)


def test_near_duplicates_in_large_buckets(make, monkeypatch):
    monkeypatch.setattr(bbit_minhash, "SMALL_BUCKET", 3)
    monkeypatch.setattr(bbit_minhash, "BLOCK", 8)
    check_near(make, [(i + 1, t) for i, t in enumerate(variants(random.Random(5), 90))])


def test_near_duplicates_odd_rows(make):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(4, text), (4, text), (None, text), (None, "alone on its own here"), (9, text + " more")]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in bbit_minhash.near_duplicates(make(rows)).collect() if r.component_id)
    assert got == [(0, 4, False), (4, 4, True), (4, 4, True), (9, 4, False)]


@pytest.mark.parametrize("percent", [80, 60, 40])
def test_near_duplicates_at_other_thresholds(make, percent):
    rng, rows = random.Random(percent), []
    for k in range(60):
        words = [f"t{k}_{i}" for i in range(100)]
        rows.append((2 * k + 1, " ".join(words)))
        for at in rng.sample(range(5, 95), rng.randrange(1, 12)):
            words[at] = f"other{at}"
        rows.append((2 * k + 2, " ".join(words)))
    want = {d: (n, c, d == c) for d, (n, c) in brute.near_duplicates(rows, percent).items()}
    assert any(c < d for d, (_, c, _) in want.items()) and any(c == d and d % 2 == 0 for d, (_, c, _) in want.items())
    got = bbit_minhash.near_duplicates(make(rows), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_misses_follow_from_the_threshold():
    assert bbit_minhash.bands_for(85) == (24, 4) and bbit_minhash.bands_for(80) == (32, 4)
    for percent in (12, 40, 60, 80, 85, 95):
        bands, rows = bbit_minhash.bands_for(percent)
        assert bands * rows <= bbit_minhash.MINIMA and (1 - (percent / 100) ** rows) ** bands <= bbit_minhash.BAND_MISS
    assert bbit_minhash.cut_for(40) < bbit_minhash.cut_for(60) < bbit_minhash.cut_for(80) < 0.6 < bbit_minhash.cut_for(85)
    with pytest.raises(ValueError):
        bbit_minhash.bands_for(11)


def test_estimate_is_near_the_similarity(spark):
    powers, factors = tokens.Powers(), tokens.constants(bbit_minhash.MINIMA, 9)
    rng = np.random.default_rng(2)
    shared, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.sort(shared), np.sort(np.concatenate([shared, own]))]
    values, places = np.concatenate(sets), np.array([0, 800, 1800])
    low = bbit_minhash.minima(values, places, factors)
    assert abs((low[0] == low[1]).mean() - 0.8) < 0.12 and powers is not None


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)]
    want = brute.roots({x for e in links for x in e}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def passages(sample):
    rng, top = random.Random(3), 20_000
    base = sample[5][1]
    rows = [
        (top + 1, None), (top + 2, ""), (top + 3, "x" * 700), (top + 4, "ab" * 400), (top + 5, "q" * 199),
        (None, "z" * 50 + base[:600]), (top + 7, "y" * 199 + "é" * 120),
        (top + 6, sample[7][1][100:900] + "Q" + sample[9][1][:230]),
    ]
    for k in range(25):
        text = rng.choice(sample)[1]
        at = rng.randrange(max(1, len(text) - 300))
        rows.append((top + 10 + k, f"{k} {text[at : at + rng.randrange(180, 400)]} tail {k}"))
    return [*sample[:120], *rows, sample[3]]


@pytest.mark.parametrize("most", [4000, 1])
def test_repeated_passages(make, sample, monkeypatch, most):
    monkeypatch.setattr(repeat_intervals, "MOST_CONTEXTS", most)
    rows = passages(sample)
    key = lambda d, n, g, s, h: (d is None, d or 0, n, g, s, h)
    got = sorted(key(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_intervals.report(make(rows)).collect())
    plain = brute.without_repeats([t for _, t in rows])
    want = sorted(key(d, *w[:3], hashlib.sha256(w[3]).hexdigest()) for (d, _), w in zip(rows, plain, strict=True))
    assert got == want


def test_maximal_repeats_against_all_pairs(monkeypatch):
    monkeypatch.setattr(repeat_intervals, "LENGTH", 5)
    rng = random.Random(8)
    for _ in range(30):
        bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 40))) for _ in range(4)]
        suffixes, begins = repeat_intervals.enhanced_suffixes([np.frombuffer(b, np.uint8) for b in bodies])
        found = set()
        for length, places in repeat_intervals.maximal_repeats(suffixes):
            where = frozenset((int(np.searchsorted(begins, p, "right")) - 1, int(p)) for p in places.tolist())
            found.add((length, frozenset((i, p - int(begins[i])) for i, p in where)))
        assert found == maximal_plain(bodies, 5)


def test_common_prefixes_end_with_their_bodies():
    rng = random.Random(9)
    for length in range(200, 369):
        tail = bytes(rng.randrange(97, 123) for _ in range(length))
        # The bodies behind begin alike, so that a step over the ends agrees.
        bodies = [b"x" + tail, b"y" + tail, b"x" + tail[:150], b"y" + tail[:150]]
        arrays = [np.frombuffer(b, np.uint8) for b in bodies]
        suffixes, begins = repeat_intervals.enhanced_suffixes(arrays)
        ends = begins + [len(b) for b in bodies]
        rest = ends[np.searchsorted(begins, suffixes.order, "right") - 1] - suffixes.order
        assert (suffixes.common <= rest).all()
        assert sorted(repeat_intervals.covered_spans(arrays)) == [(0, 1, length + 1), (1, 1, length + 1)]


def maximal_plain(bodies, least):
    """(length, places) of strings that stand twice or more and that no byte on either side extends."""
    out = set()
    for length in range(least, max(map(len, bodies)) + 1):
        at = {}
        for i, b in enumerate(bodies):
            for p in range(len(b) - length + 1):
                at.setdefault(b[p : p + length], []).append((i, p))
        for places in at.values():
            # An end goes on in its own way, so it never extends a string.
            left = [bodies[i][p - 1] if p else ("begin", i, p) for i, p in places]
            right = [bodies[i][p + length] if p + length < len(bodies[i]) else ("end", i, p) for i, p in places]
            if len(places) > 1 and len(set(left)) > 1 and len(set(right)) > 1:
                out.add((length, frozenset(places)))
    return out


@pytest.mark.parametrize("most", [2000, 3])
def test_near_passages(make, sample, monkeypatch, most):
    monkeypatch.setattr(compact_windows, "MOST_WINDOWS", most)
    rng = random.Random(4)
    rows = [*sample[:90], (20_001, None), (20_002, ""), (20_003, "a b c")]
    long = [t for _, t in sample[:90] if len(t.split()) > 150]
    for k in range(24):
        words = rng.choice(long).split()
        at = rng.randrange(len(words) - 60)
        passage = words[at : at + 60]
        if k >= 12:
            passage[rng.randrange(60)] = f"changed{k}"
        own = [f"own{k}_{j}" for j in range(80)]
        rows.append((30_000 + k, " ".join([*own[:40], *passage, *own[40:]])))
    got = {r.doc_id: r for r in compact_windows.report(make(rows)).collect()}
    exact, near = brute.near_windows(rows)
    spans = {d: [(s.low, s.high) for s in r.spans] for d, r in got.items()}
    assert all(any(a <= i and i + 50 <= b for a, b in spans[d]) for d, i in exact)
    found = sum(any(min(b, 100) - max(a, 40) >= 45 for a, b in spans[30_000 + k]) for k in range(24))
    assert found >= (23 if most > 3 else 21)
    for d, own in spans.items():
        for a, b in own:
            assert any((d, i) in exact or near(d, i) for i in range(a, b - 49))
    assert got[20_001].n_words == 0 and got[20_003].n_spans == 0
    assert all(got[30_000 + k].component_id < 30_000 for k in range(12))


def test_near_passages_do_not_depend_on_the_size_of_groups(make, monkeypatch):
    """Passages near the threshold are found in a small and in a crowded group alike."""
    rng = random.Random(6)
    line, rows = [f"line{i}" for i in range(49)], []
    for k in range(150):
        passage = [f"p{k // 6}_{i}" for i in range(60)]
        for at in rng.sample(range(60), 2):
            passage[at] = f"changed{k}_{at}"
        rows.append((k + 1, " ".join([*[f"a{k}_{i}" for i in range(40)], *passage, *[f"b{k}_{i}" for i in range(40)]])))
    # The same few words of a line within own words are near nothing.
    rows += [(1000 + k, " ".join([*[f"a{k}_{i}" for i in range(45)], *line[:9], *[f"b{k}_{i}" for i in range(45)]])) for k in range(12)]
    found = []
    for most in (2000, 3):
        monkeypatch.setattr(compact_windows, "MOST_WINDOWS", most)
        got = compact_windows.report(make(rows)).collect()
        found.append({r.doc_id: (r.spans, r.component_id) for r in got})
    assert found[0] == found[1]
    assert sum(len(spans) for spans, _ in found[0].values()) > 20
    assert all(found[1][1000 + k] == ([], 1000 + k) for k in range(12))


def test_windows_all_near_are_left_out_without_loss(monkeypatch):
    """Rows that a pivot settles are not compared again: same spans and same sets of joined rows as pair by pair."""
    rng = np.random.default_rng(5)
    for _ in range(8):
        base = rng.integers(0, 2**32, (2, 70), dtype=np.uint32)
        rows = []
        for k in range(30):
            runs = base[k % 2].copy()
            for at in rng.integers(0, 70, k % 7):
                runs[at] = rng.integers(0, 2**32)
            low, high = sorted((int(rng.integers(0, 15)), int(rng.integers(61, 71))))
            rows.append((1, 1, k, k, 30, low, runs[low:high].tobytes(), 0, 0))
        want = compact_windows.near_of_few(rows)
        got = list(compact_windows.near_in_group(rows))

        def spans(found):
            out = {}
            for d, _, low, high, _ in found:
                a, b = out.get(d, (low, high))
                out[d] = min(a, low), max(b, high)
            return out

        def joined(found):
            label = list(range(30))
            for d, _, _, _, other in found:
                a, b = label[d], label[other]
                label = [min(a, b) if x in (a, b) else x for x in label]
            return label

        assert spans(got) == spans(want)
        assert joined(got) == joined(want)


def test_near_passages_with_swapped_sentences(make):
    rows = []
    for k in range(24):
        first, second = ([f"s{k}_{i}" for i in part] for part in (range(25), range(25, 50)))
        for n, passage in enumerate((first + second, second + first)):
            own = [f"own{k}_{n}_{i}" for i in range(60)]
            rows.append((2 * k + n + 1, " ".join([*own[:30], *passage, *own[30:]])))
    got = {r.doc_id: r for r in compact_windows.report(make(rows)).collect()}
    linked = [k for k in range(24) if got[2 * k + 2].component_id == got[2 * k + 1].component_id == 2 * k + 1]
    assert len(linked) >= 23
    for k in linked:
        for d in (2 * k + 1, 2 * k + 2):
            (span,) = got[d].spans
            assert span.low <= 30 and span.high >= 80
    # No span goes beyond the passages with a set overlap of 0.8, at any place of the other text.
    for a, b in [(2 * k + 1, 2 * k + 2) for k in linked]:
        runs = {d: [tuple(t.split()[i : i + 5]) for i in range(106)] for d, t in rows if d in (a, b)}
        plain = [set(runs[b][i : i + 46]) for i in range(61)]
        near = [i for i in range(61) if any(9 * len(set(runs[a][i : i + 46]) & q) >= 4 * 92 for q in plain)]
        # The outermost passages meet their partner by chance, as any passage at the threshold does.
        assert all(near[0] <= s.low and s.high <= near[-1] + 50 for s in got[a].spans)


def test_shared_runs_against_sets():
    rng = np.random.default_rng(3)
    for kinds in (12, 60, 4000):
        text = rng.integers(0, kinds, 120).astype(np.uint32)
        other = rng.permutation(text)
        for a, b, apart in ((text[:91], other[:80], None), (text[:70], text[9:99], 9), (text[20:90], text[:91], -20)):
            got = compact_windows.shared_runs(a, b, apart)
            for p in range(0, len(a) - 45, 3):
                for q in range(len(b) - 45):
                    at = {}
                    for y in range(q, q + 46):
                        at.setdefault(b[y], set()).add(y + (apart or 0))
                    want = {
                        a[x] for x in range(p, p + 46)
                        if a[x] in at and (apart is None or at[a[x]] - {x})
                    }
                    assert got[p, q] == len(want)
            assert compact_windows.different(a).tolist() == [len(set(a[p : p + 46].tolist())) for p in range(len(a) - 45)]


def test_overlap_makes_no_passage_near(make):
    words = [f"w{i}" for i in range(100)]
    words[40:45] = words[52:57] = [f"twice{i}" for i in range(5)]
    (row,) = compact_windows.report(make([(1, " ".join(words))])).collect()
    assert row.n_spans == 0


@pytest.mark.parametrize("operator", [bbit_minhash.near_duplicates, bbit_minhash.kept_rows, repeat_intervals.report, compact_windows.report])
def test_empty_tables(make, operator):
    assert operator(make([])).collect() == []


def repeated_word_rows(rng, texts):
    """Windows around one run of texts that say one word over and over, then another: all splits of each text."""
    word, rows = int(rng.integers(1, 1 << 31)), []
    for doc in range(texts):
        turn, other = rng.integers(1, 1 << 31, 4), int(rng.integers(1, 1 << 31))
        runs = np.array([word] * 50 + turn.tolist() + [other] * 50, np.uint32)
        for low in range(8, 50):
            rows.append((1, 1, doc, doc, low, low, runs[low : low + compact_windows.WIDTH].tobytes(), 0, 0))
    return rows


def test_windows_that_share_one_word_are_not_compared(monkeypatch):
    """Few of them are near, and the others must go without being held against each other."""
    rng = np.random.default_rng(12)
    rows = repeated_word_rows(rng, 3)
    body = rng.integers(1, 1 << 31, 60).astype(np.uint32)
    rows += [(1, 1, 50 + k, 50 + k, 20, k, body[k : k + 50].tobytes(), 0, 0) for k in range(8)]
    met = []
    for name in ("promising", "near_of_few"):
        call = getattr(compact_windows, name)
        monkeypatch.setattr(compact_windows, name, lambda some, call=call: met.append(len(some)) or call(some))
    got = {}
    for doc, _, low, high, _ in compact_windows.near_in_group(rows):
        got.setdefault(doc, set()).update(range(low, high))
    want = {}
    for i, (low, high) in plain_ends(rows).items():
        want.setdefault(rows[i][2], set()).update(range(low, high))
    assert got == want and met and max(met) < 50


def test_windows_left_out_of_crowded_groups(make, monkeypatch):
    """Texts of repeated words in a crowded group: the same spans as in one group, and nearly no window is left."""
    rng, rows = random.Random(9), []
    for k in range(12):
        rows.append((k + 1, " ".join(["same"] * 70 + [f"other{k}"] * 70)))
    passage = [f"p{i}" for i in range(60)]
    rows += [(100 + k, " ".join([*(f"a{k}_{i}" for i in range(rng.randrange(30, 50))), *passage])) for k in range(4)]
    found, left, hopeful = [], [], compact_windows._hopeful

    def counted(texts):
        out = hopeful(texts)
        left.append(out.count())
        return out

    monkeypatch.setattr(compact_windows, "_hopeful", counted)
    for most in (2000, 20):
        monkeypatch.setattr(compact_windows, "MOST_WINDOWS", most)
        found.append({r.doc_id: (r.spans, r.component_id) for r in compact_windows.report(make(rows)).collect()})
    assert found[0] == found[1]
    assert len(left) == 1 and left[0] < 40


def test_words_do_not_depend_on_pieces():
    import pyarrow as pa

    texts = ["The cat  sat", "", "ON\tthe\nmat " * 30, "x" * 300, " end"]
    data, offsets = tokens.text_bytes(pa.array(texts))
    want = tokens.split_words(data, offsets, tokens.Powers())
    for piece in (1, 7, 64):
        got = tokens.split_words(data, offsets, tokens.Powers(), piece)
        assert all((a == b).all() for a, b in zip(want, got, strict=True))
    assert np.diff(want[3]).tolist() == [len(brute.lower_words(t)) for t in texts]


def plain_ends(rows):
    """Row number -> first and last near passage, from the sets of all passages of all pairs."""
    bodies = [np.frombuffer(r[6], np.uint32).tolist() for r in rows]
    width, ends = compact_windows.WIDTH, {}
    for i, a in enumerate(bodies):
        for j, b in enumerate(bodies):
            if i == j:
                continue
            one_text = rows[i][2:4] == rows[j][2:4]
            for p in range(len(a) - width + 1):
                own = {rows[i][5] + p + k: run for k, run in enumerate(a[p : p + width])}
                for q in range(len(b) - width + 1):
                    other = {rows[j][5] + q + k: run for k, run in enumerate(b[q : q + width])}
                    x, y = set(own.values()), set(other.values())
                    places = {}
                    for place, run in other.items():
                        places.setdefault(run, set()).add(place)
                    met = {r for at, r in own.items() if places.get(r, set()) - ({at} if one_text else set())}
                    if 9 * len(met) >= 4 * (len(x) + len(y)):
                        ends.setdefault(i, []).append(p)
    return {i: (rows[i][5] + min(v), rows[i][5] + max(v) + width) for i, v in ends.items()}


def window_rows(rng, m):
    """Windows around one run: of near copies, of repeated words, of one text twice, of unlike texts."""
    core, rows = rng.integers(1, 1 << 31, 91).astype(np.uint32), []
    for k in range(m):
        kind, body = int(rng.integers(0, 5)), core.copy()
        if kind == 1:
            body[rng.integers(0, 91, 4)] = rng.integers(1, 1 << 31, 4)
        elif kind == 2:
            body[:] = rng.choice(core[:3], 1)
            body[60:64] = rng.integers(1, 1 << 31, 4)
            body[64:] = core[5]
        elif kind == 3:
            body = np.concatenate([core[30:45], core[:30], core[45:]])
        elif kind == 4:
            body = rng.integers(1, 1 << 31, 91).astype(np.uint32)
        body[45] = core[45]
        low = int(rng.integers(10, 46))
        high = int(rng.integers(low + 45, 91))
        at = int(rng.integers(0, 60))
        doc = int(rng.integers(0, m)) if kind == 2 else 100 + k
        rows.append((1, 1, doc, doc, at + 45, at + low, body[low : high + 1].tobytes(), 0, 0))
    return rows


@pytest.mark.parametrize(("few", "at_once"), [(6, 256), (0, 256), (0, 0), (99, 0)])
def test_groups_of_windows_against_sets(monkeypatch, few, at_once):
    monkeypatch.setattr(compact_windows, "FEW", few)
    monkeypatch.setattr(compact_windows, "AT_ONCE", at_once)
    monkeypatch.setattr(compact_windows, "CELLS", 3000)
    rng = np.random.default_rng(8)
    for m in (2, 2, 3, 5, 9, 14):
        rows = window_rows(rng, m)
        want, got = {}, {}
        for i, (low, high) in plain_ends(rows).items():
            want.setdefault(rows[i][2], set()).update(range(low, high))
        for doc, _, low, high, _ in compact_windows.near_in_group(rows):
            got.setdefault(doc, set()).update(range(low, high))
        assert got == want


def group_batch(groups):
    """Rows of groups of windows as the tasks get them."""
    import pyarrow as pa

    names = [f.split()[0] for f in compact_windows.BODIES.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] + [pa.int32()] * 2
    rows = [(k, *row[1:]) for k, group in enumerate(groups) for row in group]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def roots_of(links):
    links = [(a, b) for a, b in links if a is not None and b is not None]
    return brute.roots({x for e in links for x in e}, links)


def plain_links(rows):
    """Pairs of documents with a near pair of windows."""
    out = set()
    for i in range(len(rows)):
        for j in range(i):
            if plain_ends([rows[i], rows[j]]):
                out.add((rows[i][2], rows[j][2]))
    return out


@pytest.mark.parametrize("together", [1, 20, 3000])
def test_many_groups_at_once_against_sets(monkeypatch, together):
    monkeypatch.setattr(compact_windows, "TOGETHER", together)
    monkeypatch.setattr(compact_windows, "EARLY", 1)
    rng = np.random.default_rng(together)
    groups = [window_rows(rng, m) for m in (2, 1, 3, 9, 2, 12)]
    # Each group has documents of its own; some have no id.
    for k, rows in enumerate(groups):
        groups[k] = [(r[0], 1 + n % 3, None if n % 5 == 4 else r[2] + 1000 * k, r[3] + 1000 * k, *r[4:]) for n, r in enumerate(rows)]
    whole = group_batch(groups)
    found = []
    for out in compact_windows._group_batches(iter([whole.slice(0, 7), whole.slice(7)])):
        found.extend(zip(*(c.to_pylist() for c in out.columns), strict=True))
    want, links = {}, set()
    for rows in groups:
        for i, (low, high) in plain_ends(rows).items():
            want.setdefault(rows[i][2:4], set()).update(range(low, high))
        links |= plain_links(rows)
    got = {}
    for doc, version, low, high, _ in found:
        got.setdefault((doc, version), set()).update(range(low, high))
    assert got == want and want
    linked = {d: c for d, c in roots_of({(d, o) for d, _, _, _, o in found}).items() if d != c}
    assert linked == {d: c for d, c in roots_of(links).items() if d != c}


def test_windows_of_one_set_of_runs_stand_for_each_other(monkeypatch):
    """Texts that say a word over and over, then another, in all splits: few windows have a turn, and none is lost."""
    rng = np.random.default_rng(4)
    word, turn, other = (rng.integers(1, 1 << 31, n).astype(np.uint32) for n in (1, 4, 1))
    rows, width = [], compact_windows.WIDTH
    for doc in range(40):
        runs = np.concatenate([np.repeat(word, 50), turn, np.repeat(other, 50)])
        for low in range(4 + doc % 3, 50, 3):
            rows.append((1, 1, doc, doc, low, low, runs[low : low + width].tobytes(), 0, 0))
    sizes, call = [], compact_windows.compared
    monkeypatch.setattr(compact_windows, "compared", lambda w, *more: sizes.append(len(w.sizes)) or call(w, *more))
    (out,) = compact_windows._group_batches(iter([group_batch([rows])]))
    assert sum(sizes) < 40 < len(rows)
    got = {(d, low, high) for d, low, high in zip(*(out.column(k).to_pylist() for k in (0, 2, 3)), strict=True)}
    assert got == {(r[2], r[5], r[5] + width) for r in rows}
    assert set(roots_of(set(zip(out.column(0).to_pylist(), out.column(4).to_pylist(), strict=True))).values()) == {0}


def test_a_filter_that_is_too_full_loses_nothing(make, monkeypatch):
    """Beyond the size that may be sent to all tasks a filter is fuller, not left out."""
    rng, rows = random.Random(3), []
    passage = [f"p{i}" for i in range(60)]
    for k in range(60):
        own = [f"own{k}_{i}" for i in range(400)]
        at = rng.randrange(400)
        rows.append((k + 1, " ".join([*own[:at], *(passage if k % 3 == 0 else []), *own[at:]])))
    want = compact_windows.report(make(rows)).collect()
    filters, call = [], compact_windows._members
    monkeypatch.setattr(compact_windows, "_members", lambda keys: filters.append(call(keys)) or filters[-1])
    monkeypatch.setattr(compact_windows, "BROADCAST_BYTES", 8)
    assert sorted(map(str, compact_windows.report(make(rows)).collect())) == sorted(map(str, want))
    assert filters and all(f is not None and f.bits == 64 for f in filters)
    assert sum(r.n_spans for r in want) >= 20


@pytest.mark.parametrize("many", [0, 1000])
def test_later_turns_against_sets(monkeypatch, many):
    """Windows that meet only those with a rare run, and single passages: the same as all pairs."""
    monkeypatch.setattr(compact_windows, "EARLY", 0)
    monkeypatch.setattr(compact_windows, "MANY", many)
    rng = np.random.default_rng(40 + many)
    line = rng.integers(1, 1 << 31, 56).astype(np.uint32)
    for repeat in (False, True):
        rows = []
        for k in range(14):
            own, body = rng.integers(1, 1 << 31, 20).astype(np.uint32), line.copy()
            if k % 3 == 1:
                # A word more: what is behind stands a place later.
                body = np.insert(body, 20 + k, rng.integers(1, 1 << 31, 5).astype(np.uint32))[:56]
            if k % 4 == 2:
                body[40 + k % 7 : 45 + k % 7] = rng.integers(1, 1 << 31, 5)
            if repeat and k % 5 == 3:
                own[12] = body[30]
            runs = np.concatenate([own[: 9 + k % 5], body])
            rows.append((1, 1, k, k, 45, 0, runs.tobytes(), 0, 0))
        want = {rows[i][2]: set(range(low, high)) for i, (low, high) in plain_ends(rows).items()}
        (out,) = compact_windows._group_batches(iter([group_batch([rows])]))
        got = {d: set(range(a, b)) for d, a, b in zip(*(out.column(k).to_pylist() for k in (0, 2, 3)), strict=True)}
        assert got == want and want
        linked = set(zip(out.column(0).to_pylist(), out.column(4).to_pylist(), strict=True))
        found = {d: c for d, c in roots_of(linked).items() if d != c}
        assert found == {d: c for d, c in roots_of(plain_links(rows)).items() if d != c}

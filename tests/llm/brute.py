"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re
import zlib

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def shingle_set(text, width=5):
    words = lower_words(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(rows, percent=85):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows, by an inverted index over full sets."""
    sets = {d: shingle_set(t) for d, t in rows}
    by_set = {}
    for d, s in sets.items():
        by_set.setdefault(s, []).append(d)
    links = [(min(ds), d) for s, ds in by_set.items() if s for d in ds]
    index, reps = {}, {min(ds): s for s, ds in by_set.items() if s}
    for d, s in sorted(reps.items()):
        shared = {}
        for x in s:
            for other in index.get(x, ()):
                shared[other] = shared.get(other, 0) + 1
            index.setdefault(x, []).append(d)
        links += [(o, d) for o, n in shared.items() if 100 * n >= percent * (len(s) + len(reps[o]) - n)]
    label = roots(sets, links)
    return {d: (len(s), label[d]) for d, s in sets.items()}


def targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """{source: target} of {source: words}; sources by code point, None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, goal, out = set(order), share * sum(sizes.values()), {}
    while open_:
        level = goal / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in over or open_:
            out[s] = most * sizes[s] if over else level * weight[s]
            goal -= out[s] if over else 0
        open_ -= over or open_
    return out


def without_repeats(texts, length=200):
    """[(n_bytes, n_removed, n_spans, kept)] of texts, from a dictionary of all strings of that length."""
    blobs = [(t or "").encode() for t in texts]
    seen = {}
    for b in blobs:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def near_windows(rows, width=46, percent=80):
    """(exact, near): for each (doc_id, text) the starts of runs-of-five windows that stand elsewhere too, word for
    word, or as a set of that similarity, at any place of any text."""
    runs = {}
    for d, t in rows:
        w = lower_words(t)
        runs[d] = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, index = {}, {}
    for d, r in runs.items():
        for i in range(len(r) - width + 1):
            seen.setdefault(tuple(r[i : i + width]), []).append((d, i))
        for i, x in enumerate(r):
            index.setdefault(x, []).append((d, i))
    exact = {(d, i) for places in seen.values() if len(places) > 1 for d, i in places}

    def near(d, i):
        own = set(runs[d][i : i + width])
        starts = {(e, j - k) for k in range(width) for e, j in index[runs[d][i + k]]}
        for e, j in starts:
            for s in range(max(0, j - 3), j + 4):
                if (e, s) != (d, i) and s + width <= len(runs[e]) and abs(s - i) * (e == d) != 0 or (e != d and s + width <= len(runs[e])):
                    other = set(runs[e][s : s + width])
                    shared = len(own & other)
                    if 100 * shared >= percent * (len(own) + len(other) - shared) and (e != d or abs(s - i) > 2):
                        return True
        return False

    return exact, near


def fingerprint(text):
    words = lower_words(text)
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash_components(rows):
    """[(doc_id, fingerprint, component)] of (doc_id, text) rows, each print with each."""
    prints = [fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= 3]
    label = roots(nodes, links)
    lowest = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            lowest[label[p]] = min(d, lowest.get(label[p], d))
    return sorted(((d, f"{p:016x}", lowest.get(label[p])) for (d, _), p in zip(rows, prints)), key=str)


def trie(rows):
    """Nodes of (conv_id, turn, role, text) rows, which come in the order of tied turns."""
    own = collections.defaultdict(list)
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members, ends, children, out = (collections.defaultdict(list) for _ in range(4))
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in children[p]]
        words = len(WORD.findall(p[-1][1].encode())) if p else 0
        out[p] = (
            min(members[p]),
            len(p),
            min(members[p[:-1]]) if p else None,
            len(members[p]),
            len(below),
            sum(b[5] for b in below) or 1,
            (len(members[p]) - 1) * words + sum(b[6] for b in below),
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def collocations(rows, least=30, best=2000):
    """Ranked phrases of (lang, text) rows, from a dictionary of all phrases."""
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().translate(LOWER)):
            words = re.findall(rb"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, w), a in found.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(longer[lang, w[i : i + n]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if longer[lang, w] == 0 or 100 * longer[lang, w] < 80 * a:
            sides = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(sides))
            out[lang].append((-score, -a, b" ".join(w), l, r))
    return sorted(
        (lang, i, p.decode(), -a, l, r, total[lang], -s)
        for lang, some in out.items()
        for i, (s, a, p, l, r) in enumerate(sorted(some)[:best], 1)
    )

"""Jaccard join and substring removal against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from phrasecast.llm import jaccard_join, substring

from .conftest import prose


def brute_components(rows):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same = sets[a][0] is not None and sets[a][0] == sets[b][0] and x and y
            if x and y and (same or 100 * len(x & y) >= 80 * len(x | y)):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for a, (i, s) in enumerate(sets):
        if i is not None and s:
            ids[find(a)].append(i)
    return Counter(
        (i, len(s), (min(ids[find(a)]) if ids[find(a)] else None) if s else i) for a, (i, s) in enumerate(sets)
    )


def near_copies(seed, groups=12, size=9):
    r = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        base = prose(seed * 100 + g, r.choice([4, 6, 9, 14, 30, 80, 200]))
        for _ in range(r.randint(1, size)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(["alpha", "beta", "gamma"])
            if r.random() < 0.2:
                w = w + prose(n, 3)
            n += 1
            rows.append((n, " ".join(w).title() if r.random() < 0.2 else " ".join(w), "en", "s"))
    boiler = prose(7, 60)
    rows += [(1000 + k, " ".join(boiler + prose(2000 + k, 20)), "en", "s") for k in range(25)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components(make_docs, seed):
    rows = near_copies(seed)
    got = Counter(tuple(r) for r in jaccard_join.join(make_docs(rows)).collect())
    assert got == brute_components(rows)


def test_light_sets(make_docs, monkeypatch):
    """The subset side by itself: every set is light."""
    monkeypatch.setattr(jaccard_join, "BORDERS", (400,))
    rows = near_copies(3)
    got = Counter(tuple(r) for r in jaccard_join.join(make_docs(rows)).collect())
    assert got == brute_components(rows)


def test_border_inside(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BORDERS", (12,))
    rows = near_copies(4)
    assert Counter(tuple(r) for r in jaccard_join.join(make_docs(rows)).collect()) == brute_components(rows)


def test_awkward_components(make_docs, awkward):
    got = Counter(tuple(r) for r in jaccard_join.join(make_docs(awkward)).collect())
    assert got == brute_components(awkward)
    assert jaccard_join.join(make_docs([])).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    found = jaccard_join.components(links).collect()
    assert {r.component for r in found} == {0}
    assert sorted(r.node for r in found) == list(range(201))


def test_parity_never_hides_a_link():
    r = np.random.default_rng(0)
    for _ in range(200):
        x = np.unique(r.integers(0, 1 << 63, 60).astype(np.uint64))
        y = np.unique(np.concatenate([x[: r.integers(40, len(x))], r.integers(0, 1 << 63, 5).astype(np.uint64)]))
        bits = np.bitwise_count((jaccard_join.parity(x) ^ jaccard_join.parity(y)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(x, y))


def brute_strip(rows, width=20):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, t, *_ in order:
        w = (t or "").encode().split()
        for j in range(len(w) - width + 1):
            place = ((i is None, i or 0), j)
            g = tuple(w[j : j + width])
            first[g] = min(first.get(g, place), place)
    gone = defaultdict(set)
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < ((i is None, i or 0), j):
                gone[i] |= set(range(j, j + width))
    out = Counter()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        kept = [x for j, x in enumerate(w) if j not in gone[i]]
        out[i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


def passages(seed):
    r = random.Random(seed)
    shared = [prose(seed * 50 + k, r.randint(18, 90)) for k in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(1, 4)):
            w += r.choice(shared)[r.randint(0, 4) :] if r.random() < 0.5 else prose(seed * 1000 + i * 7 + len(w), r.randint(5, 60))
        rows.append((i, "  ".join(w), "en", "s"))
    return rows + [(100, "a b " * 60, "en", "s"), (101, "x " * 30, "en", "s"), (102, "a b " * 60, "en", "s")]


@pytest.mark.parametrize("seed", [1, 2])
def test_strip(make_docs, seed):
    rows = passages(seed)
    assert Counter(tuple(r) for r in substring.report(make_docs(rows)).collect()) == brute_strip(rows)


def test_strip_awkward(make_docs, awkward):
    assert Counter(tuple(r) for r in substring.report(make_docs(awkward)).collect()) == brute_strip(awkward)
    assert substring.report(make_docs([])).count() == 0


def test_large_shard_is_cut(spark, make_docs):
    """Shards above the bound are divided by the hash of their windows; the result is the same."""
    docs = make_docs(passages(3)).select("doc_id", "text")

    def covered(most):
        runs = substring.repeated_windows(docs, most_words=most).collect()
        return {(r.doc, r.at + k) for r in runs for k in range(r.n)}

    assert covered(40) == covered(300_000)


def test_wavelet_and_index():
    r = np.random.default_rng(1)
    text = np.append(r.integers(1, 9, 400), 0).astype(np.int64)
    tree = substring.Wavelet(text, 9)
    for s in range(9):
        at = r.integers(0, len(text) + 1, 50)
        assert (tree.rank(np.full(50, s), at) == [(text[:i] == s).sum() for i in at]).all()
    index = substring.FMIndex(text, 6)
    words = text[100:106]
    low, high = np.array([0]), np.array([len(text)])
    for w in words[::-1]:
        low, high = index.extend(np.array([w]), low, high)
    found = sorted(index.suffixes[low[0] : high[0]])
    assert found == [i for i in range(len(text) - 5) if (text[i : i + 6] == words).all()]


def test_rarer_shingles_come_first(make_docs, spark):
    """A passage of 16 documents is no key of documents that have rarer shingles, so they do not meet."""
    passage = prose(5, 25)
    texts = [" ".join([f"w{k}x{j}" for j in range(30)] + passage) for k in range(16)]
    jaccard_join.ship(spark)
    docs = make_docs([(k, t, "en", "s") for k, t in enumerate(texts)]).selectExpr("doc_id AS doc", "text")
    plan = jaccard_join.choose_plan(jaccard_join.materialize(jaccard_join._measure(docs), "sets"))
    keys = [set(jaccard_join.keys_of(jaccard_join.shingles(t, jaccard_join.WordHashes()), plan)[0].tolist()) for t in texts]
    assert all(not a & b for i, a in enumerate(keys) for b in keys[:i])


def test_room_bounds_the_intersection():
    """The rooms of the first key that two sets share are no less than their intersection."""
    r = np.random.default_rng(2)
    rank = r.integers(0, 40, jaccard_join.CELLS).astype(np.uint8)
    plan = jaccard_join.Plan(rank, np.zeros(256, np.int64), 0)
    for _ in range(200):
        x = np.unique(r.integers(0, 1 << 63, 60).astype(np.uint64))
        y = np.unique(np.concatenate([x[: r.integers(50, len(x))], r.integers(0, 1 << 63, 4).astype(np.uint64)]))
        (kx, _, rx), (ky, _, ry) = jaccard_join.keys_of(x, plan), jaccard_join.keys_of(y, plan)
        shared, i, j = np.intersect1d(kx, ky, return_indices=True)
        both = len(np.intersect1d(x, y))
        if 5 * both >= 4 * (len(x) + len(y) - both):
            assert len(shared) and np.minimum(rx[i], ry[j]).max() >= both

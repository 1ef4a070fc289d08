"""Runs of words against definitions tried out by brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from phrasecast.llm import runs
from phrasecast.llm.runs import Extensions, lyndon_lengths, runs_of


def lyndon_by_definition(s):
    """Longest prefix of each suffix that is smaller than all its own proper suffixes."""
    out = []
    for i in range(len(s)):
        best = 1
        for j in range(i + 1, len(s) + 1):
            w = s[i:j]
            if all(w < w[k:] for k in range(1, len(w))):
                best = j - i
        out.append(best)
    return out


def runs_by_definition(s, min_words=6, min_exponent=4):
    n, found = len(s), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_words, min_exponent * q):
                w = s[i : i + length]
                if all(any(w[k] != w[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def strings():
    pick = random.Random(5)
    yield from ([0] * 7, [1, 0] * 9, [], [3])
    for _ in range(150):
        yield [pick.randrange(pick.choice([1, 2, 3, 6])) for _ in range(pick.randrange(1, 40))]
    a, b = [0], [0, 1]
    while len(b) < 60:
        a, b = b, b + a
    yield b
    for _ in range(40):
        root = [pick.randrange(3) for _ in range(pick.randrange(1, 6))]
        yield [9] * pick.randrange(3) + root * pick.randrange(2, 9) + root[: pick.randrange(len(root))] + [pick.randrange(4) for _ in range(4)]


def test_lyndon_arrays_of_both_orders():
    for s in strings():
        symbols = np.array(s, np.int64) + 1
        assert lyndon_lengths(symbols).tolist() == lyndon_by_definition(s)
        assert lyndon_lengths(11 - symbols).tolist() == lyndon_by_definition([-x for x in s])


def test_lyndon_words_end_at_closing_symbols():
    parts = [s for s in strings() if s][:40]
    joined = np.array([x for s in parts for x in [*(v + 1 for v in s), 0]], np.int64)
    want = [x for s in parts for x in lyndon_by_definition(s)]
    assert lyndon_lengths(joined)[joined > 0].tolist() == want


def test_extensions():
    s = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2, 1, 2, 4])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12)))
    i, j = i[i < j], j[i < j]
    e = Extensions(s, 12)
    right = [next((k for k in range(12) if b + k >= 12 or s[a + k] != s[b + k])) for a, b in zip(i, j)]
    left = [next((k for k in range(13) if a - k <= 0 or s[a - k - 1] != s[b - k - 1])) for a, b in zip(i, j)]
    assert e.right(i, j).tolist() == right and e.left(i, j).tolist() == left


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (3, 3)])
def test_runs_of_many_texts_at_once(limits):
    texts = list(strings())
    first = np.cumsum([0, *map(len, texts)])
    ids = np.array([x for s in texts for x in s], np.int64)
    which = np.repeat(np.arange(len(texts)), [len(s) for s in texts])
    want = [(int(first[k]) + a, n, q) for k, s in enumerate(texts) for a, n, q in runs_by_definition(s, *limits)]
    assert [tuple(r) for r in runs_of(ids, which, *limits).tolist()] == want


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = runs_by_definition(w)
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    return (
        doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{a},{size},{q}\n" for a, size, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


def test_report_equals_brute_force(spark):
    pick = random.Random(11)
    rows = [(None, "a b"), (1, None), (2, ""), (3, " \t\n"), (4, "é " * 9), (4, "é " * 9), (5, "x" * 100_000), (6, "a b " * 5000)]
    rows += [(k, " ".join(pick.choice("abcdefgh" if k % 3 else "ab") for _ in range(pick.randrange(1, 60)))) for k in range(10, 240)]
    docs = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id bigint, text string, runs int, collapsed string").repartition(3)
    got = [tuple(r) for r in runs.report(docs).collect()]
    short = [(a, b) for a, b in rows if a != 6]
    assert sorted((r for r in got if r[0] != 6), key=str) == sorted((expected(a, b) for a, b in short), key=str)
    assert [r[1:6] for r in got if r[0] == 6] == [(1, 0, 10_000, 2, 5_000_000)]


def test_collapse_keeps_one_period(spark):
    rows = [(1, "go go go go go go home"), (2, "plain words only"), (3, "x y z x y z x y z x y z x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in runs.collapse(docs).collect()}
    assert out[1]["collapsed"] == "go home" and out[1]["n_words"] == 7
    assert out[2]["runs"] == [] and out[2]["strongest"] is None
    assert [tuple(r) for r in out[3]["runs"]] == [(0, 13, 3)] and out[3]["collapsed"] == "x y z"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert runs.report(docs).collect() == []
    with pytest.raises(ValueError):
        runs.collapse(docs, min_exponent=1)

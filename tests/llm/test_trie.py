"""The prefix trie against nested dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from phrasecast.llm import trie
from phrasecast.llm.trie import _decompose


def expected(rows):
    """rows: (conv_id, turn, role, text), at most one per turn."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        source = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(source, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        todo, out = [node], []
        while todo:
            v = todo.pop()
            out.append(v)
            todo += children[v]
        return out

    n_words = lambda s: len(s.encode().split())
    out = []
    for node, convs in members.items():
        sub = below(node)
        saved = sum((len(members[v]) - 1) * n_words(v[-1][1]) for v in sub if v)
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
            sum(not children[v] for v in sub), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made(pick):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 0, "user", "x y"), (1000, 0, "user", ""), (-5, 1, "user", "hi"), (-25, 0, "bot", "hi all")]
    for c in range(0, 160):
        if c % 13 == 5:
            continue
        for turn in range(pick.randrange(0, 9)):
            rows.append((c, turn * 3, pick.choice(["user", "bot", None]), pick.choice(["hi", "hi there you", "", None, "so  it goes"])))
    rows += [(c, 0, "user", "one and the same") for c in range(200, 260)]
    rows += [(400, turn, "bot", f"turn {turn % 7}") for turn in range(300)]
    rows += [(401, turn, "bot", f"turn {turn % 7}") for turn in range(250)] + [(401, 260, "bot", "other end")]
    return rows


def key_of(r):
    return (r[0], r[1])


@pytest.mark.parametrize(("small", "broadcast"), [(4096, 50_000), (12, 50_000), (40, 0)])
def test_report_equals_nested_dictionaries(spark, monkeypatch, small, broadcast):
    rows = list({key_of(r): r for r in made(random.Random(4))}.values())
    monkeypatch.setattr(trie, "SMALL", small)
    monkeypatch.setattr(trie, "BROADCAST_ROWS", broadcast)
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn int, role string, text string, key string").repartition(3)
    assert sorted((tuple(r) for r in trie.report(table).collect()), key=str) == expected(rows)


def test_blocks_of_ids_and_repeated_rows(spark, monkeypatch):
    rows = [(c, 0, "u", "same") for c in range(3, 9000, 20) if zlib.crc32(str(c).encode()) % 4 == 0]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    assert sorted((tuple(r) for r in trie.report(table).collect()), key=str) == expected(rows)
    twice = spark.createDataFrame([(4, 1, "u", "a"), (4, 1, "u", "a")], "conv_id bigint, turn int, role string, text string")
    placed = trie.placed(twice)
    assert sorted(r["place"] for r in placed.collect()) == [0, 1]
    assert {(r["depth"], r["n_convs"]) for r in trie.trie(placed, trie.conversations_of(placed)).collect()} == {(0, 1), (1, 1), (2, 1)}


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert trie.report(table).collect() == []


def test_decomposition_of_one_tree():
    pick = random.Random(9)
    for shape in (lambda i: i - 1, lambda i: 0, lambda i: pick.randrange(i), lambda i: max(0, i - pick.randrange(1, 4))):
        for n in (1, 2, 3, 10, 200):
            parents = [-1] + [shape(i) for i in range(1, n)]
            depth = [0] * n
            for i in range(1, n):
                depth[i] = depth[parents[i]] + 1
            order = sorted(range(n), key=lambda i: depth[i])
            at = {v: k for k, v in enumerate(order)}
            ups = [at[parents[v]] if v else -1 for v in order]
            own = [pick.randrange(5) for _ in range(n)]
            want = list(own)
            for k in range(n - 1, 0, -1):
                want[ups[k]] += want[k]
            got = [list(own), [1] * n]
            _decompose(ups, [pick.randrange(1, 4) for _ in range(n)], got)
            assert got[0] == want and got[1][0] == n

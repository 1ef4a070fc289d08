"""Canonical addresses, connected groups and the search for many phrases."""

import random
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from phrasecast.functions import groups
from phrasecast.functions.groups import connected_groups
from phrasecast.functions.phrases import vocabulary
from phrasecast.functions.urls import canonical_url, headline_form
from phrasecast.operators import dedupe, label, search


@pytest.mark.parametrize(("url", "want"), [
    ("https://www.News.example.com:443/a/b/?utm_source=x&b=2&a=1#top", "news.example.com/a/b?a=1&b=2"),
    ("HTTP://news.example.com/a/b?b=2&a=1&fbclid=9", "news.example.com/a/b?a=1&b=2"),
    ("//news.example.com//a//b?", "news.example.com/a/b"),
    ("https://me:pw@example.com:8080/", "example.com:8080"),
    ("https://example.com/A?q=Utm_x", "example.com/A?q=Utm_x"),
    (" not an address ", "not an address"), ("", None), ("  ", None), (None, None),
])
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(canonical_url(F.col("u"))).first()[0] == want


def test_headline_form(spark):
    df = spark.createDataFrame([(" Fed's  “Big” move! ",), ("—",), (None,)], "h string")
    assert [r[0] for r in df.select(headline_form(F.col("h"))).collect()] == ["fed s big move", None, None]


def groups_by_search(pairs):
    items, keys = defaultdict(set), defaultdict(set)
    for item, key in pairs:
        if item is not None:
            items[item].add(key)
            if key is not None:
                keys[key].add(item)
    out = {}
    for start in sorted(items):
        if start in out:
            continue
        todo = [start]
        while todo:
            v = todo.pop()
            if v not in out:
                out[v] = start
                todo += [u for k in items[v] if k is not None for u in keys[k]]
    return out


@pytest.mark.parametrize("limit", [100_000, 40])
def test_connected_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(groups, "BROADCAST_ROWS", limit)
    pick = random.Random(8)
    pairs = [(pick.randrange(300), f"k{pick.randrange(260)}") for _ in range(330)]
    pairs += [(1000 + i, f"c{(i + d) // 1}") for i in range(80) for d in (0, 1)]  # one long chain
    order = list(range(60))
    pick.shuffle(order)
    pairs += [(2000 + order[i], f"d{i + d}") for i in range(60) for d in (0, 1)]  # and one in mixed order
    pairs += [(3000 + i, "hot") for i in range(200)] + [(5000, None), (None, "hot"), (3000, "hot")]
    got = {r["item"]: r["group"] for r in connected_groups(spark.createDataFrame(pairs, "item bigint, key string").repartition(4)).collect()}
    assert got == groups_by_search(pairs)
    assert connected_groups(spark.createDataFrame([], "item bigint, key string")).collect() == []


def test_stories_linked_over_addresses_and_headlines(spark):
    rows = [
        ("a1", "https://x.example/1?utm_id=3", "Rates rise", "2024-01-01T10:00:00Z"), ("a2", "http://www.x.example/1/", "Other", "2024-01-03T10:00:00Z"),
        ("a3", "https://y.example/9", "OTHER!", "2024-01-03T23:00:00Z"), ("a4", "https://z.example/2", "Other", "2024-01-04T01:00:00Z"),
        ("a5", None, None, None), ("a6", None, "Rates rise", "soon"), ("a7", "", "rates rise", "soon"), (None, "https://x.example/1", "x", "soon"),
    ] + [(f"h{i}", f"https://w.example/{i}", "hot", "2024-02-02T00:00:00Z") for i in range(50)]
    df = spark.createDataFrame(rows, "article_id string, url string, headline string, published_at string")
    got = {r[0]: tuple(r)[1:] for r in dedupe.story_groups(df).collect()}
    assert got["a1"] == ("a1", 3, True) and got["a2"] == ("a1", 3, False) and got["a3"] == ("a1", 3, False)
    assert got["a4"] == ("a4", 1, True) and got["a5"] == ("a5", 1, True)
    assert got["a6"] == ("a6", 2, True) and got["a7"] == ("a6", 2, False)
    assert {got[f"h{i}"][:2] for i in range(50)} == {("h0", 50)} and "lost" not in got and len(got) == 57
    assert dedupe.first_stories(df).count() == 5


TERMS = [
    "Immigrant", "fire", "Law and order", "Egg", "January 6", "ICE", "Elon / Musk", "policy", "&", "c++", "R&D", "AT&T stock", "good-bye", "& co",
    "straße", "ſet", "x-ray vision", "half", "bus", "basis", "42", "naïve", " a / b c ",
]
TEXTS = [
    "Immigrants will attend", "The immigrant's story", "policies and policy", "policies", "laws-and-order", "They promised law  and order's", "R&D at AT&T stocks",
    "c++ and C++11", "Smith & Co and co", "STRASSE straße STRAẞE", "set ſet SET", "January 6th, 42nd", "buses basis bases halves", "x‑ray vision X-RAY VISIONS", "Eggs’ shells",
    "İce ICE ıce", "a b cs bc", "", None, "Musks firetruck fires", "good-bye good bye goodbye", "naïve NAÏVES naive", "_fire fire_ fire", "é&é & / ", "ﬁre",
]


@pytest.mark.parametrize("prefilter", [True, False])
@pytest.mark.parametrize("limit", [500_000, 0])
def test_search_equals_labels(spark, monkeypatch, prefilter, limit):
    monkeypatch.setattr(search, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(TEXTS)], "segment_id string, text string")
    columns = label.target_columns(TERMS)
    wide = label.label_segments(df, TERMS, prefilter)
    want = label.long_targets(wide, columns, ["segment_id"]).filter("hit").select("segment_id", "target")
    assert sorted(map(tuple, search.find_phrases(df, TERMS, prefilter=prefilter).collect())) == sorted(map(tuple, want.collect()))


def test_counts_equal_the_patterns(spark):
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(TEXTS)], "segment_id string, text string")
    got = search.find_phrases(df, TERMS, counts=True)
    wide = df.select("segment_id", *[p.count(F.col("text")).cast("bigint").alias(p.column) for p in vocabulary(TERMS)])
    want = label.long_targets(wide, label.target_columns(TERMS), ["segment_id"], "n").filter("n > 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ten_thousand_phrases(spark):
    pick = random.Random(12)
    word = lambda: "".join(pick.choice("bcdfgklmnprst") + pick.choice("aeiou") for _ in range(pick.randrange(1, 4)))
    terms = sorted({" ".join(word() for _ in range(pick.randrange(1, 4))) for _ in range(10_200)})[:10_000]
    used = pick.sample(terms, 150)
    texts = [" ".join(pick.choice([word(), pick.choice(used), pick.choice(used) + "s"]) for _ in range(25)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "segment_id int, text string")
    got = {tuple(r) for r in search.find_phrases(df, terms).collect()}
    want = set()
    for phrase in vocabulary(terms):
        # Words of these letters stand unchanged inside all their spellings.
        near = [(i, t) for i, t in enumerate(texts) if all(w in t for w in phrase.term.split())]
        if near:
            pattern = regex.compile(phrase.pattern.replace("(?iu)", "(?i)"), regex.V1)
            want |= {(i, phrase.column) for i, t in near if pattern.search(t)}
    assert got == want and len(want) > 500
    # Phrases that occur nowhere are never tried.
    tried = [search.candidates(df, search.phrase_index(spark, some)[0], "segment_id").count() for some in (used, [*used, *(f"zz{t}" for t in terms)])]
    assert tried[0] == tried[1] < 40 * 25 * 20
    assert re.search("Broadcast", search.find_phrases(df, used)._jdf.queryExecution().executedPlan().toString())

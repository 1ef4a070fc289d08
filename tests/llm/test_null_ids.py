"""Rows without an id are documents of their own: one of them says nothing about the others."""

from collections import Counter

from phrasecast.llm import decontaminate, jaccard_join, substring

from .conftest import prose

BASE, ALONE, TWIN = (" ".join(prose(seed, 60)) for seed in (901, 902, 903))
ROWS = [
    (1, BASE, "en", "a"), (None, BASE, "en", "a"), (None, ALONE, "en", "b"), (None, TWIN, "en", "b"), (None, TWIN, "en", "c"),
    (None, None, "en", "a"), (None, "", "en", "a"), (2, ALONE[: len(ALONE) // 3], "en", "a"),
]


def test_copies_without_ids(make_docs):
    got = Counter((r.doc_id, r.text) for r in jaccard_join.keep_first(make_docs(ROWS)).collect())
    assert got == Counter([(1, BASE), (None, ALONE), (None, TWIN), (None, None), (None, ""), (2, ALONE[: len(ALONE) // 3])])


def test_leaks_without_ids(spark, make_docs):
    bench = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    got = Counter((r.doc_id, r.text) for r in decontaminate.drop_leaks(make_docs(ROWS), bench).collect())
    assert got == Counter((i, t) for i, t, *_ in ROWS if t != BASE)


def test_repeats_without_ids(make_docs):
    got = Counter(r.kept for r in substring.strip_repeats(make_docs(ROWS)).collect())
    assert got == Counter({BASE: 1, ALONE: 1, TWIN: 1, "": 4, " ".join(ROWS[-1][1].split()): 1})

"""A frequent phrase with other words around it must not bring all its pieces to one task."""

from collections import Counter

from pyspark.sql import functions as F

from phrasecast.llm import substring
from phrasecast.llm.common import ship

from .conftest import prose
from .test_pairs import brute_strip

PHRASE = prose(77, 16)
ROWS = [(i, " ".join(prose(5000 + i % 290, 12) + PHRASE + prose(7000 + i % 290, 12)), "en", "s") for i in range(300)]


def test_hot_shard_is_divided(make_docs):
    docs = make_docs(ROWS).select("doc_id", "text")
    ship(docs.sparkSession)
    found = substring.materialize(substring._emit(docs, substring._repeated(docs, 20, 8), 20, 8), "found")
    most = lambda df: df.filter("words IS NOT NULL").groupBy("shard").agg(F.sum(F.length("words")).alias("b")).agg(F.max("b")).first()[0]
    assert most(found) > 10 * most(substring._divide_hot(found, 20, 1000))
    covered = lambda k: {(r.doc, r.at + j) for r in substring.repeated_windows(docs, most_words=k).collect() for j in range(r.n)}
    assert covered(1000) == covered(300_000)


def test_hot_shard_against_brute_force(make_docs):
    assert Counter(tuple(r) for r in substring.report(make_docs(ROWS)).collect()) == brute_strip(ROWS)

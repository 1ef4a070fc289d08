import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("score", T.StringType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text, lang, source); with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", "y", "z") for i, t, g, s in rows], SCHEMA)

    return make


def prose(seed, n, stop=("the", "of", "and", "to")):
    import random

    r = random.Random(seed)
    parts = "on er th ing re al ti es or an en at".split()
    return [r.choice(stop) if r.random() < 0.35 else "".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, repeated rows, shared ids, long texts and long words."""
    base = " ".join(prose(1, 120))
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, "en", "a"), (4, "", None, None),
        (5, " \t\n\x0b ", "fr", "b"), (None, base, "en", "b"), (None, None, None, None), (6, "a b c", "en", "a"),
        (7, "a B c", "en", "a"), (8, "x" * 50_000, "en", "b"), (9, " ".join(prose(2, 30_000)), "fr", "b"),
        (10, "one two " * 400, "fr", "c"), (11, "é à 東京 ñ z", "fr", "c"), (12, base + " tail", "en", "c"),
        (13, " ".join(reversed(base.split())), "en", None), (5, "shared id with other text " * 6, "en", "c"),
    ]

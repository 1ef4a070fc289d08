"""Disk: a written table leaves no shuffle files, and weights are the same whichever way the terms are sliced."""

import time

import pytest
from pyspark.sql import functions as F

from phrasecast import session
from phrasecast.operators import features as fx


def shuffle_blocks(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


@pytest.mark.parametrize("user", ["false", "true"])
def test_a_written_table_leaves_no_shuffle_files(spark, user):
    old = spark.conf.get(session._CLEANUP)
    spark.conf.set(session._CLEANUP, user)
    try:
        before = shuffle_blocks(spark)
        out = session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
        assert spark.conf.get(session._CLEANUP) == user
        for _ in range(50):
            if not (left := shuffle_blocks(spark) - before):
                break
            time.sleep(0.1)
        assert not left
        assert sorted(r["count"] for r in out.collect()) == [142] * 1 + [143] * 6
    finally:
        spark.conf.set(session._CLEANUP, old)


def test_slices_give_the_same_weights(spark):
    texts = [(k, " ".join(f"w{(k * j) % 11} the" for j in range(1, 9))) for k in range(12)] + [(20, None), (21, ""), (3, "the w1 w2")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    counts = session.materialize(fx.term_counts(docs, "doc_id", "text"), "counts")
    vocabulary = session.materialize(fx.fit_tfidf(counts, F.lit(len(texts))), "vocabulary")
    rows = lambda n: {(r["row_id"], r["feature"]): r["value"] for r in fx.tfidf(counts, vocabulary, slices=n).collect()}
    one, four = rows(1), rows(4)
    assert len(one) > 50 and four == pytest.approx(one)

"""Long texts: windows are made block by block, and a text goes to Python once, in small batches."""

import random

import pytest
from pyspark.sql import functions as F

from phrasecast.llm import common, decontaminate, language


def rows():
    r = random.Random(5)
    words = "alpha beta gamma delta count river stone Anna Paris seven 12 3.5 km road, bridge. light? the of in".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate((4, 7, 8, 9, 14, 20, 33))]
    docs = [(k, f"{say(n)} {items[k % 7][1]} {say(n // 3)} {items[(k + 3) % 7][1]}") for k, n in enumerate((0, 1, 5, 9, 16, 17, 40, 90, 200))]
    return items, [*docs, (20, None), (21, ""), (None, items[5][1]), (3, items[6][1])]


def found(spark, block, monkeypatch):
    items, docs = rows()
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(str, decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()))


def test_blocks_change_no_result(spark, monkeypatch):
    whole = found(spark, 10**6, monkeypatch)
    assert len(whole) >= 15
    for block in (1, 16):
        assert found(spark, block, monkeypatch) == whole


def test_no_row_holds_a_long_text(spark):
    texts = spark.createDataFrame([(1, ["a", "b"]), (2, [str(i) for i in range(5000)]), (3, [])], "doc_id long, tokens array<string>")
    got = decontaminate._blocks(texts, 8).select("doc_id", "start", F.size("tokens").alias("n")).collect()
    assert max(r["n"] for r in got) <= decontaminate.BLOCK + 7
    assert [r["start"] for r in got if r["doc_id"] == 2] == list(range(0, 5000, decontaminate.BLOCK))
    assert [tuple(r) for r in got if r["doc_id"] != 2] == [(1, 0, 2), (3, 0, 0)]


def test_a_text_goes_to_python_once_in_small_batches(spark, make_docs):
    pytest.importorskip("public_tokenizers")
    docs = make_docs([(k, f"the river and the stone {k}", "en", "a") for k in range(8)] + [(9, None, "fr", "b")])
    spark.conf.set(common._BATCH, "10000")
    model = language.train(docs)
    out = language.identify(docs, model)
    assert out.columns == [*(c for c in docs.columns if c != "score"), "lang_pred", "score"]
    assert "__text" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert int(spark.conf.get(common._BATCH)) == common.BATCH_ROWS
    got = {r["doc_id"]: (r["text"], r["lang_pred"]) for r in out.collect()}
    assert got[9] == (None, language.UNKNOWN) and got[3] == ("the river and the stone 3", "en")

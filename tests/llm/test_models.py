"""Language identification and toxicity: held-out accuracy, awkward rows and empty tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasecast.llm import language, toxicity

EN = "the river and a boat with this old house under those green hills where people walk every morning".split()
FR = "le fleuve et un bateau avec cette vieille maison sous ces collines vertes ou les gens marchent chaque matin".split()
TOXIC = "vile rotten loathsome wretch scum".split()


def sentence(rng, words, n=30):
    return " ".join(rng.choice(words) for _ in range(n))


def held_out(i, modulus, rest):
    return zlib.crc32(b"" if i is None else str(i).encode()) % modulus == rest


def test_language(make_docs, awkward):
    rng = random.Random(5)
    rows = [(1000 + i, sentence(rng, FR if i % 2 else EN), "fr" if i % 2 else "en", "a") for i in range(120)]
    got = language.report(make_docs(rows + awkward)).collect()
    assert len(got) == len(rows) + len(awkward)
    truth = {i: lang for i, _, lang, _ in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    blank = {i for i, text, *_ in awkward if i is not None and not any(c.isalpha() for c in text or "")} - {5}
    assert blank and all(r.lang_pred == "und" for r in got if r.doc_id in blank)


def test_language_reads_no_label_of_held_out_rows(make_docs):
    rng = random.Random(6)
    rows = [(i, sentence(rng, FR if i % 2 else EN), "fr" if i % 2 else "en", "a") for i in range(80)]
    other = [(i, t, "xx" if held_out(i, 4, 2) else g, s) for i, t, g, s in rows]
    first, second = [sorted(map(tuple, language.report(make_docs(r)).collect())) for r in (rows, other)]
    assert [r[:3] for r in first] == [r[:3] for r in second]
    assert [r[3] for r in first] == pytest.approx([r[3] for r in second])


def test_words_score_alike_alone_and_together(make_docs):
    model = language.train(make_docs([(i, sentence(random.Random(i), EN), "en", "a") for i in range(20)]))
    one = float(language.score_words(model, ["hills"])[0, 0])
    both = language.score_words(model, ["hills", "river", "hills"])[:, 0]
    assert list(model.languages) == ["en"] and both[[0, 2]] == pytest.approx([one, one]) and math.isfinite(one) and one < 0


def test_language_of_empty_tables(make_docs):
    assert language.report(make_docs([])).count() == 0
    none = language.report(make_docs([(1, "some words here", None, "a")])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


def test_toxicity(spark, make_docs, awkward):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = sentence(rng, EN, 20).split() + ([rng.choice(TOXIC) for _ in range(6)] if bad else [])
        rng.shuffle(words)
        rows.append((1000 + i, " ".join(words), "en", "a"))
        labels.append((1000 + i, int(bad) if i % 5 else None))
    labels += [(None, 1), (1, 0), (1, 0), (3, 0)]
    marked = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("score", F.lit("clash"))
    got = toxicity.report(make_docs(rows + awkward), marked).collect()
    assert len(got) == len(rows) + len(awkward)
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.5) for r in got)
    judged = [(r.predicted, int((r.doc_id - 1000) % 6 == 0)) for r in got if r.held_out and (r.doc_id or 0) >= 1000]
    assert judged and np.mean([p == t for p, t in judged]) > 0.95
    assert not [r for r in got if r.doc_id in (3, 4) and r.predicted]


def test_toxicity_without_rows_or_positives(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.report(make_docs([]), none).count() == 0
    got = toxicity.report(make_docs([(1, "a b", "en", "a"), (2, None, None, None)]), none).collect()
    assert len(got) == 2 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)

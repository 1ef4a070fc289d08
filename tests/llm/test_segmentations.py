"""Language probabilities against sums over all segmentations, written out one by one."""

import math

import numpy as np
import pytest

from phrasecast.llm.language import RARE, Model, Pieces, _padded, train


def splits(word):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        for rest in splits(word[k:]):
            yield (word[:k], *rest)


@pytest.fixture(scope="module")
def model():
    names = sorted({"▁", "▁a", "a", "ab", "b", "bab", "▁ba", "c", "ca", "▁abc"})
    p = np.random.default_rng(5).dirichlet(np.ones(len(names)), 2).T
    table = np.concatenate([p, [[0.0, 0.0]], [[RARE, RARE]]])
    return names, Model(("x", "y"), np.array([0.5, 0.5]), table, Pieces(names))


def chances(names, model, word, lang):
    at = {x: model.probability[i, lang] for i, x in enumerate(names)}
    chance = lambda piece: at.get(piece, RARE if len(piece) == 1 else 0.0)
    return {s: math.prod(map(chance, s)) for s in splits("▁" + word)}


@pytest.mark.parametrize("word", ["a", "ab", "abab", "babca", "zzz", "abzca", "abcabcab"])
def test_forward_sums_all_segmentations(model, word):
    names, m = model
    want = [math.log(sum(chances(names, m, word, k).values())) for k in (0, 1)]
    assert np.allclose(m.forward([word, word]), [want, want], rtol=1e-9)


@pytest.mark.parametrize("word", ["a", "abab", "babca", "zaz", "abcabcab"])
def test_expected_uses_are_means_over_all_segmentations(model, word):
    names, m = model
    counts = np.array([[3.0, 2.0]])
    found = m.expected([word], counts)
    for k in (0, 1):
        mass = chances(names, m, word, k)
        total = sum(mass.values())
        for i, piece in enumerate(names):
            want = counts[0, k] * sum(v * s.count(piece) for s, v in mass.items()) / total
            assert found[i, k] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_long_words_have_finite_uses(model):
    """Every character of a word of 4000 letters is inside exactly one piece."""
    names, m = model
    word = "abc" * 1300 + "z" * 100
    found = m.expected([word], np.ones((1, 2)))
    covered = sum(len(x) * found[i] for i, x in enumerate(names)) + found[-1]
    assert np.allclose(covered, _padded([word]).shape[1], rtol=1e-6)
    assert np.all(np.isfinite(m.forward([word])))


def test_training_reads_words_of_any_length_and_repeated_rows(spark):
    """A language known only by one word of 900 letters is learned; equal rows and null rows do no harm."""
    rows = [(i, "lorem ipsum dolor", "la") for i in range(5)] + [(9, "kq" * 450, "xx")] * 3 + [(None, None, "la"), (7, "text", None)]
    fitted = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=4)
    assert fitted.languages == ("la", "xx")
    found = fitted.forward(["kq" * 20])[0]
    assert found[1] > found[0]
    assert train(spark.createDataFrame([], "doc_id long, text string, lang string")).languages == ()

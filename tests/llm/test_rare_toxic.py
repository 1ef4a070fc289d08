"""A kind of toxic text that few of the positives have is learned, too; copies of one text are no evidence."""

import random

import numpy as np

from phrasecast.llm import toxicity

from .test_models import EN, FR, TOXIC, sentence

RARE = "immonde crapule ordure vermine".split()


def mixture(words, insults, n, seed):
    rng = random.Random(seed)
    return [sentence(rng, words, 20) + " " + sentence(rng, insults, 6) for _ in range(n)]


def test_rare_kind_of_toxic_text():
    slots = toxicity._Slots()
    of = lambda texts: [toxicity.features(t, slots) for t in texts]
    rng = random.Random(3)
    clean = [sentence(rng, FR if i % 25 == 0 else EN, 26) for i in range(1600)]
    hidden = mixture(EN, TOXIC, 171, 9) + mixture(FR, RARE, 7, 10)  # the unlabelled hold toxic texts as well
    positive = mixture(EN, TOXIC, 480, 4) + mixture(FR, RARE, 20, 5)  # 4 %
    copies = ["quux corge grault " + sentence(random.Random(6), EN, 20)] * 30
    model = toxicity.fit(of(positive + copies), of(clean + hidden), 0.1)
    score = lambda texts: np.array([model.weights[f].sum() + model.bias for f in of(texts)])
    assert (score(mixture(FR, RARE, 40, 7)) > 0).mean() > 0.9
    assert (score(mixture(EN, TOXIC, 40, 8)) > 0).mean() > 0.9
    assert (score([sentence(random.Random(50 + i), FR if i % 2 else EN, 26) for i in range(40)]) > 0).mean() < 0.05
    assert score(["quux corge grault"])[0] < 0

"""The subword classifier's forward pass and a step of its training, against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from wareflow.llm import subword
from wareflow.llm.subword import KINDS, Shape

SHAPE = Shape(lower=True, buckets=256, dim=4)


def model(seed=0, classes=3):
    rng = np.random.default_rng(seed)
    return subword.SubwordModel(SHAPE, rng.normal(0, 1, (KINDS * SHAPE.buckets, SHAPE.dim)).astype(np.float32), rng.normal(0, 1, (SHAPE.dim, classes)).astype(np.float32), rng.normal(0, 1, classes).astype(np.float32), list(range(classes)), temperature=1.7)


def forward(m, text):
    """Each kind's vectors averaged one by one, the kinds averaged, a linear layer, and a softmax."""
    by_kind = [[] for _ in range(KINDS)]
    for block in subword.features(text, SHAPE):
        for kind, buckets in enumerate(block):
            by_kind[kind] += [[float(x) for x in m.table[b]] for b in buckets]
    hidden = [0.0] * SHAPE.dim
    for vectors in by_kind:
        for d in range(SHAPE.dim):
            hidden[d] += sum(v[d] for v in vectors) / max(1, len(vectors)) / KINDS
    scores = [(sum(hidden[d] * float(m.layer[d, c]) for d in range(SHAPE.dim)) + float(m.bias[c])) / m.temperature for c in range(len(m.classes))]
    total = sum(math.exp(s) for s in scores)
    return [math.exp(s) / total for s in scores]


@pytest.mark.parametrize("text", ["one two three, one", "a", "", "ÄÖ ß \U0001f600 12 %%", "x" * 50, "word " * 400])
def test_probabilities_by_hand(text):
    m = model()
    assert m.probabilities([text])[0].tolist() == pytest.approx(forward(m, text), abs=1e-5)


def test_counted_features_are_the_same_vector():
    m = model(1)
    ids, weights = subword.counted("one two three, one two", SHAPE)
    assert (m.table[ids].astype(float) * weights[:, None]).sum(axis=0).tolist() == pytest.approx(m.vector("one two three, one two").tolist(), abs=1e-5)
    assert len(set(ids.tolist())) == len(ids) and weights.sum() == pytest.approx(1.0)


def test_a_step_follows_the_gradient():
    ids, weights = subword.counted("some words of a text", SHAPE)
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / SHAPE.dim, 1 / SHAPE.dim, (KINDS * SHAPE.buckets, SHAPE.dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (SHAPE.dim, 2)).astype(np.float32)
    made = subword.train([(ids, weights)], np.array([0]), [0, 1], SHAPE, epochs=1, rate=0.25)

    def loss(vectors, layer, bias):
        scores = weights.astype(float) @ vectors @ layer + bias
        return -scores[0] + math.log(np.exp(scores).sum())

    start = [table[ids].astype(float), layer.astype(float), np.zeros(2)]

    def slope(which):
        out = np.zeros_like(start[which])
        for at in np.ndindex(out.shape):
            moved = [x.copy() for x in start]
            moved[which][at] += 1e-6
            up = loss(*moved)
            moved[which][at] -= 2e-6
            out[at] = (up - loss(*moved)) / 2e-6
        return out

    rate = 0.25 + 1e-3
    assert made.layer == pytest.approx(start[1] - rate * slope(1), abs=1e-5)
    # A bucket's step is scaled by the row's number of buckets.
    assert made.table[ids] == pytest.approx(start[0] - rate * len(ids) * slope(0), abs=1e-5)
    assert made.bias[0] == pytest.approx(-rate * slope(2)[0], abs=1e-5)
    others = np.setdiff1d(np.arange(len(table)), ids)
    assert (made.table[others] == table[others]).all()

from __future__ import annotations

import random

import numpy as np
from wareflow.llm import fitting, langid, subword


def texts(label, n, words=30):
    rng, own = random.Random(label), random.Random(n * 1000 + label)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(25)]
    return [" ".join(own.choice(known) for _ in range(words)) for _ in range(n)]


def test_every_language_is_learned(spark):
    rows = [(1000 * k + i, t, f"l{k:02d}") for k in range(80) for i, t in enumerate(texts(k, 20 if k > 70 else 24))] + [(-1, "no label here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4)
    model = langid.fit(docs)
    assert model.classes == [f"l{k:02d}" for k in range(80)]
    found = langid.identify(docs.where("lang is not null"), model).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_rows_are_bounded_by_taking_fewer_of_each_label():
    assert [fitting.bounded(600, n) for n in (0, 1, 4, 10, 64, 640, 100_000)] == [600, 600, 600, 600, 100, 10, 1]
    assert fitting.bounded(1200, 2) == 1200


def test_rare_labels_do_not_upset_training():
    rows, labels = [], []
    for k, n in enumerate([300, 300, 300, 4, 1]):
        rows += [subword.counted(t, langid.SHAPE) for t in texts(k, n)]
        labels += [k] * n
    model = subword.train(rows, np.array(labels), list("abcde"), langid.SHAPE)
    assert np.isfinite(model.table).all() and np.abs(model.bias).max() < 20
    # One row is too little to be told by; it must not spoil the others.
    for k in range(4):
        assert (model.probabilities(texts(k, 20)).argmax(axis=1) == k).mean() > 0.9

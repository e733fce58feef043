"""Decontamination against brute force with the weighted Jaccard, its recall, and benchmarks of several blocks."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from wareflow.llm import decontam

#: Few words, so that shingles repeat and their weights count.
WORDS = [f"w{k}" for k in range(7)]


def weights(words):
    size = min(5, len(words))
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def likeness(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute_force(docs, items):
    """The best likeness of each (document, item) with one of 0.8 or more."""
    best = {}
    for d, text in docs:
        for i, item in items:
            words, own = text.split(), item.split()
            size = min(len(own), len(words))
            if 100 * size < 80 * len(own):
                continue
            most = max(likeness(weights(words[k : k + size]), weights(own)) for k in range(len(words) - size + 1))
            if most >= 0.8:
                best[d, i] = most
    return best


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    draw = lambda n: [rng.choice(WORDS) for _ in range(n)]
    # Items of which a part repeats: the same set of shingles with other weights is not the same item.
    items = [(i, " ".join(draw(rng.randint(25, 45)) if i % 2 else (draw(6) * 9)[: rng.randint(30, 45)])) for i in range(10)]
    docs = []
    for d in range(40):
        i = rng.randrange(10)
        body = draw(rng.randint(0, 40)) + edited(items[i][1].split(), rng.choice([0, 0, 1, 1, 2]), rng) + draw(rng.randint(0, 40))
        docs.append((d, " ".join(body)))
    docs.append((40, " ".join((items[0][1].split()[:6]) * 30)))
    return docs, items


def test_matches_equal_brute_force(spark, tables):
    docs, items = tables
    wanted = brute_force(docs, items)
    rows = decontam.matched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, m["item"]): m["likeness"] for r in rows for m in r.matches}
    assert set(got) <= set(wanted) and len(got) >= 0.97 * len(wanted) > 20
    assert all(got[k] == pytest.approx(wanted[k]) for k in got)


def test_recall_of_the_radius():
    """Of edited items that reach 0.8, the fingerprints are within the radius."""
    rng = np.random.default_rng(9)
    within, passed, furthest = 0, 0, 0
    for _ in range(3000):
        n = int(rng.integers(30, 120))
        own = rng.integers(0, 2000, n)
        other = own.copy()
        for at in rng.integers(0, n, rng.integers(1, max(2, n // 25))):
            other[at] = rng.integers(0, 2000)
        a, b = (decontam.words_of(" ".join(f"t{x}" for x in w)) for w in (own, other))
        if likeness(weights([str(x) for x in own]), weights([str(x) for x in other])) < 0.8:
            continue
        prints = [decontam._packed(decontam._signs(w).sum(axis=0, dtype=np.int64)[None, :])[0] for w in (a, b)]
        far = int(np.bitwise_count(prints[0] ^ prints[1]))
        passed, within, furthest = passed + 1, within + (far <= decontam.RADIUS), max(furthest, far)
    assert passed > 1000 and within / passed >= 0.999, (passed, within, furthest)


def test_a_benchmark_of_several_blocks(spark, tables, monkeypatch):
    docs, items = (spark.createDataFrame(rows, f"{key} long, text string") for rows, key in zip(tables, ("doc_id", "item_id"), strict=True))
    docs = docs.selectExpr("*", "1 as item", "2 as likeness")
    one = {(r.doc_id, m["item"]) for r in decontam.matched(docs, items).collect() for m in r.matches}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 3)
    several = decontam.matched(docs, items)
    assert several.columns == [*docs.columns, "matches"]
    assert {(r.doc_id, m["item"]) for r in several.collect() for m in r.matches} == one

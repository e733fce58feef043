from __future__ import annotations

import random
import re

import numpy as np
import pytest
from wareflow.llm import components, neardup

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text, size):
    words = [w for w in re.split(b"[\x20\x09-\x0d]+", (text or "").encode().translate(LOWER)) if w]
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_force(rows, size, percent):
    sets = {d: shingle_set(t, size) for d, t in rows}
    group = {d: d for d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = base[:]
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def check(spark, rows, size, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(docs, size, percent).collect()}
    assert got == brute_force(rows, size, percent)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_crowded_groups_equal_brute_force(spark, size, percent):
    texts = near_copies(150, 120, 9, 1) + near_copies(40, 60, 6, 2) + near_copies(8, 30, 2, 3) + ["lone text of its own " + str(i) for i in range(20)]
    rows = list(enumerate(texts, 100))
    random.Random(5).shuffle(rows)
    check(spark, rows, size, percent)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One Two"), (8, "one two three"), (9, "a b c d e f g"), (10, "a b c d e f g"), (11, "É é é"), (12, "é é é"), (13, "x " * 50_000), (14, "x " * 60_000)]
    check(spark, rows, 3, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert neardup.groups(docs.limit(0)).count() == 0
    twice = neardup.groups(docs.union(docs), 3, 85).collect()
    assert len(twice) == 28 and {(r.id, r.component_id) for r in twice} == {(r.id, r.component_id) for r in neardup.groups(docs, 3, 85).collect()}


def test_bands_and_signatures():
    assert neardup.bands_for(0.85) == 24 and neardup.bands_for(0.8) == 35
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 4000).astype(np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64)
    one, two = neardup.circulant(a, 2000), neardup.circulant(np.concatenate([a[:3000], b]), 2000)
    assert abs((one == two).mean() - 3000 / 5000) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200, 201: 200}

"""Vector codes against a plain version that compares with every entry, and against SQL."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from wareflow.llm import codes


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of the rows, and the digest of the codebooks."""
    kept = [(k, [math.floor(4096 * float(np.float32(x))) for x in v], y) for k, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for c in cut:
                mine[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else b for m, b in zip(mine, books[p], strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    total = {}
    for (_, _, y), f in zip(kept, found, strict=True):
        total[y] = total.get(y, 0) + sum(e for e, _ in f)
    out = [(k, "".join(f"{e:02x}" for _, e in f), sum(e for e, _ in f), total[y]) for (k, _, y), f in zip(kept, found, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def table(spark, rows):
    """With a column whose name an output column has."""
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")


def same(spark, rows):
    found, books = codes.compressed(table(spark, rows))
    wanted, digest = plain(rows)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    assert digest is None or codes.digest(books) == digest


def vectors(n, seed, step=0.25, size=16):
    rng = random.Random(seed)
    return [(i, [rng.randint(-4, 4) * step / 64 for _ in range(size)], rng.choice([None, 1, 2])) for i in range(n)]


def test_ties_nulls_repeats_and_unusable_rows(spark):
    rows = vectors(120, 1)
    rows += rows[:9] + [(None, rows[3][1], 7), (500, None, 1), (501, [None] * 16, 1), (502, [float("inf")] + [0.0] * 15, 2), (503, [float("nan")] * 16, None)]
    rows += [(600 + i, [0.0] * 16, 3) for i in range(60)]
    same(spark, rows)


def test_fewer_rows_than_entries_and_none(spark):
    same(spark, vectors(5, 2))
    same(spark, [(1, None, 1)])
    same(spark, [])


def test_large_components_are_exact(spark):
    same(spark, vectors(40, 3, step=3e6, size=8))


def test_lengths_must_agree(spark):
    with pytest.raises(ValueError, match="multiple of 8"):
        codes.compressed(table(spark, [(1, [0.0] * 9, 1)]))
    with pytest.raises(Exception, match="must all have 8 components"):
        codes.compressed(table(spark, [*vectors(30, 4, size=8), (99, [0.0] * 16, 1)]))[0].collect()


@pytest.mark.parametrize("seed", range(6))
def test_the_annulus_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-9, 9, (int(rng.integers(1, 40)), 3)).tolist()
    entries += entries[: len(entries) // 3]
    x = np.concatenate([rng.integers(-12, 12, (400, 3)), np.array(entries)])
    found, best = codes.Codebook(entries).nearest(x)
    far = ((x[:, None, :] - np.array(entries)[None]) ** 2).sum(axis=2)
    assert (found == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_a_code_stands_for_its_entries(spark):
    rows = vectors(50, 5)
    found, books = codes.compressed(table(spark, rows))
    by_id = {r.vec_id: r for r in found.collect()}
    for k, v, _ in rows:
        back = codes.decoded(by_id[k].code, books)
        assert sum((a - math.floor(4096 * b)) ** 2 for a, b in zip(back, v, strict=True)) == by_id[k].error


def test_labels_are_looked_up_alike_either_way(spark, monkeypatch):
    from wareflow.llm import shared

    rows = vectors(60, 6)
    plain_way = sorted(map(tuple, codes.compressed(table(spark, rows))[0].collect()))
    monkeypatch.setattr(codes, "looked_up", lambda r, t, on, by: shared.looked_up(r, t, on, by, most=0))
    assert sorted(map(tuple, codes.compressed(table(spark, rows))[0].collect())) == plain_way


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
        wanted = c.sql(codes.ORACLE_SQL).df()
    got = codes.query(spark, sf_dir).toPandas()[list(wanted.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, wanted.values.tolist())) and len(got)

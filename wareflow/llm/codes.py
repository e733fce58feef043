"""Vector code compression: product quantisation whose nearest-entry search prunes by norms.

Vectors become integers, are cut into equal parts, and each part is coded by its nearest entry in that part's
codebook.  A codebook's entries are sorted by their norms.  By the triangle inequality an entry can be no nearer
than the norms of entry and part differ, so the search begins at the entry with the nearest norm, finds by binary
search the interval of norms that the best distance so far allows (an annulus, bounds included), and evaluates the
entries in it exactly and from the middle outwards, narrowing the interval as the best distance falls.

Training is a pass a round: every task sums up its parts by entry (at most parts x entries x places numbers), Spark
adds those up, and the driver, which holds the codebooks alone, divides.  All arithmetic that decides is on integers.

Defined cases: rows whose vector is null or has null or non-finite components are left out, an empty table gives an
empty one; vectors must have the length of the first one, a multiple of the number of parts, or the job ends with an
error.  Repeated rows and repeated ids count as often as they occur; rows without an id come last where the first
entries are chosen; with fewer rows than entries a codebook has fewer entries.  Components of any finite size are
exact (Python integers where 64 bits do not hold the squares); an error beyond 64 bits ends the job.  Columns of the
input other than id, vector and label are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm.shared import looked_up, saved, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components up to this size keep sums of squares of a few thousand places within 64 bits.
_NARROW = 1 << 24


class Codebook:
    """The entries of one part, sorted by norm for the search."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        whole = np.array(entries, object).reshape(len(entries), -1)
        norms = np.sqrt((whole * whole).sum(axis=1).astype(float))
        #: The entry's own index by its place in the order of norms.
        self.own = np.argsort(norms, kind="stable")
        self.norms = norms[self.own]
        self.wide = whole[self.own]
        self.narrow = self.wide.astype(np.int64) if not whole.size or abs(whole).max() <= _NARROW else None

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of its nearest entry, the lower one of ties, and the squared distance."""
        if self.narrow is None or (vectors.size and np.abs(vectors).max() > _NARROW):
            entries, vectors = self.wide, vectors.astype(object)
        else:
            entries = self.narrow
        norm = np.sqrt((vectors * vectors).sum(axis=1).astype(float))
        right = np.searchsorted(self.norms, norm).clip(0, len(entries) - 1)
        left = (right - 1).clip(0)
        start = np.where(norm - self.norms[left] < self.norms[right] - norm, left, right)
        found = self.own[start]
        gap = vectors - entries[start]
        best = (gap * gap).sum(axis=1)
        rows = np.arange(len(vectors))
        for step in range(1, len(entries)):
            low, high = self._annulus(norm[rows], best[rows])
            # What is left of a row's annulus may lie on one side of its start only.
            rows = rows[(start[rows] - step >= low) | (start[rows] + step < high)]
            if not len(rows):
                break
            for side in (-step, step):
                low, high = self._annulus(norm[rows], best[rows])
                at = start[rows] + side
                inside = (at >= low) & (at < high)
                asked, at = rows[inside], at[inside]
                gap = vectors[asked] - entries[at]
                far, own = (gap * gap).sum(axis=1), self.own[at]
                better = (far < best[asked]) | ((far == best[asked]) & (own < found[asked]))
                best[asked[better]], found[asked[better]] = far[better], own[better]
        return found, best

    def _annulus(self, norm: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places [low, high) of the norms that differ from ``norm`` by no more than the best distance.

        Both bounds give way by more than floats may be off, so nothing on a bound is left out.
        """
        reach = np.sqrt(best.astype(float))
        slack = (norm + reach + 1) * 2.0**-40
        return np.searchsorted(self.norms, norm - reach - slack, "left"), np.searchsorted(self.norms, norm + reach + slack, "right")


def _cut(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """The batch's vectors as (rows, parts, places of a part)."""
    vectors = batch.column("_vector")
    sizes = vectors.value_lengths().to_numpy()
    if (sizes != parts * width).any():
        raise ValueError(f"vectors must all have {parts * width} components")
    return vectors.flatten().to_numpy().reshape(len(sizes), parts, width)


#: Components that a task works on at once, about.
_AT_ONCE = 1 << 22


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches put together to about _AT_ONCE components, given those of a vector."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) * max(1, size) >= _AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(_key, _label, _vector) of the rows that are kept, with components floor(scale * x), written and read again."""
    x = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return saved(vectors.where(usable).select(F.col(key).alias("_key"), F.col(label).alias("_label"), whole.alias("_vector")))


def train(numbers: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """The codebooks, one a part, after ``rounds`` over all rows of ``whole_numbers``; none for an empty table.

    They start as the parts of the rows with the least keys.  What the driver gets is bounded by the parameters: the
    first ``entries`` rows, and in each round a sum a part, entry and place.
    """
    first = [r["_vector"] for r in numbers.orderBy(F.col("_key").asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()]
    if not first:
        return []
    width, rest = divmod(len(first[0]), parts)
    if rest or any(len(v) != len(first[0]) for v in first):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    books = [Codebook([list(v[p * width : (p + 1) * width]) for v in first]) for p in range(parts)]
    for _ in range(rounds):
        books = _moved(numbers, books, width)
    return books


def _moved(numbers: DataFrame, books: list[Codebook], width: int) -> list[Codebook]:
    """The codebooks with each entry moved to the mean of the parts that are nearest to it."""
    sent = numbers.sparkSession.sparkContext.broadcast(books)
    small_batches(numbers.sparkSession)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in _joined(batches, width * len(sent.value)):
            cut = _cut(batch, len(sent.value), width)
            for p, book in enumerate(sent.value):
                found, _ = book.nearest(cut[:, p])
                for e in np.unique(found):
                    mine = cut[found == e, p]
                    # The last place counts the parts.
                    sums = np.append(mine.sum(axis=0), len(mine))
                    total[p, int(e)] = total[p, int(e)] + sums if (p, int(e)) in total else sums
        for (p, e), sums in total.items():
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int32()), pa.array([e] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(sums, pa.int64())], ["part", "entry", "place", "total"])

    sums = numbers.select("_vector").mapInArrow(summed, "part int, entry int, place int, total long")
    moved = [[list(e) for e in book.entries] for book in books]
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found.setdefault((r["part"], r["entry"]), {})[r["place"]] = int(r["total"])
    for (p, e), by_place in found.items():
        moved[p][e] = [by_place[k] // by_place[width] for k in range(width)]
    sent.unpersist()
    return [Codebook(m) for m in moved]


def encode(numbers: DataFrame, books: list[Codebook]) -> DataFrame:
    """(_key, _label, code, error): two hex digits a part, and the sum of the squared distances."""
    schema = f"_key {dict(numbers.dtypes)['_key']}, _label {dict(numbers.dtypes)['_label']}, code string, error long"
    if not books:
        return numbers.sparkSession.createDataFrame([], schema)
    if max(len(b.entries) for b in books) > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    sent, width = numbers.sparkSession.sparkContext.broadcast(books), len(books[0].entries[0])
    small_batches(numbers.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, width * len(sent.value)):
            cut = _cut(batch, len(sent.value), width)
            found = [book.nearest(cut[:, p]) for p, book in enumerate(sent.value)]
            codes = np.stack([f for f, _ in found], axis=1).astype(np.uint8)
            error = sum(best for _, best in found)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["_key", "_label", "code", "error"])

    return numbers.mapInArrow(coded, schema)


def decoded(code: str, books: list[Codebook]) -> list[int]:
    """The vector that a code stands for, in whole numbers."""
    return [x for p, e in enumerate(bytes.fromhex(code)) for x in books[p].entries[e]]


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b.entries for x in e).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[Codebook]]:
    """The codes of all usable ``vectors`` (key, code, error, label_error) and the codebooks.

    ``label_error`` is the error summed up over equal labels, null ones together.  The sums, a row a label, are looked
    up by broadcast where they are few and by a join that deals a label's rows over the tasks where they are many.
    """
    numbers = whole_numbers(vectors, key, vector, label, scale)
    books = train(numbers, parts, entries, rounds)
    coded = saved(encode(numbers, books))
    on = ["_none", "_of"]
    rows = coded.withColumns({"_none": F.col("_label").isNull(), "_of": F.coalesce(F.col("_label").cast("string"), F.lit(""))}).drop("_label")
    found = looked_up(rows, rows.groupBy(*on).agg(F.sum("error").alias("label_error")), on, ["code", "_key"])
    return found.select(F.col("_key").alias(key), "code", "error", "label_error"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: codes of all usable rows of ``embeddings``."""
    found, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql() -> str:
    """The same by comparing with all entries: a chain of rounds, each of them assigned and moved."""
    parts = [f"""
      whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      rows AS (SELECT row_number() OVER () AS r, * FROM whole),
      cut AS (SELECT r, p, v[(p * (len(v) // {PARTS}) + 1):((p + 1) * (len(v) // {PARTS}))] AS x FROM rows, range({PARTS}) t(p)),
      firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM rows QUALIFY e < {ENTRIES}),
      book0 AS (SELECT p, e, x FROM cut JOIN firsts USING (r))"""]  # fmt: skip
    for k in range(ROUNDS + 1):
        parts.append(f"""
      near{k} AS MATERIALIZED (SELECT r, p, arg_min({{'e': e, 'd': d}}, (d, e)) AS n FROM (
        SELECT c.r, c.p, b.e, CAST(list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cut c JOIN book{k} b ON c.p = b.p) GROUP BY r, p)""")
        if k < ROUNDS:
            parts.append(f"""
      book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
        SELECT p, e, list(s ORDER BY i) AS x FROM (SELECT c.p, n.n.e AS e, i, (sum(c.x[i]) - ((sum(c.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS s
          FROM cut c JOIN near{k} n ON c.r = n.r AND c.p = n.p, range(1, len(c.x) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return f"""WITH {",".join(parts)},
      coded AS (SELECT r, string_agg(printf('%02x', n.e), '' ORDER BY p) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM book{ROUNDS})) AS codebooks_sha256
      FROM rows JOIN coded USING (r)"""


ORACLE_SQL = _sql()

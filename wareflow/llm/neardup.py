"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A text is the set of its word shingles.  Texts with equal sets form a class, a node of the graph; only nodes are
compared.  One permutation places the shingles, a second one, shifted by k places, gives signature coordinate k as
its least value over them.  Coordinates in bands of ``ROWS`` send nodes with a like band to the same bucket; the
number of bands follows from the threshold, so that a pair right at it is missed with a probability of one in a
million at most, and likelier pairs far less often.

Every pair in a bucket is settled without listing all pairs:

1. Each bucket's members are compared with its most central member, the one with the most companions over all
   bands.
2. Where a bucket's members are then not all connected, those outside its largest component are compared with the
   members of other components, in blocks of sketches.  Of each such member and component the likeliest pair is
   verified first; the others only if the two are still apart.

A sketch is a bitmap of a set's hashes, 4 to 8 bits a shingle.  A bit that one sketch has and another lacks is a
shingle that the other set lacks, so sketches refute pairs for certain and lose no link.  Pairs that they leave are
verified on the full sets of the whole texts.  No step joins a bucket or a hub in one task: keys with many rows
are split by salts.

Defined cases: null texts and texts without words have an empty set and link with nothing, not with each other;
with fewer words than a shingle the whole sequence is one shingle.  Rows that are repeated, or equal but for the
id, are one node.  Ids are whole numbers; rows without an id are linked as well, and a group of them alone has no
component id.  Rows of one id with different texts are different rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm.components import connected
from wareflow.llm.shared import HOT, dealt_join, fixed_plans, let_go, salted_join, saved, shuffled_join, small_batches, tidy
from wareflow.llm.words import mix, shingles, word_hashes

ROWS = 5
MISSED = 1e-6
#: What a task compares at once of one side, about: so many sketches of up to LOAD shingles, or fewer longer ones.
BLOCK, LOAD = 512, 4096
#: Documents for each partition of a shuffle of their bucket keys, about.
_DOCUMENTS = 2000


def bands_for(threshold: float, rows: int = ROWS, missed: float = MISSED) -> int:
    return math.ceil(math.log(missed) / math.log(1 - threshold**rows))


def circulant(found: np.ndarray, coordinates: int) -> np.ndarray:
    """The signature of a set of hashes: the least values of one permutation under ``coordinates`` shifts."""
    placed = (mix(found ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(placed), 2048):
        x = (placed[at : at + 2048] + shift) * np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        least = np.minimum(least, x.min(axis=1))
    return least


def _bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key a band."""
    keys = signature.reshape(-1, rows).astype(np.uint64)
    out = np.arange(len(keys), dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(31) + keys[:, k])
    return out


def text_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(text), size))


def signed(docs: DataFrame, size: int, bands: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: id, t (a hash of its text), n (set size), the class of its set (class_a, class_b) and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, classes, keys = [], [], []
            for t in batch.column(2):
                found = text_set(t.as_py(), size)
                n.append(len(found))
                classes.append((mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                keys.append(_bands(circulant(found, bands * ROWS), ROWS) if len(found) else np.empty(0, np.uint64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            pair = np.array(classes, np.uint64).reshape(-1, 2).view(np.int64)
            flat = (np.concatenate(keys) if keys else np.empty(0, np.uint64)).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "t", "n", "class_a", "class_b", "bands"])

    return _named(docs, key, text).mapInArrow(run, "id long, t long, n long, class_a long, class_b long, bands array<long>")


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))


def sketch(found: np.ndarray) -> bytes:
    """The bitmap of a set: a power of two of bits, at least four a shingle."""
    bits = 1 << max(8, (4 * len(found) - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap, or a matrix of them, made as short as ``words`` 64-bit words."""
    return bitmap if bitmap.shape[-1] == words else np.bitwise_or.reduce(bitmap.reshape(*bitmap.shape[:-1], -1, words), axis=-2)


def _gaps(one: np.ndarray, n: int, many: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For a sketch against others of one length: bits in which they differ, -1 where the pair cannot reach the threshold."""
    words = min(one.shape[-1], many.shape[-1])
    one, many = _folded(one, words), _folded(many, words)
    shared = -(-percent * (n + sizes) // (100 + percent))
    mine, theirs = np.bitwise_count(one & ~many).sum(axis=1, dtype=np.int64), np.bitwise_count(many & ~one).sum(axis=1, dtype=np.int64)
    return np.where((mine <= n - shared) & (theirs <= sizes - shared), mine + theirs, -1)


def _held(docs: DataFrame, nodes: DataFrame, total: int, size: int, key: str, text: str) -> DataFrame:
    """Of each node (node, id, t, n, rows): its text and the sketch of its set.

    ``rows`` is how many of the ``total`` documents have the node's set: a row that is repeated often, or a text that many
    rows without an id share, is dealt over the tasks, and each of them keeps one text of it.
    """

    @F.arrow_udf("binary")
    def sketched(texts: pa.Array) -> pa.Array:
        return pa.array([sketch(text_set(t.as_py(), size)) for t in texts], pa.binary())

    # Ids may be null, and their rows many, so the text's hash is a part of the key.
    place = [F.coalesce("id", F.lit(0)).alias("id"), "t"]
    wanted = dealt_join(_named(docs, key, text).select(*place, "text"), nodes.select("node", "n", "rows", *place), ["id", "t"], total)
    one = wanted.groupBy("node").agg(F.first("n").alias("n"), F.first("text").alias("text"))
    return one.select("node", "n", "text", sketched("text").alias("bits"))


def _beside(pairs: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with columns of both nodes; a node may be in any number of pairs.

    As in ``salted_join``, but the nodes' columns are looked up by the narrow pairs before the pairs get wide.
    """
    salts = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pairs.select("a", "b", *[F.pmod(F.xxhash64(other), F.lit(salts)).cast("int").alias(f"salt_{side}") for side, other in (("a", "b"), ("b", "a"))])
    found = salted
    for side in ("a", "b"):
        named = held.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        here = salted.select(side, f"salt_{side}").distinct().join(named, side)
        found = found.join(here, [side, f"salt_{side}"])
    return found


def _possible(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches do not refute."""

    @F.arrow_udf("boolean")
    def possible(bits_a: pa.Array, n_a: pa.Array, bits_b: pa.Array, n_b: pa.Array) -> pa.Array:
        found = []
        for a, n, b, m in zip(bits_a, n_a.to_pylist(), bits_b, n_b.to_pylist(), strict=True):
            one, other = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            found.append(_gaps(one, n, other[None, :], np.array([m]), percent)[0] >= 0)
        return pa.array(found, pa.bool_())

    sized = _beside(pairs, held, ["n", "bits"]).where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.where(possible("bits_a", "n_a", "bits_b", "n_b")).select("a", "b")


def _confirmed(pairs: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets' Jaccard is at least percent / 100."""

    @F.arrow_udf("boolean")
    def alike(texts_a: pa.Array, texts_b: pa.Array) -> pa.Array:
        found, known, one = [], None, None
        for a, b in zip(texts_a, texts_b, strict=True):
            a = a.as_py()
            if a != known:
                known, one = a, text_set(a, size)
            other = text_set(b.as_py(), size)
            shared = len(np.intersect1d(one, other, assume_unique=True))
            found.append(100 * shared >= percent * (len(one) + len(other) - shared))
        return pa.array(found, pa.bool_())

    return _beside(pairs, held, ["text"]).where(alike("text_a", "text_b")).select("a", "b")


def _buckets(classes: DataFrame) -> DataFrame:
    """Members (key, size, node) of the buckets with two or more; of buckets with the same members there is one."""
    # Sketches of long texts are long, so blocks of them hold fewer.
    load = F.ceil(F.col("n") / LOAD).cast("long").alias("load")
    placed = classes.select("node", load, F.explode("bands").alias("key"))
    sizes = saved(placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    # Buckets with more than 1/HOT of all members are split; there are fewer than HOT of them.
    part = max(1, total // HOT)
    hot = sizes.where(F.col("size") > part).select("key", F.ceil(F.col("size") / part).cast("int").alias("salts"))

    def salted(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(hot), "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    left = salted(placed).withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int")).drop("salts")
    right = salted(sizes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    members = saved(shuffled_join(left, right, ["key", "salt"], "inner").select("key", "size", "node", "load"))
    marks = members.groupBy("key", "size").agg(*[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)])
    first = marks.groupBy("size", "mark1", "mark2").agg(F.min("key").alias("key")).select("key")
    return saved(salted_join(members, first, ["key"], ["node"]))


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, node, component, main, whole, odd) of buckets that lie in several components.

    ``main`` is the bucket's largest component, ``whole`` the load of its members and ``odd`` that of those outside it.
    """
    labelled = buckets.where("size > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = labelled.groupBy("key", "size", "component").agg(F.count("*").alias("here"), F.sum("load").alias("load"))
    most = F.max_by(F.struct("component", "here", "load"), F.struct("here", -F.col("component"))).alias("most")
    mains = counts.groupBy("key", "size").agg(most, F.sum("load").alias("whole")).where("most.here < size")
    mains = mains.select("key", F.col("most.component").alias("main"), "whole", (F.col("whole") - F.col("most.load")).alias("odd"))
    return saved(salted_join(labelled.select("key", "node", "component"), mains, ["key"], ["node"]))


def _near(apart: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, of_b: b's component, gap) of a bucket's odd members and its members of other components that sketches do not refute."""
    grid = ["key", "a_block", "b_block"]

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        blocks = {"a": F.ceil(F.col("odd") / BLOCK).cast("int"), "b": F.ceil(F.col("whole") / BLOCK).cast("int")}
        dealt = rows.select("key", "node", "component", F.pmod(F.xxhash64("node"), blocks[own]).cast("int").alias(f"{own}_block"), F.explode(F.sequence(F.lit(0), blocks[other] - 1)).alias(f"{other}_block"))
        found = dealt.join(held.select("node", "n", "bits"), "node")
        return found.toDF(*found.columns)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int]] = []
        for length, rows in right.groupby(right["bits"].str.len()):
            many = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(-1, length // 8)
            nodes, sizes, of = (rows[c].to_numpy() for c in ("node", "n", "component"))
            for a, own, n, bits in zip(left["node"], left["component"], left["n"], left["bits"], strict=True):
                fits = np.flatnonzero((of != own) & (100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)))
                if len(fits):
                    gaps = _gaps(np.frombuffer(bits, np.uint64), n, many[fits], sizes[fits], percent)
                    found += [(a, nodes[k], of[k], g) for k, g in zip(fits[gaps >= 0], gaps[gaps >= 0], strict=True)]
        return pd.DataFrame(found, columns=["a", "b", "of_b", "gap"], dtype="int64")

    left, right = spread(apart.where("component != main"), "a", "b").groupBy(*grid), spread(apart, "b", "a").groupBy(*grid)
    pairs = left.cogroup(right).applyInPandas(compare, "a long, b long, of_b long, gap long")
    return pairs.groupBy("a", "b").agg(F.first("of_b").alias("of_b"), F.min("gap").alias("gap"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further links; nodes that they leave out are components of their own."""
    if links.isEmpty():
        return labels
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    known = saved(labels.union(nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))))
    edges = links.select("a", "b")
    for side, other in (("a", "b"), ("b", "a")):
        edges = salted_join(edges, known.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), [side], [other])
    merged = connected(edges.select("of_a", "of_b").distinct(), "of_a", "of_b").select(F.col("id").alias("component"), F.col("component").alias("least"))
    return saved(salted_join(known, merged, ["component"], ["node"], "left").select("node", F.coalesce("least", "component").alias("component")))


def labelled(docs: DataFrame, classes: DataFrame, total: int, size: int, percent: int, key: str, text: str) -> DataFrame:
    """``node`` and ``component`` of the nodes that link with another."""
    spark, partitions = docs.sparkSession, math.ceil(total / _DOCUMENTS)
    # Each plan below is one job; adaptive ones would be a job, a thread and a new plan for each of their shuffles.
    with fixed_plans(spark, partitions):
        buckets = _buckets(classes)
        central = buckets.groupBy("node").agg(F.sum("size").alias("central"))
        pivots = buckets.join(central, "node").groupBy("key").agg(F.max_by("node", F.struct("central", -F.col("node"))).alias("a"))
        stars = salted_join(buckets, pivots, ["key"], ["node"]).where("node != a").select("a", F.col("node").alias("b"))
        stars = saved(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        held = saved(_held(docs, classes.join(buckets.select("node").distinct(), "node", "left_semi"), total, size, key, text))
        links = saved(_confirmed(saved(_possible(stars, held, percent)), held, size, percent))
        labels = saved(connected(links).withColumnRenamed("id", "node"))
        apart = _apart(buckets, labels)
        if apart.isEmpty():
            return labels
    near = saved(_near(apart, held, percent))
    let_go(spark)
    with fixed_plans(spark, partitions):
        likeliest = saved(near.groupBy("a", "of_b").agg(F.min_by("b", F.struct("gap", "b")).alias("b")).select("a", "b"))
        labels = _relabelled(labels, saved(_confirmed(likeliest, held, size, percent)))
        rest = near.select("a", "b").join(likeliest, ["a", "b"], "left_anti")
        for side, other in (("a", "b"), ("b", "a")):
            rest = salted_join(rest, labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), [side], [other], "left")
        rest = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = saved(rest)
        return labels if rest.isEmpty() else _relabelled(labels, saved(_confirmed(rest, held, size, percent)))


@tidy
def groups(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document of ``docs``: id, t (a hash of its text), n_shingles, component_id (the smallest id of its group) and kept.

    ``kept`` marks rows whose id is the component's; ``chosen`` those that also have the text with the least hash
    among the group's rows of that id.  Rows without words are groups of their own.
    """
    small_batches(docs.sparkSession)
    signs = saved(signed(docs, size, bands_for(percent / 100), key, text))
    order = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "t")
    classes = signs.where("n > 0").groupBy("class_a", "class_b").agg(F.min_by(F.struct("id", "t", "n", "bands"), order).alias("least"), F.count("*").alias("rows"))
    classes = saved(classes.select("class_a", "class_b", "least.*", "rows", F.monotonically_increasing_id().alias("node")))
    labels = labelled(docs, classes, signs.count(), size, percent, key, text)

    linked = saved(labels.join(classes.select("node", "id", "t", "class_a", "class_b"), "node"))
    firsts = linked.groupBy("component").agg(F.min_by(F.struct("id", "t"), order).alias("first"))
    of_group = salted_join(linked, firsts, ["component"], ["node"]).select("class_a", "class_b", "first")
    alone = classes.join(labels.select("node"), "node", "left_anti").select("class_a", "class_b", F.struct("id", "t").alias("first"))
    rows = signs.select("id", "t", "n", "class_a", "class_b")
    found = salted_join(rows.where("n > 0"), of_group.union(alone), ["class_a", "class_b"], ["id", "t"])
    found = found.union(rows.where("n = 0").select("class_a", "class_b", "id", "t", "n", F.struct("id", "t").alias("first")).select(*found.columns))
    kept = F.col("id").eqNullSafe(F.col("first.id"))
    return found.select("id", "t", F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), kept.alias("kept"), (kept & (F.col("t") == F.col("first.t"))).alias("chosen"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: groups of ``documents`` linked at a Jaccard of 0.85 or more on three-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs, size=3, percent=85).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")

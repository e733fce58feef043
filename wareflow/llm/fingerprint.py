"""Document fingerprints by one-permutation MinHash, in DataFrame expressions alone.

A text's word shingles are hashed once.  The top bits of a hash choose one of ``BINS`` bins, and each bin keeps its
least hash.  An empty bin takes the value of the filled bin that a universal hash of (empty bin, filled bin) puts
first: that is optimal densification, probing bins in a random order of the empty bin's own until one is filled.
A fingerprint packs the low ``BITS`` bits of every bin as hexadecimal digits.  The share of equal bins, corrected
for the 1 / 2**BITS of them that agree by chance, estimates the Jaccard of the shingle sets.

Defined cases: null texts count as empty; texts without words have the empty fingerprint, which is wholly like
another empty one and not at all like others; with fewer words than a shingle the whole sequence is one shingle.
Equal texts have equal fingerprints.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wareflow.llm.native import let

BINS, BITS, SHINGLE = 128, 8, 5
_SHIFT = 64 - (BINS.bit_length() - 1)
_REST = (1 << _SHIFT) - 1
#: Larger than any hash of its bin; stands for an empty one.
_EMPTY = [((b << _SHIFT | _REST) ^ (1 << 63)) - (1 << 63) for b in range(BINS)]


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, _SHIFT)


def _hashes(text: Column) -> Column:
    """One hash a shingle."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def each(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        long = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(long)

    return let(words, each)


def _densified(bins: Column) -> Column:
    filled = F.filter(bins, lambda h: h.bitwiseAND(F.lit(_REST)) != _REST)

    def fill(full: Column) -> Column:
        def borrowed(h: Column) -> Column:
            return F.array_min(F.transform(full, lambda g: F.struct(F.xxhash64(_bin(h), _bin(g)).alias("rank"), g.alias("h"))))["h"]

        return F.when(F.size(full) == BINS, bins).otherwise(F.transform(bins, lambda h: F.when(h.bitwiseAND(F.lit(_REST)) == _REST, borrowed(h)).otherwise(h)))

    return let(filled, fill)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text column."""
    empty = F.array(*[F.lit(e) for e in _EMPTY])

    def packed(hashes: Column) -> Column:
        # With the empty marks among them, sorted hashes have a first one of every bin.
        ordered = F.sort_array(F.concat(hashes, empty))
        bins = let(ordered, lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, F.greatest(i - 1, F.lit(0)))))))
        low = F.transform(let(bins, _densified), lambda h: F.right(F.hex(h.bitwiseAND(F.lit((1 << BITS) - 1)) + (1 << BITS)), F.lit(BITS // 4)))
        return F.when(F.size(hashes) == 0, "").otherwise(F.lower(F.array_join(low, "")))

    return let(_hashes(F.coalesce(text, F.lit(""))), packed)


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard of two fingerprints, 0 to 1."""
    digits = BITS // 4
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits))))
    chance = 1 / (1 << BITS)
    estimate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (equal / BINS - chance) / (1 - chance)))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(estimate)


def _over(bounds: list[int], key: Column) -> Column:
    """How many of the descending bounds are over the key; by steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    firsts, every = (F.array(*[F.lit(b) for b in x]) for x in (bounds[::step], bounds))
    coarse = F.size(F.filter(firsts, lambda b: b > key))
    # The last step whose first bound is over the key is gone through.
    rest = F.slice(every, F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(rest, lambda b: b > key)))


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", ties: list[str] | None = None) -> DataFrame:
    """``docs`` with next_<column> of the row that follows in descending order of the key; the first follows the last.

    Rows go to ranges of about equal size, by bounds from a quantile sketch of the key; a key that takes up several
    ranges is dealt over them by a hash of the row.  The head row of a range is also sent to the one before it, so
    that each range has what follows its last row.  Rows of one key follow each other by that hash, which is of the
    columns, or of ``ties``; null keys come last.
    """
    spark = docs.sparkSession
    # Several ranges a shuffle partition, as they are dealt out by hash; that number grows with the cluster's setting.
    parts = max(2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    # What the window reads stands beside the row: fields of a struct would be sent twice.
    others, sent = [c for c in docs.columns if c not in columns], {c: f"c{i}" for i, c in enumerate(columns)}
    plain = docs.select(F.struct(F.lit(0).alias("none"), *others).alias("row"), *[F.col(c).alias(n) for c, n in sent.items()], place.alias("key"), F.xxhash64(*(ties or columns)).alias("hash"))
    cuts = plain.approxQuantile("key", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    bounds = sorted((int(c) for c in cuts), reverse=True)
    at = {b: (bounds.index(b), bounds.count(b)) for b in {b for b, c in Counter(bounds).items() if c > 1}}
    part = _over(sorted(set(bounds), reverse=True), F.col("key"))
    if at:
        # Keys with several equal bounds: where their ranges start, and how many there are.
        keys = F.map_from_arrays(F.array(*[F.lit(k) for k in at]), F.array(*[F.lit(n) for _, n in at.values()]))
        share = F.col("hash") / F.lit(2.0**64) + F.lit(0.5)
        split = F.least(F.floor(share * keys[F.col("key")]).cast("int"), keys[F.col("key")] - 1)
        part = F.struct(part.alias("a"), F.coalesce(split, F.lit(0)).alias("b"))
    else:
        part = F.struct(part.alias("a"), F.lit(0).alias("b"))
    rows = plain.withColumn("part", part)
    # Descending keys and then rising hashes: the head has the largest (key, -hash).
    found = rows.groupBy("part").agg(F.max(F.struct("key", F.bitwise_not("hash").alias("turned"))).alias("head")).collect()
    heads = sorted((tuple(r["part"]), tuple(r["head"])) for r in found)
    number = {p: i for i, (p, _) in enumerate(heads)}
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    width = max(b for (_, b), _ in heads) + 1
    of = F.map_from_arrays(F.array(*[F.lit(a * width + b) for (a, b), _ in heads]), F.array(*[F.lit(i) for i in number.values()]))
    rows = rows.withColumn("to", of[F.col("part.a") * width + F.col("part.b")])
    keys, turned = (F.get(F.array(*[F.lit(h[k]) for _, h in heads]), F.col("to")) for k in (0, 1))
    is_head = (F.col("key") == keys) & (F.bitwise_not("hash") == turned)
    own = F.struct("to", F.lit(False).alias("wraps"), F.lit(False).alias("copied"))
    # The first range's head follows the last range's rows, whatever its key.
    copy = F.struct(F.pmod(F.col("to") - 1, F.lit(len(heads))).alias("to"), (F.col("to") == 0).alias("wraps"), F.lit(True).alias("copied"))
    dealt = rows.select("row", *sent.values(), "key", "hash", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    window = Window.partitionBy("at.to").orderBy("at.wraps", F.desc("key"), "hash", "at.copied")
    beside = dealt.select("row", *sent.values(), "at", *[F.lead(n).over(window).alias(f"next_{n}") for n in sent.values()])
    whole = [(F.col(sent[c]) if c in sent else F.col("row")[c]).alias(c) for c in docs.columns]
    return beside.where(~F.col("at.copied")).select(*whole, *[F.col(f"next_{n}").alias(f"next_{c}") for c, n in sent.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: fingerprints of every text of ``documents``, of its edited text, and their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    # One sort by range carries the text; fingerprints of the edited texts are worked out after it.
    beside = with_next(known, ["text", "fingerprint"], ties=["text"])
    edited = beside.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "fingerprint",
        "next_fingerprint",
        F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)).alias("edited"),
    )
    marked = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return marked.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))}).drop("next_fingerprint")

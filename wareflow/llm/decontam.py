"""Benchmark decontamination by SimHash over item-sized windows.

Texts and benchmark items are words of letters and digits, A-Z lowered.  For each length that items have, the
SimHash of every window of that many words is read off prefix sums.  Fingerprints are cut into ``BLOCKS`` blocks;
two of them within ``RADIUS`` bits have a block within ``RADIUS // BLOCKS`` bits, and items are listed under all
such values of each block, so that the look-up finds every item within the radius.  Candidates are then verified
exactly: the weighted Jaccard of word shingles, a shingle's weight being the times it occurs, must reach the
threshold.

Windows with fewer shingles of items than a window and an item must share cannot pass the verification; a bitmap of the
items' shingles tells where the others are, and only those are fingerprinted.  A text somewhat shorter than an item is one window.
Items are sent to the tasks in blocks of at most about ``BLOCK_WORDS`` words and ``BLOCK_ITEMS`` items, which bounds
an index by about 100 MB.  A larger benchmark takes a pass for each block, whose results are written before the
next block is sent.

Defined cases: null and empty texts match nothing; items without a word are left out; items with fewer words than
a shingle are compared as one shingle.  Repeated rows and repeated items each get their matches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm.shared import saved, shuffled_join, small_batches
from wareflow.llm.words import LOWER, shingles, span_hashes, spans

SHINGLE, PERCENT, RADIUS, BLOCKS = 5, 80, 15, 4
#: Words and items of the benchmark that one broadcast holds, about.
BLOCK_WORDS, BLOCK_ITEMS = 1_000_000, 5_000
_MAP_BITS = 22
#: Windows of a text that are fingerprinted at once, at most.
_STRETCH = 8192

_PARTS = np.ones(256, bool)
_PARTS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


def words_of(text: str | None) -> np.ndarray:
    letters = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    return span_hashes(letters, *spans(letters, _PARTS))


def _signs(words: np.ndarray) -> np.ndarray:
    """For each word, 64 numbers of 1 or -1."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class Items:
    """A block of the benchmark, indexed."""

    ids: list
    sizes: np.ndarray
    prints: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]
    #: By block value: where its items start in ``listed``.
    starts: np.ndarray
    listed: np.ndarray
    #: By shingle size: a bitmap of the hashes that items have, the hashes in order, and of each hash the lengths of the
    #: items that have it: where they start, and the lengths.
    seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items | None:
        kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in rows) if len(w)]
        if not kept:
            return None
        sizes = np.array([len(w) for _, w in kept])
        prints = np.concatenate([_packed(_signs(w).sum(axis=0, dtype=np.int64)[None, :]) for _, w in kept])
        counted = [np.unique(shingles(w, SHINGLE), return_counts=True) for _, w in kept]
        seen = {}
        for size in sorted({min(SHINGLE, int(n)) for n in sizes}):
            own = [(found, n) for (found, _), n in zip(counted, sizes.tolist(), strict=True) if min(SHINGLE, n) == size]
            hashes = np.concatenate([found for found, _ in own])
            every, place = np.unique(hashes, return_inverse=True)
            most = int(sizes.max()) + 1
            of = np.unique(place * most + np.repeat([n for _, n in own], [len(found) for found, _ in own]))
            bitmap = np.zeros(1 << _MAP_BITS, bool)
            bitmap[every >> np.uint64(64 - _MAP_BITS)] = True
            seen[size] = bitmap, every, np.searchsorted(of // most, np.arange(len(every) + 1)), of % most
        width = 64 // BLOCKS
        near = [np.uint64(sum(1 << b for b in flips)) for k in range(RADIUS // BLOCKS + 1) for flips in combinations(range(width), k)]
        keys, listed = [], []
        for block in range(BLOCKS):
            value = prints >> np.uint64(width * block) & np.uint64((1 << width) - 1)
            for flip in near:
                keys.append((value ^ flip).astype(np.int64) + (block << width))
                listed.append(np.arange(len(kept), dtype=np.int32))
        keys, listed = np.concatenate(keys), np.concatenate(listed)
        order = np.argsort(keys, kind="stable")
        starts = np.zeros((BLOCKS << width) + 1, np.int64)
        np.cumsum(np.bincount(keys, minlength=BLOCKS << width), out=starts[1:])
        return cls([i for i, _ in kept], sizes, prints, counted, starts, listed[order], seen)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``prints``, item) within the radius; each once."""
        width, wheres, whats = 64 // BLOCKS, [], []
        for block in range(BLOCKS):
            key = (prints >> np.uint64(width * block) & np.uint64((1 << width) - 1)).astype(np.int64) + (block << width)
            count = self.starts[key + 1] - self.starts[key]
            where = np.repeat(np.arange(len(prints)), count)
            offset = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
            wheres.append(where)
            whats.append(self.listed[self.starts[key][where] + offset])
        where, what = np.concatenate(wheres), np.concatenate(whats)
        close = np.bitwise_count(prints[where] ^ self.prints[what]) <= RADIUS
        pair = np.unique(where[close] * len(self.ids) + what[close])
        return pair // len(self.ids), pair % len(self.ids)

    def likeness(self, window: np.ndarray, item: int) -> float:
        """The weighted Jaccard of a window's shingles and an item's."""
        found, times = np.unique(window, return_counts=True)
        own, weights = self.shingles[item]
        _, a, b = np.intersect1d(found, own, assume_unique=True, return_indices=True)
        shared = int(np.minimum(times[a], weights[b]).sum())
        return shared / (len(window) + int(weights.sum()) - shared)

    def matches(self, text: str | None, percent: int) -> dict[int, tuple[float, int, int]]:
        """By item: the likeness of its best window, the window's first word and its number of words."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        for size, (bitmap, every, starts, lengths) in self.seen.items():
            found = shingles(words, size)
            at = np.flatnonzero(bitmap[found >> np.uint64(64 - _MAP_BITS)])
            place = np.minimum(np.searchsorted(every, found[at]), len(every) - 1)
            real = every[place] == found[at]
            at, place = at[real], place[real]
            if not len(at):
                continue
            count = starts[place + 1] - starts[place]
            of = lengths[np.repeat(starts[place] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            at = np.repeat(at, count)
            for length in np.unique(of).tolist():
                self._of_length(words, at[of == length], size, length, percent, best)
        return best

    def _of_length(self, words: np.ndarray, hits: np.ndarray, size: int, length: int, percent: int, best: dict) -> None:
        """Matches with the items of one length; ``hits`` are the places of their shingles."""
        window = min(length, len(words))
        own, theirs = window - min(size, window) + 1, length - size + 1
        # The shingles that both must share; a window has no more of an item's than there are hits in it.
        least = max(1, -(-percent * (own + theirs) // (100 + percent)))
        if 100 * window < percent * length or len(hits) < least:
            return
        # In time by the hits, not by the text's length: windows that hold ``least`` hits in a row.
        low = np.maximum(hits[least - 1 :] - own + 1, 0)
        high = np.minimum(hits[: len(hits) - least + 1], len(words) - window)
        fits = low <= high
        low, high = low[fits], high[fits]
        # Both ascend, so what is left of a range after those before it begins behind their ends.
        low = np.maximum(low, np.concatenate([[0], high[:-1] + 1])) if len(low) else low
        count = np.maximum(high - low + 1, 0)
        first = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        while len(first):
            some = first[: np.searchsorted(first, first[0] + _STRETCH)]
            gap = np.flatnonzero(np.diff(some) > window)
            some = some[: gap[0] + 1] if len(gap) else some
            first = first[len(some) :]
            at = int(some[0])
            sums = np.zeros((int(some[-1]) + window - at + 1, 64), np.int32)
            np.cumsum(_signs(words[at : int(some[-1]) + window]), axis=0, out=sums[1:])
            where, what = self.within(_packed(sums[some + window - at] - sums[some - at]))
            fits = self.sizes[what] == length
            for s, item in zip(some[where[fits]].tolist(), what[fits].tolist(), strict=True):
                if item in best and best[item][0] == 1:
                    continue
                like = self.likeness(shingles(words[s : s + window], SHINGLE), item)
                if 100 * like >= percent and (item not in best or like > best[item][0]):
                    best[item] = (like, s, window)


def _blocks(items: DataFrame, key: str, text: str):
    """The benchmark as lists of (id, text) of a bounded number of words and items each."""
    rough = F.coalesce(F.length(text), F.lit(0)) / 4
    words, rows = items.agg(F.sum(rough), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil((words or 0) / BLOCK_WORDS), math.ceil(rows / BLOCK_ITEMS))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64(key, text), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r[0], r[1]) for r in part.select(key, text).toLocalIterator()]


_MATCHES = "array<struct<item: bigint, likeness: double, first_word: int, n_words: int>>"


def _against(docs: DataFrame, index: Items, text: str, percent: int) -> Column:
    """The matches of each whole text with a block of the benchmark."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(_MATCHES)
    def find(texts: pa.Array) -> pa.Array:
        index, ends, flat = sent.value, [0], []
        for t in texts:
            flat += [(index.ids[i], *m) for i, m in sorted(index.matches(t.as_py(), percent).items())]
            ends.append(len(flat))
        fields = [pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int32(), pa.int32()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["item", "likeness", "first_word", "n_words"]))

    return find(F.col(text))


def matched(docs: DataFrame, items: DataFrame, text: str = "text", column: str = "matches", percent: int = PERCENT, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``column``: for each item that a text contains, (item, likeness, first_word, n_words)."""
    small_batches(docs.sparkSession)
    blocks = _blocks(items, item_key, item_text)
    indexes = (index for index in map(Items.of, blocks) if index is not None)
    first = next(indexes, None)
    if first is None:
        return docs.withColumn(column, F.array().cast(_MATCHES))
    second = next(indexes, None)
    if second is None:
        return docs.withColumn(column, _against(docs, first, text, percent))
    # Several blocks: texts are read once a block, and only what was found is carried on, by the number of the row.
    numbered = saved(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")))
    found = None
    for index in chain((first, second), indexes):
        own = numbered.select("number", _against(numbered, index, f"row.`{text}`", percent).alias("m")).where(F.size("m") > 0)
        # One block's index at a time: what a block found is written before the next one.
        own = saved(own)
        found = own if found is None else found.union(own)
    matches = found.groupBy("number").agg(F.sort_array(F.flatten(F.collect_list("m"))).alias("m"))
    both = shuffled_join(numbered.select("row", "number"), matches, ["number"], "left")
    names = [c for c in docs.columns if c.lower() != column.lower()]
    return both.select(*[F.col("row")[c].alias(c) for c in names], F.coalesce("m", F.array().cast(_MATCHES)).alias(column))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the benchmark items that each text of ``documents`` contains."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    each = found.select("doc_id", F.explode("matches").alias("m"))
    return each.select("doc_id", F.col("m.item").alias("item_id"), F.col("m.likeness").alias("similarity"), F.col("m.first_word").alias("first_word"), F.col("m.n_words").alias("n_words"))

"""Byte-level BPE over rank files as a reduction over a tree: halves are encoded, and neighbours joined.

Encodings of pieces of a word form a monoid: ``joined`` takes those of two neighbours to that of both.  It re-encodes a
window of tokens around the seam and grows the window until the tokens outside are proven to stay.

The proof needs a look at pairs only.  Merging always takes the lowest rank, the leftmost of equals.  Take tokens of
which each two neighbours, merged by themselves, stay those two.  Suppose merging the bytes of all of them crossed
a border between two tokens, and look at the first time that it does.  Until then nothing crossed a border, so what happened
within those two tokens is what happens to them by themselves, in the same order, and the crossing would happen
there too: a contradiction.  So nothing crosses, and the tokens are the encoding.  A window is wide enough, then, when
its first token stays beside the token before it and its last one beside the token after it; otherwise it grows on
the side that fails, twofold, until at the worst it covers everything.

A word that is itself in the vocabulary is that token, whatever merging gives, as in the tiktoken library.  Decoding
concatenates up the tree.

Defined cases: null and empty texts have no tokens and decode to nothing; texts and words of any length are read whole,
a word of n bytes in about n log n steps.  Columns of the input are kept; an output column replaces an input
column of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm.bpe import SPLIT, ByteBpe, _Remembered, packed
from wareflow.llm.shared import small_batches

#: Up to so many bytes are merged at once; longer words are halved.
LEAF = 8
#: Leaves, windows and pairs of up to so many bytes come again and again.
SHORT = 6
#: Up to so many bytes a window is merged by looking through all its pairs; a wider one keeps them in a heap.
NARROW = 96
#: Chunks, short strings and pairs of tokens that a worker remembers, of each so many.
KEPT = 600_000


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; a vocabulary's size bounds it."""
    with open(path, "rb") as f:
        return f.read()


class TreeEncoder:
    """Encodes words by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for bytes {missing}")
        self.ranks, self.kept = ranks, kept
        self.spelled = {i: b for b, i in ranks.items()}
        self.seams: dict[tuple[bytes, bytes], list[bytes] | None] = {}
        self.short: dict[bytes, list[bytes]] = {}

    def encode(self, word: bytes) -> list[int]:
        ranks = self.ranks
        found = ranks.get(word)
        return [found] if found is not None else [ranks[t] for t in self.tree(word)]

    def tree(self, word: bytes) -> list[bytes]:
        """The tokens of ``word``: its halves' tokens, joined."""
        if len(word) <= LEAF:
            return self.merged(word)
        half = len(word) // 2
        return self.joined(self.tree(word[:half]), self.tree(word[half:]))

    def seam(self, a: bytes, b: bytes) -> list[bytes] | None:
        """What two tokens, merged by themselves, become; None where they stay those two."""
        found = self.seams.get((a, b), self)
        if found is self:
            if len(self.seams) >= self.kept:
                self.seams.clear()
            found = self.merged(a + b)
            found = self.seams[a, b] = None if found == [a, b] else found
        return found

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two neighbours together, from the encodings of each."""
        if not left or not right:
            return left + right
        # The first window is a token on each side.
        window, before, after = self.seam(left[-1], right[0]), 1, 1
        if window is None:
            return left + right
        while True:
            first = before == len(left) or self.seam(left[-before - 1], window[0]) is None
            last = after == len(right) or self.seam(window[-1], right[after]) is None
            if first and last:
                return left[:-before] + window + right[after:]
            before, after = (before if first else min(2 * before, len(left))), (after if last else min(2 * after, len(right)))
            window = self.merged(b"".join(left[-before:] + right[:after]))

    def merged(self, word: bytes) -> list[bytes]:
        """Merging from single bytes: the lowest rank first, the leftmost of equals.  What short strings give is remembered."""
        if len(word) > SHORT:
            return self._merged_long(word) if len(word) > NARROW else self._merged_short(word)
        found = self.short.get(word)
        if found is None:
            if len(self.short) >= self.kept:
                self.short.clear()
            found = self.short[word] = self._merged_short(word)
        return found

    def _merged_short(self, word: bytes) -> list[bytes]:
        get = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        over = 1 << 62
        ranks = [get(word[i : i + 2], over) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == over:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], over)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], over)
        return parts

    def _merged_long(self, word: bytes) -> list[bytes]:
        """The same for many bytes: pairs wait in a heap by rank and place."""
        n, get = len(word), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        pairs = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := get(word[i : i + 2])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, middle, end = heapq.heappop(pairs)
            # A pair that one of its tokens has left since.
            if ends[i] != middle or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, -1
            if end < n:
                before[end] = i
                if (rank := get(word[i : ends[end]])) is not None:
                    heapq.heappush(pairs, (rank, i, end, ends[end]))
            if (j := before[i]) >= 0 and (rank := get(word[j:end])) is not None:
                heapq.heappush(pairs, (rank, j, i, end))
        found, at = [], 0
        while at < n:
            found.append(word[at : ends[at]])
            at = ends[at]
        return found


class RankBpe(ByteBpe):
    """A rank file with its splitter: texts are cut into words and words encoded by the tree."""

    def __init__(self, ranks: bytes, kept: int = KEPT):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.machine = TreeEncoder(table, kept)
        self.added, self.cut = {}, None
        spelled = [self.machine.spelled.get(i, b"") for i in range(max(table.values()) + 1)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.size_of = np.array([len(b) for b in spelled], np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.words = regex.compile(SPLIT)
        self.chunks = _Remembered(self.after_space, kept)
        self.cores = _Remembered(lambda core: packed(self.machine.encode(b" " + core.encode())), kept // 2)
        self.marks = _Remembered(self.plain, 4096)

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``: the halves' bytes, one after the other."""
        if len(ids) > 1 << 16:
            half = len(ids) // 2
            return self.spell(ids[:half]) + self.spell(ids[half:])
        size = self.size_of[ids]
        ends = np.cumsum(size)
        return self.spelled[np.repeat(self.start_of[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes() if len(ids) else b""


_compiled: dict[str, RankBpe] = {}


def compiled(ranks: bytes, kept: int) -> RankBpe:
    """The tokenizer, once a worker."""
    key = f"{kept} {hashlib.sha256(ranks).hexdigest()}"
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = RankBpe(ranks, kept)
    return _compiled[key]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", kept: int = KEPT) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int): the token ids of the whole ``text``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("array<int>")
    def to_ids(texts: pa.Array) -> pa.Array:
        bpe = compiled(sent.value, kept)
        found = [bpe.encode(t.as_py()) for t in texts]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
        values = np.concatenate(found) if found else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

    return docs.withColumn(ids, to_ids(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", spelled: str = "decoded", kept: int = KEPT) -> DataFrame:
    """``docs`` with the column ``spelled`` (binary): the bytes of ``ids``; null ids spell nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def to_bytes(lists: pa.Array) -> pa.Array:
        bpe = compiled(sent.value, kept)
        values, out, at = lists.flatten().to_numpy(zero_copy_only=False), [], 0
        for n in lists.value_lengths().to_pylist():
            out.append(bpe.spell(values[at : at + (n or 0)]))
            at += n or 0
        return pa.array(out, pa.binary())

    return docs.withColumn(spelled, to_bytes(F.col(ids)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: encodes every text of ``documents`` and decodes the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = default_path()
    both = decode(encode(docs, path), path).select("doc_id", "ids", "decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

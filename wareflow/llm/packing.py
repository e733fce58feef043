"""Token ids packed into rows of fixed width by best-fit decreasing.

Each task packs its documents in blocks of about ``BLOCK_TOKENS`` tokens, so memory is bounded and nothing is
shuffled; a block is packed by itself.  Documents longer than a row are split into pieces that fill rows, the last
one excepted, and lose nothing.  Pieces go in order of falling length to the row with the least room that
suffices; a segment tree over the room left finds it in logarithmic time.

A packed row has the ids as little-endian uint16 or uint32 (by vocabulary), padded to the width; the cumulative
lengths of its segments; the offsets where positions start anew; and for each segment its document and the number
of the piece.  Documents without tokens (null and empty texts) are segments of length zero, so each document is
found in some row.  Repeated rows are packed each time they occur.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 2048
BLOCK_TOKENS = 4_000_000

SCHEMA = "shard int, block int, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"


class RoomTree:
    """Rows by the room left in them; finds the least room that suffices."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a row with the least room of ``least`` or more; (room, row), None if there is none."""
        node = self.leaves + least
        if not self.count[node]:
            # Up until a right sibling has rows, then down its leftmost ones.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self._change(room, -1)
        return room, row


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """The pieces of each row, by their numbers; equal lengths keep their order."""
    tree, rows = RoomTree(width), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        room, row = tree.take(n) or (width, -1)
        if row < 0:
            row = len(rows)
            rows.append([])
        rows[row].append(piece)
        tree.add(room - n, row)
    return rows


def pack(documents: list[tuple[int | None, np.ndarray]], width: int, kind: np.dtype) -> Iterator[dict]:
    """The packed rows of a block of documents."""
    pieces = [(doc, part, ids[at : at + width]) for doc, ids in documents for part, at in enumerate(range(0, max(1, len(ids)), width))]
    for row in best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), width):
        held = [pieces[p] for p in row]
        ends = np.cumsum([0, *(len(ids) for _, _, ids in held)])
        flat = np.zeros(width, kind)
        flat[: ends[-1]] = np.concatenate([ids for _, _, ids in held])
        yield {"n_tokens": int(ends[-1]), "ids": flat.tobytes(), "cu_seqlens": ends.tolist(), "position_resets": ends[:-1].tolist(), "doc_ids": [d for d, _, _ in held], "pieces": [p for _, p, _ in held]}


_encoders: dict[int, object] = {}


def _encoder(ranks: str):
    import public_tokenizers
    import tiktoken

    if hash(ranks) not in _encoders:
        pairs = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[hash(ranks)] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
    return _encoders[hash(ranks)]


def packed(docs: DataFrame, ranks_path: str, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed rows of ``docs``, tokens being those of a rank file; shard is the number of the task."""
    with open(ranks_path, encoding="ascii") as f:
        ranks = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = np.dtype("<u2" if ranks.count("\n") < 65_500 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(sent.value), TaskContext.get().partitionId()
        block, waiting, tokens = 0, [], 0
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])

        def full() -> Iterator[pa.RecordBatch]:
            rows = [{"shard": shard, "block": block, "row": r} | x for r, x in enumerate(pack(waiting, width, kind))]
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_pylist(rows[at : at + 1024], schema)

        for batch in batches:
            for doc, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array(encoder.encode_ordinary(t.as_py() or ""), kind)
                waiting.append((doc.as_py(), ids))
                tokens += len(ids)
                if tokens >= block_tokens or len(waiting) >= block_tokens // 16:
                    yield from full()
                    block, waiting, tokens = block + 1, [], 0
        if waiting:
            yield from full()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def unpacked(row, kind: str = "<u2") -> list[tuple[int | None, int, np.ndarray]]:
    """(document, piece, ids) of each segment of a packed row."""
    ids = np.frombuffer(row["ids"], kind)
    ends = row["cu_seqlens"]
    return [(d, p, ids[a:b]) for d, p, a, b in zip(row["doc_ids"], row["pieces"], ends[:-1], ends[1:], strict=True)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the tokens of ``documents`` packed into rows of 2048."""
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

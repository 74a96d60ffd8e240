"""Cost-balanced packing of tokenized documents into sequences of bounded length.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``: what its dense layers and its attention
take. Pieces are assigned in descending length, each to the sequence of the lowest cost so far that still has
room for it. A document longer than a sequence first fills whole sequences. When no sequence has room
for a piece, the one with the most room takes what fits and the rest is assigned again. Packing
works on shards: runs of a task's documents with about ``shard_tokens`` tokens. The capacities of a shard's sequences add up
to its tokens: whole sequences, and powers of two for the last part, so nothing is padded.

Null and empty texts are documents of one token, the end id. Repeated rows are packed each on its own. An empty
table gives no rows. No column but the id and the text is read, so others may have any name.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECES, encoder, tidy, tokenizer_path, whole_text

CAPACITY = 2048
SHARD_TOKENS = 1 << 21
#: Per token; the second is per pair of tokens, for a model 1,024 wide.
LINEAR, QUADRATIC = 1.0, 1 / 12288
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) and the tokens of each sequence."""
    pieces, used, left, cost = [], [], [], []
    todo: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, len(used), 0))
            used.append(capacity)
            left.append(0)
            cost.append(0.0)
        if n % capacity:
            todo.append((-(n % capacity), doc, whole * capacity))
    total = -sum(x[0] for x in todo)
    bins = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    first = len(used)
    for room in bins:
        used.append(0)
        left.append(room)
        cost.append(0.0)
    ready = [(0.0, s) for s in range(first, len(used))]
    parked: list[tuple[int, int]] = []  # with less room than the last piece that they were offered
    heapq.heapify(todo)
    while todo:
        n, doc, start = heapq.heappop(todo)
        n = -n
        while parked and -parked[0][0] >= n:
            s = heapq.heappop(parked)[1]
            heapq.heappush(ready, (cost[s], s))
        while ready and left[ready[0][1]] < n:
            s = heapq.heappop(ready)[1]
            heapq.heappush(parked, (-left[s], s))
        if ready:
            s, put = heapq.heappop(ready)[1], n
        else:
            s = heapq.heappop(parked)[1]
            put = left[s]
            heapq.heappush(todo, (put - n, doc, start + put))
        pieces.append((doc, start, put, s, used[s]))
        used[s] += put
        left[s] -= put
        cost[s] += linear * put + quadratic * put * put
        if left[s]:
            heapq.heappush(ready, (cost[s], s))
    return pieces, used


def _shard(ids: list[tuple[int | None, bytes]], first: int, capacity: int, linear: float, quadratic: float) -> tuple[pa.RecordBatch, int]:
    pieces, used = pack([len(x) // 4 for _, x in ids], capacity, linear, quadratic)
    crc = [zlib.crc32(memoryview(ids[d][1])[4 * a : 4 * (a + n)]) for d, a, n, _, _ in pieces]
    doc, start, length, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
    tokens = np.array([len(x) // 4 for _, x in ids], dtype=np.int64)
    out = {
        "doc_id": pa.array([ids[d][0] for d in doc], pa.int64()), "start": start, "length": length, "ids_crc32": np.array(crc, dtype=np.int64),
        "doc_tokens": tokens[doc], "sequence_id": seq + first, "offset": offset, "sequence_tokens": np.array(used, dtype=np.int64)[seq],
    }
    return pa.RecordBatch.from_pydict({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in out.items()}), first + len(used)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY,
    shard_tokens: int = SHARD_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, pieces: int = PIECES,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the crc32 of its ids."""
    path = tokenizer or tokenizer_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, pieces), np.array([end_id], dtype="<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size, seq = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                held.append((key, ids + end))
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    out, seq = _shard(held, seq, capacity, linear, quadratic)
                    held, size = [], 0
                    yield out
        if held:
            yield _shard(held, seq, capacity, linear, quadratic)[0]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(tidy(work), SCHEMA)

"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates lie in blocks. In each block every dimension has a sorted list of its values; a query reads the lists of its nonzero components in step, each from the end that suits
the component's sign. Rows met in any list are scored whole. No row that is still unread after ``t`` steps can score more than the query's product with the
values at step ``t``; once that bound is below the kth score so far the rest of the block is out (a bound equal to it is not enough, as ties go by id). Steps are read in
rounds, each up to four times as deep, or to the depth at which the bound falls below the kth score of now. A query without a nonzero component has no list, and
reads all rows. Where vectors spread alike over many dimensions, lists are read far before the bound falls, and most rows are met.

Every pair of a block of queries and a block of candidates is a task's row, so the work grows as queries times rows, and no task holds
more than one such pair. Vectors that are null or have a null or non-finite component take no part. Shorter vectors count as zero beyond their end. A row never
matches its own id, repeated ids included; of a repeated query id the least vector asks. Fewer candidates than k: all of them. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

K = 20
QUERY_BLOCK, ROW_BLOCK, FIRST, GRID = 1024, 8192, 16, 32
SCHEMA = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(fine & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _blocks(rows: DataFrame, size: int, tag: str) -> tuple[DataFrame, int]:
    """One row per block: number, ids and vectors as bytes."""
    n = max(1, -(-rows.count() // size))

    def pack(t: pa.Table) -> pa.Table:
        v = t.column("v").to_pylist()
        width = max(map(len, v), default=0)
        a = np.array([x + [0] * (width - len(x)) for x in v], np.int64).reshape(len(v), width)
        return pa.table({"block": t.column("block")[:1], "ids": pa.array([np.array(t.column("vec_id"), np.int64).tobytes()], pa.binary()), "width": pa.array([width], pa.int64()), "vectors": pa.array([a.tobytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long"))
    names = {"block": f"{tag}_block", "ids": f"{tag}_ids", "width": f"{tag}_width", "vectors": f"{tag}_vectors"}
    return dealt.groupBy("block").applyInArrow(pack, "block long, ids binary, width long, vectors binary").withColumnsRenamed(names), n


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k highest scores' places, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def read_lists(q: np.ndarray, own: int, c: np.ndarray, c_ids: np.ndarray, order: np.ndarray, bounds: np.ndarray, steps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows met, their scores, steps read) for one query. ``order`` has for each dimension the rows from the least value up, ``bounds`` the bound after each of ``steps``."""
    n = len(c)
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    if not len(up) + len(down):
        return np.arange(n), np.zeros(n, c.dtype), n
    met, scores, kth = np.zeros(n, bool), np.zeros(n, c.dtype), -np.inf
    done, upto = 0, min(n, FIRST)
    while True:
        before = met.copy()
        met[order[up, n - upto : n - done].ravel()] = True
        met[order[down, done:upto].ravel()] = True
        new = np.flatnonzero(met & ~before)
        scores[new] = c[new] @ q if 4 * len(new) < n else (c @ q)[new]
        done = upto
        rival = scores[met & (c_ids != own)]
        if len(rival) >= k:
            kth = np.partition(rival, len(rival) - k)[len(rival) - k]
        below = steps[bounds < kth]
        if done == n or (len(below) and below[0] <= done):
            rows = np.flatnonzero(met)
            return rows, scores[rows], done
        upto = min(n, 4 * done, int(below[0]) if len(below) else n)


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int = K, read: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, score) of each query's best k in one block. ``read`` takes the rows scored and the steps read of each query."""
    n, d = c.shape
    if not n or not len(q):
        return (np.zeros(0, np.int64),) * 3
    most = int(np.abs(c).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(d, 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    q, c = q.astype(kind), c.astype(kind)
    order = np.argsort(c, axis=0, kind="stable")
    lists = np.take_along_axis(c, order, 0)
    steps = np.unique(np.r_[np.arange(FIRST, n, GRID), n])
    bounds = lists[n - steps] @ np.maximum(q, 0).T + lists[steps - 1] @ np.minimum(q, 0).T
    order = np.ascontiguousarray(order.T.astype(np.int32))
    out = []
    for j in range(len(q)):
        rows, scores, depth = read_lists(q[j], q_ids[j], c, c_ids, order, bounds[:, j], steps, k)
        if read is not None:
            read.append((len(rows), depth))
        ok = np.flatnonzero(c_ids[rows] != q_ids[j])
        pick = ok[_best(scores[ok], c_ids[rows[ok]], k)]
        out.append((np.full(len(pick), j), rows[pick], scores[pick]))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def search(df: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all rows."""
    rows = quantised(df, id_col, vec_col, scale)
    queries, _ = _blocks(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), query_block, "q")
    blocks, n = _blocks(rows, row_block, "c")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                q, c = np.frombuffer(r["q_vectors"], np.int64).reshape(len(q_ids), -1), np.frombuffer(r["c_vectors"], np.int64).reshape(len(c_ids), -1)
                width = min(q.shape[1], c.shape[1])
                i, j, s = search_block(q[:, :width], q_ids, c[:, :width], c_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(c_ids[j]), pa.array(s)], ["query_id", "vec_id", "score"])

    pairs = queries.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("c_block", F.col("c_block").cast("long"))
    pairs = pairs.join(blocks, "c_block").repartition("q_block", "c_block").select("q_ids", "q_vectors", "c_ids", "c_vectors")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.mapInArrow(tidy(work), SCHEMA).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

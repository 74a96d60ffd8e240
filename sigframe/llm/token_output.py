"""Token ids in Simple-8b files, in ascending document order.

A file is a Parquet table in the shared folder; its rows are segments of a shard: whole documents with about
``SEGMENT_IDS`` ids, as 64-bit words with the place of each block's first word. Shards are the tasks of a range partitioning by document
(and, where many rows share an id, by a hash of the text, and where they share that too, by their place in the input), so shard number, segment number and place in the segment give the place of an id among all ids.

Null and empty texts are documents with only the end id. A null document id comes first. Repeated rows are written
each on its own, ordered by the text's hash where the ids tie. An empty table gives files without segments. No column but the id and the text is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import PIECES, encoder, shared_dir, tidy, tokenizer_path, whole_text

SEGMENT_IDS = 1 << 18
FILE_SCHEMA = "shard int, segment int, shard_start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, block_words array<int>, words binary"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _segment(shard: int, number: int, start: int, keys: list, ids: list[bytes]) -> tuple[pa.RecordBatch, int]:
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    words, offsets = simple8b.encode(flat.astype(np.uint64))
    out = pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()), "shard_start": pa.array([start], pa.int64()),
        "n_ids": pa.array([len(flat)], pa.int64()), "doc_ids": pa.array([keys], pa.list_(pa.int64())),
        "doc_tokens": pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64())), "block_words": pa.array([offsets], pa.list_(pa.int32())),
        "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
    })
    return out, start + len(flat)


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> None:
    """Writes the ids of every document, each with ``end_id`` after it."""
    vocabulary = tokenizer or tokenizer_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, PIECES), np.array([end_id], dtype="<u4").tobytes()
        shard, number, start, size = TaskContext.get().partitionId(), 0, 0, 0
        keys, held = [], []
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                keys.append(key)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SEGMENT_IDS:
                    out, start = _segment(shard, number, start, keys, held)
                    keys, held, size, number = [], [], 0, number + 1
                    yield out
        if held:
            yield _segment(shard, number, start, keys, held)[0]

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    rows.mapInArrow(tidy(work), FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document its place, length and the crc32 of its ids, read from the files; with the ids themselves if asked for."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per shard, so as many as the range partitioning had tasks: spark.sql.shuffle.partitions at most, however many documents.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = simple8b.decode(np.frombuffer(row["words"], dtype="<u8"), np.array(row["block_words"], dtype=np.int64), row["n_ids"])
                raw = memoryview(ids.astype("<u4").tobytes())
                n = np.array(row["doc_tokens"], dtype=np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at, n, strict=True)]
                out = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(at + row["base"] + row["shard_start"]), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([ids[a : a + k].astype(np.int64) for a, k in zip(at, n, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    rows = files.join(F.broadcast(bases), "shard").select("base", "shard_start", "n_ids", "doc_ids", "doc_tokens", "block_words", "words")
    return rows.mapInArrow(tidy(work), SCHEMA + (", ids array<long>" if with_ids else ""))


def token_output(docs: DataFrame, **options: str | int) -> DataFrame:
    """Writes the files to a new place in the shared folder and reads them back."""
    path = f"{shared_dir(docs.sparkSession)}/ids"
    write_ids(docs, path, **options)
    return read_ids(docs.sparkSession, path)

"""A blocked Bloom filter as a table: a row of eight 32-bit words for each block, one bit in each word for a key.

Spark builds it over any number of keys. It has ``MAX_BLOCKS`` blocks of 32 bytes at most, whatever the number of keys, so it can be broadcast; a filter
that is too full lets more through, and never loses a key. Null keys are never listed, and never possible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_PER_BLOCK, MAX_BLOCKS = 16, 1 << 19


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * w).bitwiseAND(F.lit(31)).cast("int")) for w in range(8)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def blocks_for(keys: int) -> int:
    blocks = 1
    while blocks * KEYS_PER_BLOCK < keys and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocks


def table(keys: DataFrame, blocks: int) -> DataFrame:
    """(_block, _w0.._w7) of a column ``key``."""
    marked = keys.where("key IS NOT NULL").select(_block(F.col("key"), blocks).alias("_block"), *[b.alias(f"_w{w}") for w, b in enumerate(_bits(F.col("key")))])
    return marked.groupBy("_block").agg(*[F.bit_or(f"_w{w}").alias(f"_w{w}") for w in range(8)])


def marked(asked: DataFrame, key: Column, listed: DataFrame, name: str) -> DataFrame:
    """``asked`` with the column ``name``: whether ``key`` may be among the keys of ``listed`` (a column ``key``). Rows stay where they are."""
    blocks = blocks_for(listed.count())
    rows = asked.withColumn("_key", key).withColumn("_block", _block(F.col("_key"), blocks))
    rows = rows.join(F.broadcast(table(listed, blocks)), "_block", "left")
    hit = reduce(Column.__and__, [F.col(f"_w{w}").bitwiseAND(bit) == bit for w, bit in enumerate(_bits(F.col("_key")))])
    return rows.select(*[F.col(c) for c in asked.columns], F.coalesce(hit, F.lit(False)).alias(name))


def possible(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``asked`` whose ``key`` may be among the keys of ``listed``."""
    return marked(asked, F.col("key"), listed, "_possible").where("_possible").drop("_possible")

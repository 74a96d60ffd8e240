"""Logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits, and runs of other marks. Features are the hashes of tokens, of pairs of neighbours, and of pairs reduced to
shapes (case, digits, the marks themselves, and whether a token returns one or two places on); each family is a vector of relative frequencies,
so a score is the dot product of the weights with a sparse vector, plus a bias.

Training takes at most ``bound`` labelled texts (picked by a hash of the id) in ``shards`` tasks; each makes ``passes`` over its own
and the models are averaged. The held-out fifth (crc32 of the id's text divisible by 5) is never learnt from. Without texts of
both labels every score is 0.5 (empty model). Null and empty texts have no features and get the bias alone. Conflicting
labels of one id count as the lower one; null labels are left out. Repeated rows are scored each on its own. An empty table gives no rows. Of
the documents only id and text are read, and the id does not enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, tidy, whole_text

DIMENSIONS = 1 << 18
BOUND, SHARDS, PASSES = 20_000, 4, 8
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.02, 0.0
CUT = 0.3
PART = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x100000001B3
_UP, _DOWN = _powers(_BASE, PART + 64), _powers(pow(_BASE, -1, 1 << 64), PART + 64)
_KIND = np.full(256, 2, np.uint8)  # 0: white space, 1: letter or digit, 2: other mark
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER, _LOWER, _DIGIT = (np.zeros(256, np.int32) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape of each token."""
    kind = _KIND[data]
    edge = np.flatnonzero(np.diff(kind)) + 1
    start = np.r_[0, edge]
    end = np.r_[edge, len(data)]
    real = kind[start] > 0
    start, end = start[real], end[real]
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], dtype=np.uint64)]
    token = _mix((sums[end] - sums[start]) * _DOWN[start])
    upper, lower, digit = (np.r_[0, np.cumsum(t[data], dtype=np.int32)] for t in (_UPPER, _LOWER, _DIGIT))
    up, low, num = upper[end] - upper[start], lower[end] - lower[start], digit[end] - digit[start]
    shape = np.where(num == end - start, 5, np.where(num > 0, 4, np.where((up > 1) & (low == 0), 3, np.where(_UPPER[data[start]] == 1, 2, 1)))).astype(np.uint64)
    return token, np.where(kind[start] == 2, token, shape)


def _families(data: bytes, dimensions: int) -> list[np.ndarray]:
    """The features of a part of a text: indices with repeats, by family."""
    token, shape = _tokens(np.frombuffer(data, np.uint8))
    if not len(token):
        return [np.zeros(0, np.int64)] * 3
    back = np.zeros(len(token), np.uint64)
    back[1:] |= token[1:] == token[:-1]
    back[2:] |= (token[2:] == token[:-2]).astype(np.uint64) << np.uint64(1)
    pair = _mix(token[:-1] * np.uint64(3) + token[1:] * np.uint64(5) + np.uint64(7))
    shapes = _mix(shape[:-1] * np.uint64(11) + shape[1:] * np.uint64(13) + back[1:] * np.uint64(17) + np.uint64(19))
    return [(x % np.uint64(dimensions)).astype(np.int64) for x in (token, pair, shapes)]


def features(text: str, dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """Index arrays of the three families; texts of over a megabyte are taken in parts that end at white space."""
    data = text.encode()
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + PART)
        if end < len(data):
            end = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end)) + 1 or end
            end = end if end > at else at + PART
        parts.append(_families(data[at:end], dimensions))
        at = end
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3


def _sparse(families: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    index, value = [], []
    for f in families:
        if len(f):
            i, n = np.unique(f, return_counts=True)
            index.append(i)
            value.append(n / len(f))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0)
    i, back = np.unique(np.concatenate(index), return_inverse=True)
    return i, np.bincount(back, np.concatenate(value))


def _sigmoid(z: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Weights, the bias last, after so many passes of per-coordinate FTRL over (index, value, label)."""
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        l1 = np.full(z[i].shape, L1)
        if isinstance(i, slice) or i[-1] == dimensions:
            l1[-1] = 0
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(passes):
        for index, value, label in rows:
            i, x = np.r_[index, dimensions], np.r_[value, 1.0]
            w = weights(i)
            g = (_sigmoid(w @ x) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(slice(None))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", bound: int = BOUND, shards: int = SHARDS, passes: int = PASSES) -> np.ndarray | None:
    """Mean of the shards' weights; None without both labels. ``bound`` also bounds what is broadcast: two longs a label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    known = known.where(~held_out("_id"))
    n = max(known.count(), 1)
    picked = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(min(1.0, 0.95 * bound / n) * (1 << 30)))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    # One text for each label, chosen where the rows lie: a shard holds no more than its labels, however often an id repeats.
    one = rows.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.min("_y").alias("_y"))
    rows = one.select(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(shards)).alias("_shard"), "_id", "_text", "_y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        by: dict[int, list] = {}
        for b in batches:
            for shard, text, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                by.setdefault(shard, []).append((*_sparse(features(text.as_py())), y))
        for shard, some in by.items():
            if len({y for _, _, y in some}) < 2:
                continue
            w = train(some, passes)
            i = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "i": pa.array([i], pa.list_(pa.int64())), "w": pa.array([w[i]], pa.list_(pa.float64()))})

    order = F.xxhash64("_id", F.lit(2))
    trained = rows.repartition(shards, "_shard").sortWithinPartitions("_shard", order, "_id", "_text").mapInArrow(tidy(work), "shard long, i array<long>, w array<double>")
    models = sorted(trained.collect(), key=lambda m: m["shard"])  # as many rows as shards, each of ``DIMENSIONS`` numbers at most
    if not models:
        return None
    out = np.zeros(DIMENSIONS + 1)
    for m in models:
        out[np.array(m["i"], np.int64)] += np.array(m["w"]) / len(models)
    return out


def score(docs: DataFrame, model: np.ndarray | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns, and the probability of label 1."""
    w = None if model is None else model.astype(np.float64)

    def one(text: str | None) -> float:
        if w is None:
            return 0.5
        z = w[-1] + sum(float(w[f].mean()) for f in features(text or "") if len(f))
        return float(_sigmoid(z))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            yield b.append_column(name, pa.array([one(t.as_py()) for t in b.column(text_col)], pa.float64()))

    from pyspark.sql import types as T

    return docs.mapInArrow(tidy(work), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return score(rows, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The documents that the classifier does not reject, their columns as they were."""
    scored = score(docs, fit(docs, labels, id_col, text_col), text_col, "_quality_score")
    return scored.where(F.col("_quality_score") >= cut).select(docs.columns)

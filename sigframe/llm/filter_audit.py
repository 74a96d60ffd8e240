"""What filters do to a corpus, alone, in every order, and on average, from sorted posting lists.

Five filters judge whole texts (null is empty; a word is a maximal run without ASCII white space). A document fails A with fewer than 200 words, B if its
distinct words are less than half of its words, C if more than 3 % of its code points are ``A-Z``, D if it holds one of ``#$%&*|``, and E if its text is
that of a document with a smaller id, anywhere in the table.

Every row gets a number. For each part (a value of ``lang``; null is the empty string) and each range of numbers, each filter has the
ascending list of the numbers that fail it, and so have the labels. A range holds ``RANGE`` rows at most, so a part of any size is many
ranges. What a filter removes after others is the difference between its list and the union of theirs. Unions are merged from
their lists, and differences taken, by searching the shorter list's numbers in the longer one, each search starting where the one before ended. No order has
its own pass: a step depends only on which filters came before it, so the 80 pairs of such a set and a filter give all 120 orders. The
sizes are summed over ranges.

A null id is smaller than none and no id is smaller than it: such a document fails no E and makes no other fail. Rows that repeat an id count each, and copies
under one id do not fail E for each other. A document is good (toxic) if any row of its labels says so; null ids have no labels. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, stored, tidy, whole_text

FILTERS = "ABCDE"
#: Rows of one range: a list has no more numbers than that.
RANGE = 1 << 16
#: Parts whose sums a task holds before it gives them out.
HELD = 1000
SPACE = r"[\x20\x09-\x0D]+"
LISTS = [*FILTERS, "good", "toxic"]


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(row, part, A, B, C, D, E, good, toxic): a number for each row, and what it fails."""
    text = whole_text(text_col)
    words = F.split(text, SPACE)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    # Only the first and the last of the words can be empty.
    ends = (F.get("words", F.lit(0)) == "").cast("int") + ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    n = F.size("words") - ends
    distinct = F.size(F.array_distinct("words")) - (ends > 0).cast("int")
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", ""))
    scanned = rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (n < 200).alias("A"), (100 * distinct < 50 * n).alias("B"), (100 * capitals > 3 * F.char_length("text")).alias("C"),
        F.regexp_like("text", F.lit(r"[#$%&*|]")).alias("D"),
    )
    scanned = stored(scanned, "scanned")
    copies = scanned.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    copies = stored(copies.select("digest", "first_id"), "copies")
    marks = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), "quality", "toxic").where("label_id IS NOT NULL")
    known = stored(known.groupBy("label_id").agg(*marks).where("good OR toxic"), "labels")
    joined = scanned.join(few(copies), "digest", "left").join(few(known), F.col("doc_id") == F.col("label_id"), "left")
    later = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)).alias("E")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return stored(joined.select(F.monotonically_increasing_id().alias("row"), "part", "A", "B", "C", "D", later, *flags), "failures")


def postings(marked: DataFrame, rows: int = RANGE) -> DataFrame:
    """(part, range, docs, and for each filter and label an ascending list) of rows with what they fail."""
    lists = [F.sort_array(F.collect_list(F.when(F.col(c), F.col("row")))).alias(c) for c in LISTS]
    by = [F.col("part"), F.floor(F.col("row") / rows).alias("range")]
    return stored(marked.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), *lists), "postings")


def _found(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which numbers of ``a`` are in ``b``; both ascend, and the shorter one is searched in the longer."""
    out = np.zeros(len(a), bool)
    if len(a) and len(b):
        if len(a) <= len(b):
            at = np.searchsorted(b, a)
            out = b[np.minimum(at, len(b) - 1)] == a
        else:
            at = np.searchsorted(a, b)
            hit = a[np.minimum(at, len(a) - 1)] == b
            out[at[hit]] = True
    return out


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[~_found(a, b)]


def union(lists: list[np.ndarray]) -> np.ndarray:
    """One ascending list of ascending ones: from the longest on, what each of the others adds goes to its place."""
    out, *others = sorted(lists, key=len, reverse=True) or [np.zeros(0, np.int64)]
    for x in others:
        new = difference(x, out)
        if len(new):
            out = np.insert(out, np.searchsorted(out, new), new)
    return out


def subsets(n: int) -> Iterator[tuple[int, ...]]:
    """All sets of numbers below n, smaller sets first."""
    return (s for k in range(n + 1) for s in combinations(range(n), k))


def _bits(some: tuple[int, ...]) -> int:
    return sum(1 << i for i in some)


def interactions(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each set of filters that came before (as bits) and each filter: fails, gone before, removed, fails alone, good removed, toxic removed."""
    n = len(lists)
    out, unions = np.zeros((1 << n, n, 6), np.int64), {}
    for some in subsets(n):
        # The union without the last filter is there already.
        unions[_bits(some)] = union([unions[_bits(some[:-1])], lists[some[-1]]]) if some else np.zeros(0, np.int64)
    every = (1 << n) - 1
    for f, own in enumerate(lists):
        alone = len(difference(own, unions[every & ~(1 << f)]))
        for before, gone in unions.items():
            if not before >> f & 1:
                removed = difference(own, gone)
                out[before, f] = len(own), len(gone), len(removed), alone, _found(removed, good).sum(), _found(removed, toxic).sum()
    return out


COUNTS = ["fails", "gone", "removed", "alone", "good_lost", "toxic_lost"]


def summed(posted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, before, filter, docs, and the counts), summed over all ranges; ``before`` are bits, ``filter`` is a number."""
    n = len(filters)
    schema = f"part string, before int, filter int, docs long, {', '.join(f'{c} long' for c in COUNTS)}"
    names = [x.split()[0] for x in schema.split(", ")]
    pairs = [(b, f) for b in range(1 << n) for f in range(n) if not b >> f & 1]
    at = tuple(np.array(x) for x in zip(*pairs, strict=True))

    def batch(held: dict[str, list]) -> pa.RecordBatch:
        table = np.concatenate([x[1][at] for x in held.values()])
        docs = np.repeat(np.array([x[0] for x in held.values()], np.int64), len(pairs))
        parts = np.repeat(np.array(list(held), object), len(pairs))
        columns = [pa.array(parts, pa.string()), *(pa.array(np.tile(x, len(held)).astype(np.int32)) for x in at), pa.array(docs)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(table[:, k]) for k in range(len(COUNTS)))], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            for i, part in enumerate(b.column(0).to_pylist()):
                lists = [b.column(2 + k)[i].values.to_numpy() for k in range(n + 2)]
                one = held.setdefault(part, [0, np.zeros((1 << n, n, len(COUNTS)), np.int64)])
                one[0] += b.column(1)[i].as_py()
                one[1] += interactions(lists[:n], *lists[n:])
                if len(held) >= HELD:
                    yield batch(held)
                    held = {}
        if held:
            yield batch(held)

    each = posted.select("part", "docs", *filters, "good", "toxic").mapInArrow(tidy(work), schema)
    return each.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ["docs", *COUNTS]])


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, filter) for each step of each order: 600 rows of five filters."""
    return [("".join(filters[i] for i in p), k + 1, _bits(p[:k]), p[k]) for p in permutations(range(len(filters))) for k in range(len(p))]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each step of each order in each part.

    ``shapley`` is what the filter removes, summed over all orders.
    """
    sums = summed(postings(failures(docs, labels, id_col, text_col, part_col)))
    n = len(FILTERS)
    size = F.bit_count("before")
    weight: Column = F.lit(0)
    for k in range(n):
        weight = F.when(size == k, factorial(k) * factorial(n - 1 - k)).otherwise(weight)
    of_filter = Window.partitionBy("part", "filter")  # 16 rows each
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * weight).over(of_filter))
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, before int, filter int")
    return sums.join(F.broadcast(steps), ["before", "filter"]).select(
        "part", "filter_order", "step", (F.col("docs") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), F.col("alone").alias("unique_fails"), "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley"),
    )

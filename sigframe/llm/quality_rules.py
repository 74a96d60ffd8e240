"""Quality rules judged together by an isolation forest.

Each text gets statistics of the usual rules. A forest of random splits is grown on small samples of them; a text that few splits set
apart from all others is anomalous (score near 1). The score from which on a text is dropped is calibrated on labelled texts: it has the least
cost, which is the share of label 0 that is kept and ``good_cost`` times the share of label 1 that is dropped; of equal costs the higher score.

The forest takes ``trees`` samples of ``sample`` texts each, which the method itself bounds; statistics, scores and
the threshold come from all texts and all labels. Samples are picked by a hash of the text, so reruns agree. Null and empty texts have no words and fail the base rule. Without
labelled texts of both kinds it is 0.6. Repeated rows are judged each on its own. An empty table gives no rows. No column but id and text is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy, whole_text

TREES, SAMPLE, SEED = 100, 128, 7
GOOD_COST, THRESHOLD, BINS = 4.0, 0.6, 2000
SYMBOLS = b"#*$%&|<>"
RULES = ["symbols", "repeats", "dup_lines", "upper", "marks", "distinct", "word_len", "digits", "odd_ends", "lone_marks", "short_words", "symbol_kinds"]
STATS = "doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, rules array<double>"


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    pair = ids[:-1] * size + ids[1:]
    if size > 1 << 20:  # keep the product below 2 ** 63
        pair, size = np.unique(pair, return_inverse=True)[1], len(number)
    window = pair[:-1] * size + ids[2:]
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[at + k] = True
    return int(inside.sum())


def statistics(text: str) -> tuple[int, int, int, int, int, list[float]]:
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(data.count(bytes([s])) for s in SYMBOLS)
    seen: set[str] = set()
    dups = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            dups += line in seen
            seen.add(line)
    repeats = _repeated(words)
    upper = len(data.translate(None, bytes(set(range(256)) - set(range(65, 91)))))
    marks = sum(data.count(m) for m in b"!?.,;:")
    digits = len(data.translate(None, bytes(set(range(256)) - set(range(48, 58)))))
    some = max(chars, 1)
    common = Counter(words).most_common(1)[0][1] if n else 0
    ends = Counter(w[-1] for w in words)
    odd = sum(ends[c] for c in SYMBOLS)
    lone = sum(len(w) == 1 and not w.isalnum() for w in words)
    short = sum(len(w) <= 3 for w in words)
    kinds = sum(bytes([c]) in data for c in SYMBOLS)
    rules = [symbols / some, repeats / max(n, 1), dups / max(lines, 1), upper / some, marks / some, common / max(n, 1), chars / max(n, 1), digits / some, odd / max(n, 1), lone / max(n, 1), short / max(n, 1), kinds / len(SYMBOLS)]
    return n, chars, symbols, dups, repeats, rules


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.list_(pa.float64())]
        for b in batches:
            cols = zip(*[statistics(t.as_py()) for t in b.column(2)], strict=True) if b.num_rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    names = [x.split()[0] for x in STATS.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_hash"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(tidy(work), STATS)


def _path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    n = np.maximum(n, 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree as arrays: feature (-1: leaf), split, left child (right is next to it), depth to give at a leaf."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
    todo = [(0, rows, 0)]
    while todo:
        at, x, depth = todo.pop()
        low, high = x.min(0), x.max(0)
        free = np.flatnonzero(high > low)
        if depth >= limit or len(x) < 2 or not len(free):
            nodes[at][3] = depth + float(_path(float(len(x))))
            continue
        f = int(rng.choice(free))
        split = float(rng.uniform(low[f], high[f]))
        left = len(nodes)
        nodes[at][:3] = [f, split, left]
        nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        side = x[:, f] <= split
        todo += [(left, x[side], depth + 1), (left + 1, x[~side], depth + 1)]
    a = np.array(nodes)
    return {"feature": a[:, 0].astype(np.int64), "split": a[:, 1], "left": a[:, 2].astype(np.int64), "depth": a[:, 3]}


def anomaly(forest: list[dict[str, np.ndarray]], x: np.ndarray, sample: int = SAMPLE) -> np.ndarray:
    total = np.zeros(len(x))
    row = np.arange(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := t["feature"][at] >= 0).any():
            f = np.maximum(t["feature"][at], 0)
            at = np.where(inner, t["left"][at] + (x[row, f] > t["split"][at]), at)
        total += t["depth"][at]
    return 2.0 ** (-total / max(len(forest), 1) / max(float(_path(float(sample))), 1e-9))


def fit(stats: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> list[dict[str, np.ndarray]]:
    """Grows each tree in a task of its own on ``sample`` texts; gives the driver nodes only, at most twice ``trees * sample``."""
    n = stats.count()
    if not n:
        return []
    # A pool by hash, from which each tree draws by a hash of its own; trees may share texts.
    pool, share = min(1.0, 4 * trees * sample / n), min(1.0, 1.5 * sample / max(1.0, n * min(1.0, 4 * trees * sample / n)))
    below = lambda part, *salt: F.pmod(F.xxhash64("doc_id", "text_hash", *salt), F.lit(1 << 30)) <= int(part * (1 << 30))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: below(share, t, F.lit(seed)))
    picked = stats.where(below(pool, F.lit(seed))).select("rules", "doc_id", "text_hash", F.explode(drawn).alias("tree")).withColumn("tree", F.col("tree").cast("long"))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("doc_id", "text_hash", "tree", F.lit(seed + 2)), "doc_id")
    picked = picked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.setdefault(t, []).append(x)
        for t, x in rows.items():
            got = grow(np.array(x), np.random.default_rng([seed, t]))
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int64()), **{k: pa.array([v], pa.list_(pa.float64())) for k, v in got.items()}})

    schema = "tree long, feature array<double>, split array<double>, left array<double>, depth array<double>"
    grown = picked.repartition("tree").sortWithinPartitions("tree", "k").select("tree", "rules").mapInArrow(tidy(work), schema).collect()
    return [{"feature": np.array(r["feature"], np.int64), "split": np.array(r["split"]), "left": np.array(r["left"], np.int64), "depth": np.array(r["depth"])} for r in sorted(grown, key=lambda r: r["tree"])]


def calibrate(scored: DataFrame, labels: DataFrame, good_cost: float = GOOD_COST, label: str = "quality") -> float:
    """The score from which on texts are dropped, at the least cost on the labelled texts. Counts go by bins, so any number of labels will do."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"))
    bins = scored.join(known, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).alias("bin")).agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("good"), F.count("*").alias("n")).collect()
    good = sum(r["good"] for r in bins)
    bad = sum(r["n"] for r in bins) - good
    if not good or not bad:
        return THRESHOLD
    best = kept = lost = 0.0
    limit = BINS + 1
    for r in sorted(bins, key=lambda r: -r["bin"]):  # from the highest score down: what is dropped, against dropping nothing
        kept -= (r["n"] - r["good"]) / bad
        lost += r["good"] / good
        if kept + good_cost * lost < best:
            best, limit = kept + good_cost * lost, r["bin"]
    return limit / BINS


def judge(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, sample: int = SAMPLE, good_cost: float = GOOD_COST) -> DataFrame:
    """Per document the base rules' counts, ``base_failed``, the forest's ``anomaly`` and ``kept``."""
    stats = stored(measured(docs, id_col, text_col), "rules")
    passed = stats.where(~_failed())
    forest = fit(passed, trees, sample)
    size = min(sample, max(passed.count(), 2))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("rules").to_pylist(), np.float64).reshape(b.num_rows, len(RULES))
            yield b.append_column("anomaly", pa.array(anomaly(forest, x, size)))

    scored = stored(stats.mapInArrow(tidy(work), STATS + ", anomaly double").drop("text_hash", "rules"), "scored")
    limit = calibrate(scored.where(~_failed()), labels, good_cost) if labels is not None else THRESHOLD
    out = scored.withColumn("base_failed", _failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) < limit * BINS))


def _failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))

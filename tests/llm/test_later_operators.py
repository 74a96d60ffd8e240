"""Clusters, filter audit and exact de-duplication against plain versions, over odd rows and given ones."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.llm import centroid_clustering, exact_dedup, filter_audit

from .fixtures import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_clusters(vectors, k, rounds, scale=1024):
    """(vec_id, cluster, distance) of each vector, by all distances with Python's integers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in vectors]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found), key=str)


def vector_table(spark, vectors):
    return spark.createDataFrame([(i, v, 7, 1) for i, v in vectors], "vec_id long, embedding array<double>, cluster int, q int")


@pytest.mark.parametrize(("seed", "spread"), [(1, 1.0), (2, 0.003), (3, 40.0)])
def test_clusters_are_the_nearest(spark, seed, spread):
    rng = np.random.default_rng(seed)
    vectors = [(int(i), (rng.normal(size=64) * spread + (i % 5)).tolist()) for i in range(300)]
    vectors += [vectors[3], vectors[3], (3, vectors[4][1]), (None, vectors[5][1]), (None, vectors[6][1])]
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (906, [])]
    got = centroid_clustering.clustered(vector_table(spark, vectors + odd).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(vectors, 8, 10)


def test_clusters_of_ties_and_few(spark):
    grid = [(i, [float(i % 2)] * 32 + [float(i // 2 % 2)] * 32) for i in range(40)]  # four different vectors, so centroids repeat and stay empty
    got = centroid_clustering.clustered(vector_table(spark, grid))
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(grid, 8, 10)
    few = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    got = centroid_clustering.clustered(vector_table(spark, few))
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(few, 2, 10)
    none = centroid_clustering.clustered(vector_table(spark, few).limit(0))
    assert none.collect() == [] and none.columns == got.columns
    with pytest.raises(Exception, match="component too large"):
        centroid_clustering.clustered(vector_table(spark, [(1, [1e30] * 64)])).collect()


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-2000, 2000, (200, 4))
    x = centroids[rng.integers(0, 200, 500)] + rng.integers(-40, 40, (500, 4))
    x[:50] = (centroids[:50] + centroids[50:100]) // 2
    lists = centroid_clustering.SortedLists(np.r_[centroids, centroids[:20]])  # the first twenty twice
    which, best, cost = lists.nearest(x)
    all_ = ((x[:, None, :] - lists.centroids[None]) ** 2).sum(2)
    assert (which == all_.argmin(1)).all() and (best == all_.min(1)).all()
    assert cost < 0.5 * all_.size  # lists are read far enough, and no farther


def plain_audit(docs, labels):
    first, mark = {}, defaultdict(set)
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, quality, toxic in labels:
        if i is not None:
            mark[i] |= ({"good"} if quality == 1 else set()) | ({"toxic"} if toxic == 1 else set())
    failed = defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        bad = {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len({*w}) < 50 * len(w) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        bad |= {"D"} if {*t} & {*"#$%&*|"} else set()
        bad |= {"E"} if i is not None and t in first and first[t] < i else set()
        failed[lang or ""].append((bad, mark[i] if i is not None else set()))
    out = {}
    for part, rows in failed.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                all_ = sum(f in r[0] for r in rows)
                alone = sum(r[0] == {f} for r in rows)
                out[part, "".join(order), k + 1] = [len(left), len(gone), all_ - len(gone), alone, sum("good" in r[1] for r in gone), sum("toxic" in r[1] for r in gone)]
                shapley[f] += len(gone)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[f])
    return out


def audit_rows(df):
    found = {tuple(r)[:3]: list(r)[3:] for r in df.collect()}
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return found


def test_audit(spark):
    docs = documents(spark)
    some = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    more = [(None, "same text here " * 40, "en"), (None, None, "de"), (None, "A B C", "x y"), (7, "Q#", "en"), (7, "Q#", "en"), (6, "Q#", "en"), (-5, "", None)]
    labels = [(i, k % 2, (k // 2) % 2) for k, (i, _, _) in enumerate(some)] + [(None, 1, 1), (7, 0, 0), (7, 1, 0), (7, None, 1), (424242, 1, 1)]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit_rows(filter_audit.audit(df.withColumns({"A": F.lit(1), "part": F.lit("x"), "row": F.lit(0)}), known))
    assert got == plain_audit(some + more, labels)
    assert audit_rows(filter_audit.audit(df, known.limit(0))) == plain_audit(some + more, [])
    assert audit_rows(filter_audit.audit(empty(spark), known)) == {}


def test_audit_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    marked = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 1300)).alias("part"),
                                      *[(F.xxhash64("id", F.lit(k)) % (k + 2) == 0).alias(c) for k, c in enumerate(filter_audit.LISTS)])
    one, many = (sorted(map(tuple, filter_audit.summed(filter_audit.postings(marked, n)).collect())) for n in (1 << 20, 64))
    assert one == many and len(one) == 80 * marked.select("part").distinct().count()
    lists = [np.sort(rng.choice(2000, n, replace=False)) for n in (0, 1, 30, 1500, 700)]
    assert (filter_audit.union(lists) == np.unique(np.concatenate(lists))).all() and len(filter_audit.union([])) == 0
    for a in lists:
        for b in lists:
            assert (filter_audit.difference(a, b) == np.setdiff1d(a, b)).all()


def plain_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    best = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    return Counter((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("arrivals", [1, 2, 5])
def test_exact_groups(spark, arrivals):
    df = documents(spark).select("doc_id", "text", F.lit(1).alias("digest"), F.lit(2).alias("row"), F.lit("z").alias("batch"))
    more = [(None, "same text here " * 40), (None, None), (None, "only here"), (None, "only here"), (-9, "ab"), (2**62, "ab"), (2**62, "ab"), (2**62, "Ab")]
    df = df.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).repartition(6)
    got = exact_dedup.exact_groups(df, arrivals=arrivals).collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_groups(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_with_a_hot_text(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 4000)).alias("text"))
    got = exact_dedup.exact_groups(df)
    assert got.where("kept").count() == got.select("text_sha256").distinct().count() and got.where("keep_id = 8997 AND group_size = 3000").count() == 3000
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []


def test_index_outlives_a_session_and_a_broken_batch(spark, tmp_path):
    path = str(tmp_path / "index")
    table = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string, batch string, digest int")
    add = lambda df, name, s=spark: sorted(r.doc_id for r in exact_dedup.deduplicate(df, exact_dedup.DigestIndex(s, path, 3), name).collect())
    assert add(table((1, "a", "x", 0), (2, "a", "x", 0), (3, "b", "x", 0), (3, "b", "x", 0)), "first") == [2, 3]
    later = table((4, "b", "x", 0), (5, "c", "x", 0), (6, "c", "x", 0), (7, None, "x", 0), (8, "", "x", 0))
    assert add(later, "second") == [6, 8]
    assert add(later, "second") == [6, 8]  # the same batch again changes nothing
    other = spark.newSession()
    for name in ("seen", "index"):
        other.sql(f"DROP TABLE {getattr(exact_dedup.DigestIndex(spark, path), name)}")  # another catalog knows nothing of the folder
    assert add(table((9, "c", "x", 0), (10, "d", "x", 0)), "third") == [10]
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 3 and {r.group_size for r in index.groups().collect()} == {2, 3, 1}
    # A batch without its mark is taken out and added again.
    before = sorted(map(tuple, index.groups().select("keep_id", "group_size").collect()))
    files, where = index._folder(f"{path}/done/third")
    files.delete(where, True)
    assert add(table((9, "c", "x", 0), (10, "d", "x", 0)), "third") == [10]
    assert sorted(map(tuple, exact_dedup.DigestIndex(spark, path).groups().select("keep_id", "group_size").collect())) == before
    with pytest.raises(ValueError, match="name of a batch"):
        index.add(later, "a'b")


def test_index_is_not_shuffled(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").alias("row"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    index.add(rows, "one")
    index.add(rows, "two")
    new = spark.table(index.seen).hint("merge").join(spark.table(index.index).select("digest"), "digest", "left_anti")
    for plan in (new, index.groups()):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
    assert new.count() == 0 and {tuple(r) for r in index.groups().select("keep_batch", "group_size").distinct().collect()} == {("one", 2)}

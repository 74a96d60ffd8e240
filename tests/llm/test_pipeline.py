"""The pipeline from end to end against plain versions of its stages, and on empty tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sigframe.llm import common, pii_surrogates, quality_classifier, simhash_dedup

from .fixtures import DATA, documents
from .test_operators import targets_want


def written(spark, docs, labels, path):
    docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("label")).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def survivors(rows):
    """The smallest id of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    sets = [(i, frozenset(simhash_dedup.shingle_hashes(t or "", 5).tolist())) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x == y or len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i for i in up if find(i) == i}


def test_stages_follow_each_other(spark, tmp_path):
    base = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id IS NOT NULL")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    mail = "Mrs Jane Doe, jane.doe@corp.com, wrote of it at length. "
    extra = [r.text for r in base.where("length(text) > 600").orderBy("doc_id").limit(6).collect()]
    docs = documents(spark, [*extra, *[mail + t for t in extra[:2]]])
    docs = docs.unionByName(base.select(*[F.col(c) if c in base.columns else F.lit(None).alias(c) for c in docs.columns]).where("doc_id > 100")).cache()
    sf = written(spark, docs, labels, tmp_path)
    out = pipeline.run(spark, sf).toPandas()

    scored = {(r.doc_id, r.predicted) for r in quality_classifier.classify(docs, labels).collect()}
    good = {i for i, p in scored if p}
    rows = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good}
    left = survivors(sorted(rows, key=lambda r: r[0]))
    kept = docs.where(F.col("doc_id").isin([int(i) for i in left])).dropDuplicates(["doc_id"])
    clean = {r.doc_id: (r.text, r.source) for r in pii_surrogates.replace(kept).collect()}
    assert not any("corp.com" in (t or "") or "Jane" in (t or "") for t, _ in clean.values())
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (t, _) in clean.items()}
    sums = defaultdict(int)
    for i, (_, s) in clean.items():
        sums[s] += size[i]
    tok = Tokenizer.from_file(common.tokenizer_path())
    tokens = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, (t, _) in clean.items()}
    copies, words = Counter(), defaultdict(int)
    for i, some in out.groupby("doc_id"):
        assert i in clean and (some.doc_tokens == tokens[i]).all() and some.length.sum() % tokens[i] == 0, i
        copies[i] = int(some.length.sum() // tokens[i])
        words[clean[i][1]] += copies[i] * size[i]
    assert max(copies.values()) <= 2
    for s, want in targets_want(sums).items():
        assert abs(words[s] - want) <= max((size[i] for i in clean if clean[i][1] == s), default=0), s
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048


def test_empty_tables_go_through(spark, tmp_path):
    docs = documents(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pipeline.run(spark, written(spark, docs, labels, tmp_path)).count() == 0


def test_stage_columns():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix_sources", "pack_sequences"] and pipeline.ORACLE_SQL is None

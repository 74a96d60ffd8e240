"""Queries over replayed streams, on small tables that their own data does not show."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.plans import flows
from sigframe.plans.queries import QUERIES, SQL
from sigframe.streaming import streams

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
BEGIN = datetime.datetime(2024, 1, 1)


def events(spark, folder, rows, parts=1):
    """An ``events`` table of (event_id, seconds, type, value)."""
    full = [(i, BEGIN + datetime.timedelta(seconds=s), i % 7, kind, value, f'{{"k": {i % 10}}}') for i, s, kind, value in rows]
    spark.createDataFrame(full, EVENT).repartition(parts).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = sorted(map(str, (tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect())))
    assert got == sorted(map(str, want.fetchall()))
    return len(got)


@pytest.mark.parametrize("name", ["m_ledger", "m_rungs_repaired"])
def test_a_stream_without_rows_leaves_an_empty_table(spark, tmp_path, name):
    flat = [(i, 600 * i, "ab"[i % 2], 5.0) for i in range(60)] if name == "m_ledger" else []  # a flat price breaks nothing
    assert same_as_sql(spark, name, events(spark, tmp_path, flat)) == 0


def test_near_events_are_dealt_out_by_time(spark, tmp_path):
    """Pairs at the edges of cells, each once; one key's pairs do not all meet in one task."""
    at = {"left": [(k * 977) % 50_000 for k in range(300)] + [0, 3600, 7200], "right": [(k * 1361) % 50_000 for k in range(300)] + [0, 7199, 7200, 10_800, 10_801]}
    for name, times in at.items():
        rows = spark.createDataFrame([("x", 86_400 + t, n) for n, t in enumerate(times)], "k string, ts long, n long").withColumn("ts", F.timestamp_seconds("ts"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    left, right = (spark.readStream.schema("k string, ts timestamp, n long").parquet(f"{tmp_path}/{name}") for name in at)
    pairs = streams.nearby_streams(left, right, "k", "1 HOUR", values=["n"]).withColumn("part", F.spark_partition_id())
    got = streams.replay(pairs, f"{tmp_path}/out").collect()
    want = [(i, j) for i, a in enumerate(at["left"]) for j, b in enumerate(at["right"]) if abs(a - b) <= 3600]
    assert sorted((r.n, r.other_n) for r in got) == want
    assert len({r.part for r in got}) > 1


@pytest.mark.parametrize("block", [7, 512])
def test_a_stream_of_near_events_writes_blocks(spark, tmp_path, monkeypatch, block):
    """What the stream keeps and writes is far less than the pairs, and every pair comes out of it."""
    written = []
    monkeypatch.setattr(streams, "BLOCK", block, raising=False)
    monkeypatch.setattr(streams, "replay", lambda stream, path, run=streams.replay: written.append(run(stream, path)) or written[-1])
    n = same_as_sql(spark, "m_nearby", events(spark, tmp_path, [(k, 7 * k % 7200, ("purchase", "view")[k % 2], 1.0) for k in range(1200)]))
    assert n > 200_000
    assert written[0].count() < n / 10


def test_no_events_have_no_pairs(spark, tmp_path):
    assert same_as_sql(spark, "m_nearby", events(spark, tmp_path, [(k, 60 * k, "click", 1.0) for k in range(30)])) == 0


@pytest.mark.parametrize("name", ["m_changes", "m_stepped_stream"])
def test_ticks_of_many_files_come_in_order(spark, tmp_path, monkeypatch, name):
    """A table of many files, most ticks within one hour, ids beyond 31 bits: whichever files a micro-batch takes, no tick comes before its turn."""
    monkeypatch.setattr("sigframe.plans.flows.SLICE_ROWS", 20, raising=False)
    rng = np.random.default_rng(4)
    rows = [(n * (1 << 27) + 1, int(rng.integers(0, 3600)) if n % 50 else 400_000 * n, "ab"[n % 2], float(rng.integers(0, 200))) for n in range(400)]
    assert same_as_sql(spark, name, events(spark, tmp_path, rows, parts=13)) > 50


def test_slices_stay_small(spark, tmp_path, monkeypatch):
    """What a micro-batch takes, and so what waits in a task, does not grow with the table, even if nearly all ticks lie in one hour."""
    monkeypatch.setattr(flows, "SLICE_ROWS", 20, raising=False)
    rows = [(n, n % 3600 if n % 50 else 400_000 * n, "a", 1.0) for n in range(400)]
    ticks, *_ = flows.sliced(spark, events(spark, tmp_path, rows))
    sizes = {r["slice"]: (r.n, r.lo, r.hi) for r in ticks.groupBy("slice").agg(F.count("*").alias("n"), F.min(F.struct("ts", "seq")).alias("lo"), F.max(F.struct("ts", "seq")).alias("hi")).collect()}
    assert sum(n for n, _, _ in sizes.values()) == 400 and max(n for n, _, _ in sizes.values()) <= 60
    assert all(sizes[k][2] < sizes[k + 1][1] for k in range(len(sizes) - 1))


def test_what_waits_keeps_all_digits(spark, tmp_path):
    value, late = 0.12345678901234567, 10_000
    for at, kind in ((100, "a"), (late, "~"), (late + 1, "~")):
        for name in ("left", "right"):
            rows = spark.createDataFrame([(kind, at, value)], "k string, ts long, v double").withColumn("ts", F.timestamp_seconds("ts"))
            rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    joined = streams.asof_stream(read("left"), read("right").withColumnRenamed("v", "w"), ["k"], ["w"], "1 hour")
    assert [(r.v, r.w_asof) for r in streams.replay(joined, f"{tmp_path}/out").where("k = 'a'").collect()] == [(value, value)]

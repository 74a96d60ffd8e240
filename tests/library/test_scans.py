"""Block scans against row-by-row folds, chains against loops, and streams that are stopped and started again."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.operators import aggregates, chains, folds, resampling, scans
from sigframe.streaming import streams

from .test_library import bars


def walk(n, seed, step=1.0):
    """Bars of a random walk with a few jumps and flat stretches."""
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(0, step, n) * (rng.random(n) > 0.1) + (rng.random(n) > 0.98) * rng.normal(0, 15, n))
    o = np.r_[100, c[:-1]]
    return [(o[i], max(o[i], c[i]) + rng.random(), min(o[i], c[i]) - rng.random(), c[i]) for i in range(n)]


@pytest.mark.parametrize(("block", "seed"), [(7, 1), (64, 2), (4096, 3)])
def test_bands_equal_a_fold(spark, block, seed):
    rows = bars(spark, walk(500, seed)).withColumns({"hl2": (F.col("h") + F.col("l")) / 2, "width": F.when(F.col("bar_idx") % 97 != 5, 2.0 + F.col("bar_idx") % 3), "regime": F.lit("x")})
    want = {r.bar_idx: (r.direction, r.line) for r in folds.fold(rows.select("instrument", "timeframe", "bar_idx", "hl2", "width", "c", "regime"), folds.ratchet, folds.RATCHET).collect()}
    out, last = scans.block_scan(rows, ["hl2", "width", "c"], 4, scans.ratchet, ["direction", "line"], block=block)
    got = {r.bar_idx: (int(r.direction), r.line) for r in out.where("direction IS NOT NULL").collect()}
    assert got == want and last.count() == 1 and not math.isnan(last.first().state[0])
    assert scans.block_scan(rows.limit(0), ["hl2", "width", "c"], 4, scans.ratchet, ["direction", "line"])[0].count() == 0


@pytest.mark.parametrize(("block", "life"), [(5, 12), (50, 30), (4096, 200)])
def test_zone_pool_equals_a_fold(spark, block, life):
    b = bars(spark, walk(400, 7)).withColumn("atr", F.lit(2.0))
    at = b.where("bar_idx % 4 = 1").withColumn("price", F.col("h") - 0.3)
    none = F.lit(None).cast("double")
    first = at.select("instrument", "timeframe", "bar_idx", F.lit("candidate").alias("kind"), "price", "atr", none.alias("low"), none.alias("high"))
    touch = b.select("instrument", "timeframe", "bar_idx", F.lit("touch").alias("kind"), none.alias("price"), "atr", F.col("l").alias("low"), F.col("h").alias("high"))
    marked = folds.last_marked(first.unionByName(touch), ["instrument", "timeframe"], ["bar_idx", "kind"], "last")
    want = sorted(map(tuple, folds.fold(marked, folds.zone_pool(3, life), folds.ZONE_POOL, order=("bar_idx", "kind")).collect()))
    got = sorted(map(tuple, scans.zone_pool(b, at.select("instrument", "timeframe", "bar_idx", "price", "atr"), 3, life, block=block).collect()))
    assert got == want and len(got) > 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_liquidity_pools_equal_a_fold(spark, seed):
    b = bars(spark, walk(400, seed, 0.6)).withColumn("atr", F.lit(4.0))
    at = b.where("bar_idx % 3 = 1").withColumn("price", F.col("h"))
    none = F.lit(None).cast("double")
    piv = at.select("instrument", "timeframe", "bar_idx", F.lit("pivot").alias("kind"), "price", "atr", none.alias("high"), none.alias("low"), F.lit("high").alias("side"))
    bar = b.select("instrument", "timeframe", "bar_idx", F.lit("bar").alias("kind"), none.alias("price"), "atr", F.col("h").alias("high"), F.col("l").alias("low"), F.lit("high").alias("side"))
    marked = folds.last_marked(piv.unionByName(bar), ["instrument", "timeframe"], ["bar_idx", "kind"], "last")
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    want = folds.fold(marked, folds.liquidity_pools(keep=6), folds.POOL, order=("bar_idx", "kind")).collect()
    got = scans.liquidity_pools(at.select("instrument", "timeframe", "bar_idx", "price", "atr"), b, keep=6).collect()
    assert key(got) == key(want) and len(got) > 3


def test_equity_by_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [("a" if i % 3 else "b", int(i // 2), i, float(p)) for i, p in enumerate(rng.normal(1, 20, 300))] + [("dead", i, i, -100.0 if i == 4 else 5.0) for i in range(9)]
    t = spark.createDataFrame(rows, "k string, at int, id int, pnl_pct double")
    want = {r.id * 10 + ord(r.k[0]): (r.equity, r.peak, r.drawdown) for r in aggregates.equity(t, ["k"], ["at", "id"]).collect()}
    got = {r.id * 10 + ord(r.k[0]): (r.equity, r.peak, r.drawdown) for r in aggregates.equity_by_blocks(t, ["k"], ["at", "id"], block=4).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_a_trapped_break(spark):
    hour = 3600
    path = [(100, 101, 99, 100)] * 10 + [(100, 101, 88, 95)] + [(95, 99, 94, 98.5)] * 2 + [(98, 103, 97, 102)] * 5
    b = bars(spark, path)
    key = "instrument string, timeframe string"
    broken = spark.createDataFrame([("x", "1h", 2 * hour, "bullish", "BOS", 98.0), ("x", "1h", 8 * hour, "bearish", "BOS", 90.0), ("x", "1h", 7 * hour, "bearish", "CHOCH", 91.0), ("x", "1h", 3 * hour, "bullish", "BOS", 98.5)], f"{key}, t long, side string, type string, level double")
    blocks = spark.createDataFrame([("x", "1h", 5 * hour, "bearish", 99.0, 100.0), ("x", "1h", 4 * hour, "bearish", 97.0, 100.0), ("x", "1h", 12 * hour, "bullish", 89.0, 92.0), ("x", "1h", 11 * hour, "bullish", 95.0, 97.0)], f"{key}, made_t long, side string, lo double, hi double")
    found, funnel = chains.trapped_breaks(broken, blocks, b, 1)
    assert [(r.a_t, r.b_t, r.c_t, r.d_t, r.e_t, r.entry_idx) for r in found.collect()] == [(2 * hour, 5 * hour, 8 * hour, 10 * hour, 12 * hour, 13)]
    assert {r.stage: r.n for r in funnel.collect()} == dict.fromkeys("ABCDE", 2)
    none, funnel = chains.trapped_breaks(broken, blocks, b, -1)
    assert none.count() == 0 and {r.stage: r.n for r in funnel.collect()} == {"A": 1}


def test_shifted_marks_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    values, marks = rng.normal(0, 1, 40), rng.random(40) < 0.4
    rows = spark.createDataFrame([("x", i, bool(m), float(v)) for i, (m, v) in enumerate(zip(marks, values, strict=True))], "k string, place long, mark boolean, value double")
    offsets = resampling.shift_offsets(rows, ["k"], 60)
    shifts = {r.rep: r["shift"] for r in offsets.collect()} | {0: 0}
    got = {r.rep: r["diff"] for r in resampling.shifted_means(rows, "mark", "value", offsets, ["k"]).collect()}
    for rep, shift in shifts.items():
        moved = np.roll(marks, shift)
        assert 0 <= shift < 40 and got[rep] == pytest.approx(values[moved].mean() - values[~moved].mean())




def feed(spark, path, rows):
    df = spark.createDataFrame([(i, t, n, p, 1.0) for i, t, n, p in rows], "instrument string, ts long, seq long, price double, volume double")
    df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(path)


def test_streams_go_on_after_a_stop(spark, tmp_path):
    """Bars, steps and a ledger: no row is lost and none comes twice, wherever the stream was stopped."""
    rng = np.random.default_rng(3)
    ticks = [("ab"[i % 2], 60 * i + int(rng.integers(0, 50)), i, float(rng.integers(1, 99))) for i in range(400)]
    for part in (ticks[:150], ticks[150:151], ticks[151:]):
        feed(spark, f"{tmp_path}/ticks", part)
        got_bars = streams.replay(streams.bar_stream(streams.tick_stream(spark, f"{tmp_path}/ticks"), "1h", "10 minutes"), f"{tmp_path}/bars")
        rows = streams.tick_stream(spark, f"{tmp_path}/ticks").select("instrument", F.col("seq").alias("bar_idx"), F.col("price").alias("c"))
        got_steps = streams.replay(streams.stepped(rows, folds.affine(0.5), folds.AFFINE, ["instrument"], "bar_idx"), f"{tmp_path}/steps")
        ledger = streams.tick_stream(spark, f"{tmp_path}/ticks").select((F.col("seq") % 90).alias("id"), F.col("seq").alias("rank"), "price")
        streams.run_batches(ledger, streams.upsert(f"{tmp_path}/ledger", ["id"], "rank", 4), f"{tmp_path}/ledger_checkpoint")
    y = {}
    want = []
    for i, _, n, p in ticks:
        y[i] = p if i not in y else y[i] + 0.5 * (p - y[i])
        want.append((i, n, y[i]))
    assert sorted(map(tuple, got_steps.collect())) == sorted(want)
    hours = {(i, t // 3600) for i, t, _, _ in ticks}
    closed = [(r.instrument, r.t // 3600) for r in got_bars.collect()]
    assert len(closed) == len(set(closed)) and set(closed) == {h for h in hours if (h[1] + 1) * 3600 <= max(t for _, t, _, _ in ticks) - 600}
    kept = {r.id: r["rank"] for r in spark.read.parquet(f"{tmp_path}/ledger").collect()}
    assert kept == {k: max(n for _, _, n, _ in ticks if n % 90 == k) for k in range(90)}


def test_asof_of_two_streams(spark, tmp_path):
    """Each row gets the last other one at or before it, whatever came first, and waits until nothing can come before it."""
    left = [("a", 100, 1), ("a", 250, 2), ("a", 300, 3), ("b", 120, 4), ("a", 90, 5), ("a", 5000, 6)]
    right = [("a", 95, 10), ("a", 260, 20), ("a", 300, 30), ("a", 4000, 40)]
    for name, parts in (("left", (left[:4], left[4:])), ("right", (right[2:], right[:2]))):
        for part in parts:  # not in order
            df = spark.createDataFrame(part, "k string, ts long, v long").withColumn("ts", F.timestamp_seconds("ts"))
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.readStream.schema("k string, ts timestamp, v long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    joined = streams.asof_stream(read("left"), read("right").withColumnRenamed("v", "w"), ["k"], ["w"], "2 hours")
    assert streams.replay(joined, f"{tmp_path}/out").collect() == []  # nothing has passed yet
    for name in ("left", "right"):
        spark.createDataFrame([("~", 90_000, 0)], "k string, ts long, v long").withColumn("ts", F.timestamp_seconds("ts")).write.mode("append").parquet(f"{tmp_path}/{name}")
    got = {(r.k, r.v): r.w_asof for r in streams.replay(joined, f"{tmp_path}/out").collect()}
    assert got == {("a", 1): 10, ("a", 2): 10, ("a", 3): 30, ("b", 4): None, ("a", 5): None, ("a", 6): 40}

"""The library's operators on small hand-made series, and its queries against SQL."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.functions import recursive, windows
from sigframe.operators import aggregates, events, joins, outcomes, resampling, scans, structure, zones
from sigframe.plans.queries import QUERIES, SQL
from sigframe.schema import KEY, bucket

SF = "/root/testdata/sf0.001"


def bars(spark, rows):
    """(o, h, l, c) of one series."""
    return spark.createDataFrame([("x", "1h", 3600 * i, i, *map(float, r), 1.0) for i, r in enumerate(rows)], "instrument string, timeframe string, t long, bar_idx long, o double, h double, l double, c double, v double")


def flat(values):
    return [(v, v, v, v) for v in values]


def test_weeks_begin_on_mondays(spark):
    t = spark.range(1).select(bucket(F.lit(1_700_000_000), 604800, 345600).alias("t")).first().t
    assert np.datetime64(t, "s").astype("datetime64[D]").item().weekday() == 0


@pytest.mark.parametrize(("n", "seed"), [(3, "first"), (3, "sma"), (50, "first"), (200, "sma")])
def test_ema_equals_a_loop(spark, n, seed):
    x = np.random.default_rng(n).normal(100, 5, 700)
    got = [r.e for r in recursive.ema(bars(spark, flat(x)), "c", n, "e", seed).orderBy("bar_idx").collect()]
    y, k = [], 2 / (n + 1)
    for i, v in enumerate(x):
        if seed == "sma":
            y.append(None if i < n - 1 else x[:n].mean() if i == n - 1 else y[-1] + k * (v - y[-1]))
        else:
            y.append(v if i == 0 else y[-1] + k * (v - y[-1]))
    assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)) for a, b in zip(got, y, strict=True))


def test_bounded_windows_equal_plain_ones(spark):
    b = bars(spark, flat(np.random.default_rng(1).normal(0, 1, 300)))
    cut = windows.bounded(b, 20, lambda w: {"m": windows.sma("c", 20, w)}, block=32).orderBy("bar_idx").collect()
    plain = b.withColumn("m", windows.sma("c", 20, windows.series())).orderBy("bar_idx").collect()
    assert [r.bar_idx for r in cut] == [r.bar_idx for r in plain]
    assert all((a.m is None) == (p.m is None) and (a.m is None or abs(a.m - p.m) < 1e-12) for a, p in zip(cut, plain, strict=True))


def test_flat_ranges_do_not_divide(spark):
    b = bars(spark, flat([5.0] * 30)).withColumn("step", F.lit(0.0))
    r = b.withColumns({"k": windows.stochastic(windows.series()), "m": windows.money_flow("step", windows.series())}).orderBy(F.desc("bar_idx")).first()
    assert (r.k, r.m) == (0.0, 100.0)


def test_a_stop_comes_before_a_target(spark):
    b = bars(spark, [(10, 11, 9, 10), (10, 11, 9, 10), (10, 15, 5, 10)])
    t = spark.createDataFrame([(1, "x", "1h", 0, "bullish", 1, 10.0, 8.0)], "event_id long, instrument string, timeframe string, bar_idx long, side string, entry_idx long, entry double, stop double")
    r = outcomes.barriers(t, b).first()
    assert (r.exit_reason, r.exit_idx, r.r) == ("stop", 2, -1.0)


def test_first_hit_over_blocks(spark):
    x = np.random.default_rng(3).normal(0, 1, 2000).cumsum()
    b = bars(spark, flat(x))
    ev = [(i, "x", "1h", int(s), float(x[s] + d)) for i, (s, d) in enumerate(zip(np.random.default_rng(4).integers(0, 1999, 60), np.linspace(0.1, 20, 60), strict=True))]
    df = spark.createDataFrame(ev, "id long, instrument string, timeframe string, s long, level double")
    got = {r.id: r.hit_idx for r in joins.first_hit(df, b, KEY, "s", "level", "c", True, "id", block=64).collect()}
    for i, _, _, s, level in ev:
        hits = np.flatnonzero(x[s:] > level)
        assert got.get(i) == (s + int(hits[0]) if len(hits) else None)


def test_first_hit_within_some_bars(spark):
    x = np.random.default_rng(6).normal(0, 1, 900).cumsum()
    b = bars(spark, flat(x))
    ev = [(i, "x", "1h", int(s), float(x[s] - 1.5)) for i, s in enumerate(np.random.default_rng(7).integers(0, 899, 60))]
    df = spark.createDataFrame(ev, "id long, instrument string, timeframe string, s long, level double")
    got = {r.id: r.hit_idx for r in joins.first_hit(df, b, KEY, "s", "level", "c", False, "id", most=20, block=16).collect()}
    for i, _, _, s, level in ev:
        hits = np.flatnonzero(x[s : s + 21] < level)
        assert got.get(i) == (s + int(hits[0]) if len(hits) else None)


def test_levels_near_a_price(spark):
    rng = np.random.default_rng(8)
    lows = rng.uniform(50, 150, 80)
    levels = [("x", float(v), float(v + h), "bullish", int(k), None) for v, h, k in zip(lows, rng.choice([0.0, 0.5, 9.0], 80), rng.integers(0, 50, 80), strict=True)]
    marks = [("x", int(k), float(p)) for k, p in zip(rng.integers(0, 60, 60), rng.uniform(50, 150, 60), strict=True)]
    a = spark.createDataFrame(levels, "k string, lo double, hi double, side string, known_at long, ended_at long")
    m = spark.createDataFrame(marks, "k string, at long, price double")
    got = sorted((r.at, r.price, r.lo) for r in zones.levels_near(a, m, 0.02, ["k"]).collect())
    away = lambda p, lo, hi: max(lo - p, p - hi, 0.0) / p
    assert got == sorted((t, p, lo) for _, t, p in marks for _, lo, hi, _, k, _ in levels if k <= t and away(p, lo, hi) <= 0.02)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("span", [None, 7])
def test_asof(spark, direction, strict, span):
    rng = np.random.default_rng(5)
    left, right = sorted(map(int, rng.integers(0, 60, 40))), sorted({int(v) for v in rng.integers(0, 60, 12)})
    a = spark.createDataFrame([("x", t) for t in left], "k string, t long")
    b = spark.createDataFrame([("x", t, t * 10) for t in right], "k string, u long, v long")
    got = sorted((r.t, r.v_asof if r.v_asof is not None else -1) for r in joins.asof(a, b, ["k"], "t", "u", ["v"], direction, strict, span).collect())
    pick = lambda t: [u for u in right if (u < t or (u == t and not strict))] if direction == "backward" else [u for u in right if (u > t or (u == t and not strict))]
    want = sorted((t, (max if direction == "backward" else min)(p) * 10 if (p := pick(t)) else -1) for t in left)
    assert got == want


def test_touches_and_near_misses(spark):
    b = bars(spark, [(10, 10, 10, 10), (6, 6.5, 5.5, 6), (5, 5.2, 4.5, 5), (6, 6.6, 6.1, 6.2), (4, 6, 4, 4.5), (4, 5, 4, 4)])
    z = spark.createDataFrame([(1, "x", "1h", "bullish", 5.0, 6.0, 0, None)], "zone_id long, instrument string, timeframe string, side string, lo double, hi double, from_idx long, to_idx long")
    got = sorted((r.start_idx, r.end_idx, r.approach, r.outcome, r.ongoing) for r in zones.interactions(z, b).collect())
    assert got == [(1, 2, "above", "held", False), (4, 5, "above", "held", True)]
    miss = zones.near_misses(z, b, 0.05).collect()
    assert [(r.start_idx, r.where) for r in miss] == [(3, "above")]


def test_breaks_of_both_sides_take_the_bias_before(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 3, 400).cumsum() + 300
    b = bars(spark, [(v, v + 2, v - 2, v) for v in x])
    got = structure.breaks(structure.swings(b, 5, "swing"), "swing").orderBy("bar_idx").collect()
    bias = 0
    for r in got:
        side = 1 if r.side == "bullish" else -1
        assert (r.type == "CHOCH") == (bias == -side)
        bias = side


def test_generator_and_permutations(spark):
    def sequential(seed, n):
        out, a = [], seed
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.append(((t ^ t >> 14) & 0xFFFFFFFF) / 2**32)
        return out

    got = [r.u for r in spark.range(1, 1001).select(resampling.draw(F.col("id")).alias("u"), "id").orderBy("id").collect()]
    assert got == sequential(42, 1000)
    units = spark.createDataFrame([(i, i % 2, 10, 8 if i % 2 else 2) for i in range(40)], "unit long, label int, n long, w long")
    gaps = {r.rep: r.gap for r in resampling.permuted_gap(units, "label", "n", "w", 20).collect()}
    assert gaps[0] == pytest.approx(0.6) and max(v for k, v in gaps.items() if k) < 0.6


def test_flips_alternate(spark):
    x = np.random.default_rng(11).normal(0, 1, 600).cumsum() + 100
    got = events.flips(scans.supertrend(bars(spark, [(v, v + 0.5, v - 0.5, v) for v in x])), "direction").orderBy("bar_idx").collect()
    assert got and all(a.direction != b.direction for a, b in zip(got, got[1:], strict=False))


def test_binomial_and_corrections(spark):
    r = spark.range(1).select(resampling.binomial_tail(F.lit(6), F.lit(10), 0.5).alias("p")).first()
    assert r.p == pytest.approx(386 / 1024)


def test_concurrency_counts(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 0, 0), ("a", 3, 9), ("a", 5, 6)], "k string, e long, x long")
    got = sorted((r.e, r.x, r.others) for r in aggregates.concurrent(df, ["k"], "e", "x").collect())
    assert got == [(0, 0, 1), (0, 5, 0), (3, 9, 1), (5, 6, 1)]


def _plain(values):
    return sorted(tuple("-" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", ["b_rollup_bars", "b_phased_buckets", "s_dedupe_and_order", "x_row_expressions", "w_indicators", "e_point_events", "p_gaps", "j_asof_closed", "q_draws", "q_corrections", "a_agreement", "c_confirmations", "c_nested_depth", "c_watchlist", "q_displaced", "q_matched_draws", "z_cells_to_lines"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _plain(got[columns].astype(object).where(got[columns].notna(), None).values.tolist()) == _plain(want[columns].astype(object).where(want[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", ["f_filters", "r_cycles", "p_balanced_ranges", "e_tiers", "c_agreement_depth", "l_costs", "q_random_subsets", "m_repaired"])
def test_later_queries_equal_sql(spark, name):
    test_queries_equal_sql(spark, name)


def test_filters_equal_a_loop(spark):
    x = np.random.default_rng(3).normal(0, 1, 1500)
    b = recursive.super_smoother(recursive.high_pass(bars(spark, flat(x)), "c", 48, "hp"), "c", 10, "low")
    got = b.orderBy("bar_idx").collect()
    w = 0.707 * 2 * np.pi / 48
    alpha = (np.cos(w) + np.sin(w) - 1) / np.cos(w)
    a, turn = np.exp(-np.sqrt(2) * np.pi / 10), np.sqrt(2) * np.pi / 10
    hp, low = np.zeros(1502), np.zeros(1502)
    v = np.r_[0, 0, x]
    for i in range(2, 1502):
        hp[i] = 2 * (1 - alpha) * hp[i - 1] - (1 - alpha) ** 2 * hp[i - 2] + (1 - alpha / 2) ** 2 * (v[i] - 2 * v[i - 1] + v[i - 2])
        low[i] = 2 * a * np.cos(turn) * low[i - 1] - a * a * low[i - 2] + (1 - 2 * a * np.cos(turn) + a * a) / 2 * (v[i] + v[i - 1])
    assert np.abs(np.array([r.hp for r in got]) - hp[2:]).max() < 1e-9 and np.abs(np.array([r.low for r in got]) - low[2:]).max() < 1e-9


def test_three_means_of_many_rows(spark):
    x = np.random.default_rng(4).normal(0, 1, 300)
    got = bars(spark, flat(x)).withColumn("m", windows.three_means("c", windows.series(), 50)).orderBy("bar_idx").collect()
    assert all(r.m is None for r in got[:49])
    for r in got[49::37]:
        v = x[r.bar_idx - 49 : r.bar_idx + 1]
        at = v.min() + (v.max() - v.min()) * np.array([0.75, 0.5, 0.25])
        for _ in range(200):
            d = np.abs(v[:, None] - at)
            at = np.array([v[d[:, k] == d.min(1)].mean() for k in range(3)])
        assert np.allclose(r.m, at)

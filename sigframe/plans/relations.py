"""Registered queries over joins, zones, outcomes, statistics, folds and streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import recursive, windows
from ..operators import aggregates as A
from ..operators import bars as B
from ..operators import compose as C
from ..operators import events as E
from ..operators import joins as J
from ..operators import outcomes as O
from ..operators import resampling as R
from ..operators import structure as P
from ..operators import zones as Z
from ..schema import KEY, SECONDS
from ..sources import tables as S
from ..streaming import streams as M
from .series import _BLOCKS, _SWING, BARS, W, hourly, register, rounded

c = F.col

_DAYS = f"""{BARS}, days AS (SELECT instrument, t - t % 86400 AS t, first(o ORDER BY t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY t) AS c FROM bars GROUP BY 1, 2)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.indexed(B.rollup(B.from_ticks(S.ticks(spark, sf_dir)), ["1d"]))


def blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order blocks as zones, and the bars. What first-hit joins read several times is kept, so plans stay small."""
    b = hourly(spark, sf_dir)
    ob = S.kept(P.order_blocks(P.breaks(P.swings(b, 5, "swing"), "swing"), b))
    ob = P.mitigated(ob, b)
    zones = ob.select(c("block_id").alias("zone_id"), *KEY, "side", c("bar_low").alias("lo"), c("bar_high").alias("hi"), c("created_idx").alias("from_idx"), c("mitigated_idx").alias("to_idx"))
    return S.kept(zones), b


@register(f"""WITH {_DAYS} SELECT b.instrument, b.t, max(d.t) AS day, round(arg_max(d.c, d.t), 6) AS day_close FROM bars b LEFT JOIN days d ON d.instrument = b.instrument AND d.t + 86400 <= b.t + 3600 GROUP BY 1, 2""")
def j_asof_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the last daily bar that had closed when it closed."""
    b = hourly(spark, sf_dir).withColumn("at", c("t") + 3600)
    got = C.snapshot(b, {"1d": daily(spark, sf_dir)}, ["c"])
    return rounded(got.select("instrument", "t", (c("1d_known_at") - 86400).alias("day"), c("1d_c").alias("day_close")))


@register(f"""WITH {_SWING} SELECT b.instrument, b.bar_idx, max(CASE WHEN k.bar_idx <= b.bar_idx THEN k.bar_idx END) AS before_idx, min(CASE WHEN k.bar_idx > b.bar_idx THEN k.bar_idx END) AS after_idx FROM bars b LEFT JOIN (SELECT DISTINCT instrument, bar_idx FROM brk) k ON k.instrument = b.instrument GROUP BY 1, 2""")
def j_asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last break at or before a bar, the first one after it, by spans of the key."""
    b = hourly(spark, sf_dir)
    k = P.breaks(P.swings(b, 5, "swing"), "swing").select("instrument", c("bar_idx").alias("k"), c("bar_idx").alias("v"))
    before = J.asof(b.select("instrument", "bar_idx"), k, ["instrument"], "bar_idx", "k", ["v"], span=128).select("instrument", "bar_idx", c("v_asof").alias("before_idx"))
    return J.asof(before, k, ["instrument"], "bar_idx", "k", ["v"], "forward", True, 128).select("instrument", "bar_idx", "before_idx", c("v_asof").alias("after_idx"))


@register(f"""WITH {_BLOCKS}, z AS (SELECT ob.*, (SELECT min(b.bar_idx) FROM bars b WHERE b.instrument = ob.instrument AND b.bar_idx >= created_idx AND CASE WHEN ob.side = 'bullish' THEN b.l < bar_low ELSE b.h > bar_high END) AS m FROM ob)
SELECT b.instrument, b.bar_idx, CAST(count(CASE WHEN z.side = 'bullish' THEN 1 END) AS BIGINT) AS bull_zones, CAST(count(CASE WHEN z.side = 'bearish' THEN 1 END) AS BIGINT) AS bear_zones, CAST(count(CASE WHEN bar_low > b.c THEN 1 END) AS BIGINT) AS zones_above, CAST(count(CASE WHEN bar_high < b.c THEN 1 END) AS BIGINT) AS zones_below, coalesce(bool_or(bar_low <= b.c AND b.c <= bar_high), false) AS in_zone
FROM bars b LEFT JOIN z ON z.instrument = b.instrument AND b.bar_idx > z.created_idx AND b.bar_idx <= coalesce(z.m, 1000000000) GROUP BY 1, 2""")
def z_standing_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing zones at each bar, by side and place."""
    z, b = blocks(spark, sf_dir)
    counts = Z.standing_counts(z, b).withColumn("atr", F.lit(1.0))
    return Z.nearby(z, counts, "atr").select("instrument", "bar_idx", "bull_zones", "bear_zones", "zones_above", "zones_below", "in_zone")


@register(f"""WITH {_BLOCKS}, z AS (SELECT ob.*, (SELECT min(b.bar_idx) FROM bars b WHERE b.instrument = ob.instrument AND b.bar_idx >= created_idx AND CASE WHEN ob.side = 'bullish' THEN b.l < bar_low ELSE b.h > bar_high END) AS m FROM ob),
p AS (SELECT *, lag(c) OVER {W} AS pc FROM bars), x AS (SELECT z.instrument, z.side, z.created_idx, z.bar_low, z.bar_high, z.m, b.bar_idx, b.l, b.h, b.pc, b.bar_idx - row_number() OVER (PARTITION BY z.instrument, z.side, z.created_idx ORDER BY b.bar_idx) AS run FROM z JOIN p b ON b.instrument = z.instrument AND b.bar_idx > created_idx AND b.bar_idx <= coalesce(m, 1000000000) AND b.l <= bar_high AND b.h >= bar_low),
g AS (SELECT instrument, side, created_idx, bar_low, bar_high, m, run, min(bar_idx) AS start_idx, max(bar_idx) AS end_idx, count(*) AS bars_count, min(l) AS ml, max(h) AS mh, arg_min(pc, bar_idx) AS pc FROM x GROUP BY ALL)
SELECT instrument, side, start_idx, end_idx, bars_count, CASE WHEN pc > bar_high THEN 'above' WHEN pc < bar_low THEN 'below' ELSE 'inside' END AS approach, CASE WHEN m IS NOT NULL AND end_idx >= m THEN 'broken' ELSE 'held' END AS outcome,
round(least(1.0, greatest(0.0, CASE WHEN pc < bar_low THEN (mh - bar_low) / (bar_high - bar_low) ELSE (bar_high - ml) / (bar_high - bar_low) END)), 6) AS max_penetration FROM g WHERE bar_high > bar_low""")
def z_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of bars that touch a zone."""
    z, b = blocks(spark, sf_dir)
    return rounded(Z.interactions(z.where("hi > lo"), b).select("instrument", "side", "start_idx", "end_idx", "bars_count", "approach", "outcome", "max_penetration"))


@register(f"""WITH {BARS}, x AS (SELECT *, lag(h, 3) OVER {W} AS h3 FROM bars), v AS (SELECT instrument, bar_idx, h3 AS level FROM (SELECT *, count(h) OVER p AS n, max(h) OVER p AS a, max(h) OVER q AS b FROM x WINDOW p AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING), q AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3 AND h3 > a AND h3 > b),
s AS (SELECT v.instrument, v.bar_idx AS from_idx, level, min(b.bar_idx) AS sweep_idx FROM v LEFT JOIN bars b ON b.instrument = v.instrument AND b.bar_idx >= v.bar_idx AND b.h > level GROUP BY 1, 2, 3),
r AS (SELECT s.instrument, from_idx, s.level, sweep_idx, min(b.bar_idx) AS reversal_idx FROM s LEFT JOIN bars b ON b.instrument = s.instrument AND b.bar_idx >= sweep_idx AND b.bar_idx <= sweep_idx + 10 AND b.c < s.level GROUP BY 1, 2, 3, 4)
SELECT instrument, from_idx, round(level, 6) AS level, CASE WHEN sweep_idx IS NULL THEN 'untouched' WHEN reversal_idx IS NULL THEN 'swept' ELSE 'swept_reversed' END AS status, sweep_idx - from_idx AS bars_to_sweep, reversal_idx - sweep_idx AS bars_to_reversal FROM r""")
def z_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, the bar that takes each and the close that comes back within ten bars."""
    b = hourly(spark, sf_dir)
    levels = b.withColumn("level", P.pivot("h", 3, 3, windows.series())).where("level IS NOT NULL").select(*KEY, c("bar_idx").alias("from_idx"), "level", F.lit("EQH").alias("side"), F.xxhash64("instrument", "bar_idx").alias("level_id"))
    return rounded(Z.sweeps(levels, b).select("instrument", "from_idx", "level", "status", "bars_to_sweep", "bars_to_reversal"))


@register(f"""WITH {_BLOCKS} SELECT a.instrument, a.side, a.created_idx, count(b.created_idx) + 1 AS recurrence, min(least(a.created_idx, coalesce(b.created_idx, a.created_idx))) AS first_idx, CASE WHEN bool_or(a.bar_low >= b.bar_low AND a.bar_high <= b.bar_high) THEN 'engulfed' WHEN bool_or(a.bar_low <= b.bar_low AND a.bar_high >= b.bar_high) THEN 'engulfing' WHEN count(b.created_idx) > 0 THEN 'partial' ELSE 'isolated' END AS relation
FROM ob a LEFT JOIN ob b ON a.instrument = b.instrument AND a.side = b.side AND a.created_idx <> b.created_idx AND a.bar_low <= b.bar_high AND b.bar_low <= a.bar_high AND a.created_idx <= b.created_idx + 50 AND b.created_idx <= a.created_idx + 50 GROUP BY ALL""")
def j_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that share a price within 50 bars, how many, which holds which, and the first of them."""
    z, _ = blocks(spark, sf_dir)
    z = S.kept(z.withColumn("to_idx", c("from_idx") + 50))
    pairs = S.kept(J.overlaps(z, [*KEY, "side"], "zone_id", "lo", "hi", "from_idx", "to_idx", 128))
    out = z.join(C.recurrence(z, pairs), "zone_id").join(J.containment(z, pairs, "zone_id", "lo", "hi"), "zone_id").join(J.originator(z, pairs, "zone_id", "from_idx"), "zone_id")
    first = z.select(c("zone_id").alias("origin"), c("from_idx").alias("first_idx"))
    return out.join(first, "origin").select("instrument", "side", c("from_idx").alias("created_idx"), "recurrence", "first_idx", "relation")


@register(f"""WITH {_SWING}, e AS (SELECT instrument, t, side, level FROM brk) SELECT a.instrument, a.t, a.side, CAST(count(DISTINCT CASE WHEN abs(b.level - a.level) <= 0.01 * greatest(a.level, b.level) THEN b.t END) AS BIGINT) AS same_price, max(CASE WHEN b.t < a.t AND b.t >= a.t - 36000 THEN 1 ELSE 0 END) AS recent FROM e a JOIN e b ON a.instrument = b.instrument AND a.side = b.side WHERE a.level > 0 AND b.level > 0 GROUP BY 1, 2, 3""")
def j_band_and_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks at one price, and whether there was one shortly before."""
    b = hourly(spark, sf_dir)
    e = P.breaks(P.swings(b, 5, "swing"), "swing").where("level > 0").select("instrument", "t", "side", "level")
    e = e.withColumn("id", F.xxhash64("instrument", "t", "side"))
    n = J.price_band(e, e.select("instrument", "side", c("t").alias("bt"), "level"), ["instrument", "side"], "id", "bt", "level", 0.01).groupBy(c("a").alias("id")).agg(F.countDistinct("b").alias("same_price"))
    near = J.nearest(e.withColumn("u", c("t") - 18000), e.select("instrument", "side", c("t").alias("w"), c("t").alias("wt")), ["instrument", "side"], "u", "w", 18000, ["wt"])
    recent = near.select("id", F.when(c("wt_near").isNotNull() & (c("wt_near") < c("t")), 1).otherwise(0).alias("recent"))
    # The nearest one may be the break itself, at the edge of the window; then an earlier one is looked for by a semi-join.
    before = e.alias("a").join(e.alias("b"), (c("a.instrument") == c("b.instrument")) & (c("a.side") == c("b.side")) & (F.floor(c("a.t") / 36000) - F.floor(c("b.t") / 36000)).isin(0, 1) & (c("b.t") < c("a.t")) & (c("b.t") >= c("a.t") - 36000), "left_semi").select("id").withColumn("again", F.lit(1))
    return e.join(n, "id").join(recent, "id").join(before, "id", "left").select("instrument", "t", "side", "same_price", F.greatest("recent", F.coalesce("again", F.lit(0))).alias("recent"))


@register(f"""WITH {_BLOCKS}, z AS (SELECT ob.instrument, ob.side, created_idx, bar_low, bar_high, (SELECT min(b.bar_idx) FROM bars b WHERE b.instrument = ob.instrument AND b.bar_idx >= created_idx AND CASE WHEN ob.side = 'bullish' THEN b.l < bar_low ELSE b.h > bar_high END) AS m FROM ob), p AS (SELECT *, lead(c, 12) OVER {W} - c AS move FROM bars),
h AS (SELECT z.instrument, z.side, z.created_idx, min(b.bar_idx) AS hit FROM z JOIN bars b ON b.instrument = z.instrument AND b.bar_idx > z.m AND CASE WHEN z.side = 'bullish' THEN b.h > bar_low ELSE b.l < bar_high END GROUP BY 1, 2, 3)
SELECT h.instrument, h.side, created_idx, hit AS hit_idx, round(CASE WHEN h.side = 'bullish' THEN -move ELSE move END, 6) AS reaction FROM h JOIN p ON p.instrument = h.instrument AND p.bar_idx = h.hit""")
def z_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first return to a mitigated zone and the move after it."""
    z, b = blocks(spark, sf_dir)
    return rounded(Z.returns_after(z, b).select("instrument", "side", c("from_idx").alias("created_idx"), "hit_idx", "reaction"))


def trades(spark: SparkSession, sf_dir: str, on_timeout: str = "close") -> tuple[DataFrame, DataFrame]:
    """Breaks entered at the next open, with a stop at the bar's far end."""
    b = hourly(spark, sf_dir)
    k = P.breaks(P.swings(b, 5, "swing"), "swing").withColumn("event_id", F.xxhash64("instrument", "side", "bar_idx")).select("event_id", *KEY, "bar_idx", "side")
    e = O.entries(k, b).join(b.select(*KEY, "bar_idx", "h", "l"), [*KEY, "bar_idx"]).withColumn("stop", F.when(c("side") == "bullish", c("l") - 5).otherwise(c("h") + 5)).drop("h", "l")
    return S.kept(O.barriers(S.kept(e), b, 1.0, 50, on_timeout)), b


_TRADES = f"""{_SWING}, e AS (SELECT k.instrument, k.side, k.bar_idx, n.bar_idx AS ei, n.o AS entry, CASE WHEN k.side = 'bullish' THEN b.l - 5 ELSE b.h + 5 END AS stop, CASE WHEN k.side = 'bullish' THEN 1 ELSE -1 END AS s FROM brk k JOIN bars b ON b.instrument = k.instrument AND b.bar_idx = k.bar_idx JOIN bars n ON n.instrument = k.instrument AND n.bar_idx = k.bar_idx + 1),
f AS (SELECT *, s * (entry - stop) AS risk, entry + s * (s * (entry - stop)) AS target FROM e WHERE s * (entry - stop) > 0),
g AS (SELECT f.instrument, f.side, f.bar_idx, ei, entry, stop, s, risk, target, min(CASE WHEN CASE WHEN s = 1 THEN b.l <= stop ELSE b.h >= stop END THEN b.bar_idx END) AS si, min(CASE WHEN CASE WHEN s = 1 THEN b.h >= target ELSE b.l <= target END THEN b.bar_idx END) AS ti, max(b.bar_idx) AS li, arg_max(b.c, b.bar_idx) AS lc FROM f JOIN bars b ON b.instrument = f.instrument AND b.bar_idx BETWEEN ei AND ei + 50 GROUP BY ALL),
tr AS (SELECT *, CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'stop' WHEN ti IS NOT NULL THEN 'target' ELSE 'timeout' END AS why FROM g),
t2 AS (SELECT *, CASE why WHEN 'stop' THEN si WHEN 'target' THEN ti ELSE li END AS xi, CASE why WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE lc END AS ex FROM tr), trades AS (SELECT *, s * (ex - entry) / risk AS r, s * (ex - entry) / entry * 100 AS pnl, xi - ei AS held FROM t2)"""


@register(f"WITH {_TRADES} SELECT instrument, side, bar_idx, ei AS entry_idx, why AS exit_reason, xi AS exit_idx, round(ex, 6) AS exit, round(r, 5) AS r, round(pnl, 5) AS pnl_pct, held AS bars_held FROM trades")
def l_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop, target or time-out, the stop first."""
    t, _ = trades(spark, sf_dir)
    return rounded(t.withColumns({"r": F.round("r", 5), "pnl_pct": F.round("pnl_pct", 5)}).select("instrument", "side", "bar_idx", "entry_idx", "exit_reason", "exit_idx", "exit", "r", "pnl_pct", "bars_held"))


@register(f"""WITH {_TRADES} SELECT instrument, count(*) AS n, CAST(count(CASE WHEN side = 'bullish' THEN 1 END) AS BIGINT) AS longs, CAST(count(CASE WHEN pnl > 0 THEN 1 END) AS BIGINT) AS wins, round(avg(CASE WHEN pnl > 0 THEN pnl END), 4) AS avg_win, round(avg(CASE WHEN pnl <= 0 THEN pnl END), 4) AS avg_loss, round(avg(pnl), 4) AS expectancy, round(avg(held), 4) AS avg_bars,
round(count(CASE WHEN pnl > 0 THEN 1 END) * 100.0 / count(*), 4) AS win_rate, round(sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl <= 0 THEN pnl END), 0), 4) AS profit_factor FROM trades GROUP BY 1""")
def a_trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of trades."""
    t, _ = trades(spark, sf_dir)
    return rounded(A.metrics(t, ["instrument"]), places=4)


@register(f"""WITH {_TRADES}, o AS (SELECT instrument, ei, xi, (SELECT count(*) FROM trades z WHERE z.instrument = y.instrument AND z.ei <= y.ei AND z.xi > y.ei) - CASE WHEN xi > ei THEN 1 ELSE 0 END AS others FROM trades y) SELECT instrument, ei AS entry_idx, xi AS exit_idx, count(*) AS n, CAST(sum(others) AS BIGINT) AS others FROM o GROUP BY 1, 2, 3""")
def a_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other trades open at each entry, from running sums."""
    t, _ = trades(spark, sf_dir)
    return A.concurrent(t, ["instrument"], "entry_idx", "exit_idx").groupBy("instrument", "entry_idx", "exit_idx").agg(F.count("*").alias("n"), F.sum("others").alias("others"))


@register(f"""WITH {_TRADES}, y AS (SELECT *, max(xi) OVER (PARTITION BY instrument ORDER BY ei, xi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM trades), z AS (SELECT *, sum(CASE WHEN ei < m THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY ei, xi ROWS UNBOUNDED PRECEDING) AS k FROM y)
SELECT instrument, min(ei) AS start, max(xi) AS "end", count(*) AS n, round(avg(pnl), 4) AS mean_pnl FROM z GROUP BY instrument, k""")
def a_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of overlapping trades."""
    t, _ = trades(spark, sf_dir)
    return rounded(A.overlap_clusters(t, ["instrument"], "entry_idx", "exit_idx", "pnl_pct").drop("cluster"), places=4)


@register(f"""WITH {_TRADES}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bar_idx) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM trades), cut AS (SELECT instrument, max(CASE WHEN i = floor(n * 0.7) THEN bar_idx END) AS cut FROM k GROUP BY 1)
SELECT instrument, CASE WHEN bar_idx < cut THEN 'in' ELSE 'out' END AS sample, count(*) AS n, round(avg(pnl), 4) AS expectancy FROM trades JOIN cut USING (instrument) GROUP BY 1, 2""")
def a_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In and out of sample at the 70 % rank."""
    t, _ = trades(spark, sf_dir)
    return A.split_by_rank(t, ["instrument"], "bar_idx").groupBy("instrument", "sample").agg(F.count("*").alias("n"), F.round(F.avg("pnl_pct"), 4).alias("expectancy"))


@register(f"""WITH {BARS}, f AS (SELECT *, lead(c, 5) OVER {W} - c AS fwd FROM bars), d AS (SELECT *, rank() OVER (PARTITION BY instrument ORDER BY c) + (count(*) OVER (PARTITION BY instrument, c) - 1) / 2.0 AS rc, rank() OVER (PARTITION BY instrument ORDER BY fwd) + (count(*) OVER (PARTITION BY instrument, fwd) - 1) / 2.0 AS rf FROM f WHERE fwd IS NOT NULL)
SELECT instrument, count(*) AS n, round(corr(rc, rf), 6) AS rho FROM d GROUP BY 1""")
def a_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward moves and the correlation of ranks."""
    return rounded(A.spearman(O.forward_return(hourly(spark, sf_dir), 5), "c", "fwd", ["instrument"]))


@register(f"""WITH {BARS}, x AS (SELECT instrument, CAST(c > o AS INT) AS up, CAST(lead(c) OVER {W} > lead(o) OVER {W} AS INT) AS nxt FROM bars), k AS (SELECT instrument, up, nxt, count(*) AS n FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT *, sum(n) OVER (PARTITION BY instrument) AS t, sum(n) OVER (PARTITION BY instrument, up) AS a, sum(n) OVER (PARTITION BY instrument, nxt) AS b FROM k)
SELECT instrument, round(sum(n / t * log2(n * t / (a * b))), 6) AS mi, round(-sum(n / t * log2(a / t)), 6) AS h_x, round(-sum(n / t * log2(b / t)), 6) AS h_y FROM p GROUP BY 1""")
def q_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by state and outcome, mutual information and entropies."""
    w = windows.series()
    b = hourly(spark, sf_dir).select("instrument", (c("c") > c("o")).cast("int").alias("up"), (F.lead("c").over(w) > F.lead("o").over(w)).cast("int").alias("nxt")).where("nxt IS NOT NULL")
    return rounded(A.information(A.contingency(b, "instrument", "up", "nxt"), ["instrument"], "up", "nxt", "n").drop("nmi"))


@register("""WITH k AS (SELECT event_id + 1 AS k FROM events), a AS (SELECT k, (42 + k * 1831565813) % 4294967296 AS a FROM k), b AS (SELECT k, CAST((xor(a, a // 32768)::HUGEINT * (a | 1)::HUGEINT) % 4294967296 AS BIGINT) AS t FROM a), d AS (SELECT k, xor(t, (t + CAST((xor(t, t // 128)::HUGEINT * (t | 61)::HUGEINT) % 4294967296 AS BIGINT)) % 4294967296) AS t FROM b)
SELECT k, xor(t, t // 16384) / 4294967296.0::DOUBLE AS u FROM d""")
def q_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q0: draws of the seeded generator by their number."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((c("event_id") + 1).alias("k")).select("k", R.draw(c("k")).alias("u"))


@register(f"""WITH {BARS}, u AS (SELECT instrument, t // 86400 AS day, count(*) AS n, count(CASE WHEN c > o THEN 1 END) AS w FROM bars GROUP BY 1, 2) SELECT instrument, CAST(sum(n) AS BIGINT) AS n, round((sum(n) * sum(n * w)::DOUBLE - sum(n * n) * sum(w)::DOUBLE) / sqrt((sum(n) * sum(n * n * n)::DOUBLE - sum(n * n)::DOUBLE * sum(n * n)) * (sum(n) * sum(w)::DOUBLE - sum(w)::DOUBLE * sum(w))), 6) AS r FROM u GROUP BY 1""")
def q_point_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: correlation of a unit's size with single wins, from counts."""
    u = hourly(spark, sf_dir).groupBy("instrument", F.floor(c("t") / 86400).alias("day")).agg(F.count("*").alias("n"), F.count(F.when(c("c") > c("o"), 1)).alias("w")).withColumn("x", c("n").cast("double"))
    return rounded(R.point_biserial(u, "x", "n", "w", ["instrument"]))


@register(f"""WITH {BARS}, x AS (SELECT *, lead(c, 5) OVER {W} - c AS f FROM bars), g AS (SELECT instrument, avg(CASE WHEN c > o THEN f END) AS ma, avg(CASE WHEN c <= o THEN f END) AS mb, var_samp(CASE WHEN c > o THEN f END) AS va, var_samp(CASE WHEN c <= o THEN f END) AS vb, count(CASE WHEN c > o THEN f END) AS na, count(CASE WHEN c <= o THEN f END) AS nb FROM x GROUP BY 1) SELECT instrument, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t FROM g""")
def q_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13, L1: difference of mean moves after up and down bars."""
    return rounded(R.welch(O.forward_return(hourly(spark, sf_dir), 5), "fwd", c("c") > c("o"), ["instrument"]).select("instrument", "t"))


_HP = 0.707 * 2 * math.pi / 48
_ALPHA = (math.cos(_HP) + math.sin(_HP) - 1) / math.cos(_HP)
_HK = (1 - _ALPHA / 2) ** 2
_SA, _ST = math.exp(-math.sqrt(2) * math.pi / 10), math.sqrt(2) * math.pi / 10
_SK = (1 - 2 * _SA * math.cos(_ST) + _SA * _SA) / 2


@register(f"""WITH RECURSIVE {BARS}, x AS (SELECT instrument, bar_idx, c, coalesce(lag(c) OVER {W}, 0) AS c1, coalesce(lag(c, 2) OVER {W}, 0) AS c2 FROM bars),
r AS (SELECT instrument, bar_idx, {_HK!r}::DOUBLE * c AS hp, 0.0::DOUBLE AS hp1, {_SK!r}::DOUBLE * {_HK!r}::DOUBLE * c AS s, 0.0::DOUBLE AS s1, greatest(abs({_SK!r}::DOUBLE * {_HK!r}::DOUBLE * c), 0) AS peak FROM x WHERE bar_idx = 0
UNION ALL SELECT q.instrument, q.bar_idx, q.hp, q.hp1, q.s, q.s1, greatest(0.991::DOUBLE * q.peak, abs(q.s)) FROM (SELECT p.instrument, p.bar_idx, p.hp, p.hp1, {2 * _SA * math.cos(_ST)!r}::DOUBLE * p.s0 - {_SA * _SA!r}::DOUBLE * p.s1 + {_SK!r}::DOUBLE * (p.hp + p.hp1) AS s, p.s0 AS s1, p.peak
 FROM (SELECT x.instrument, x.bar_idx, {2 * (1 - _ALPHA)!r}::DOUBLE * r.hp - {(1 - _ALPHA) ** 2!r}::DOUBLE * r.hp1 + {_HK!r}::DOUBLE * (x.c - 2 * x.c1 + x.c2) AS hp, r.hp AS hp1, r.s AS s0, r.s1, r.peak FROM r JOIN x ON x.instrument = r.instrument AND x.bar_idx = r.bar_idx + 1) p) q)
SELECT instrument, bar_idx, round(hp + 1e-9, 4) AS hp, round(s + 1e-9, 4) AS smooth, round(peak + 1e-9, 4) AS peak FROM r""")
def f_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High pass, smoother and decaying peak of the close, by affine scans."""
    b = recursive.super_smoother(recursive.high_pass(hourly(spark, sf_dir), "c", 48, "hp"), "hp", 10, "smooth")
    b = b.withColumn("peak", recursive.peak("smooth", 0.991))
    return rounded(b.withColumns({k: c(k) + 1e-9 for k in ("hp", "smooth", "peak")}), "instrument", "bar_idx", "hp", "smooth", "peak", places=4)

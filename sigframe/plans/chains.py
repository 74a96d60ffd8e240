"""Registered queries over ordered chains of conditions, structural exits, races, wick triggers and equity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recursive
from ..operators import aggregates as A
from ..operators import chains as H
from ..operators import outcomes as O
from ..operators import structure as P
from ..schema import KEY
from ..sources import tables as S
from .relations import _TRADES, trades
from .scanned import _atr
from .series import _BLOCKS, _SWING, hourly, register, rounded

c = F.col


def _between(level: str, value: str) -> str:
    """``level`` is beyond ``value`` in the chain's direction."""
    return f"(CASE dir WHEN 1 THEN {level} > {value} ELSE {level} < {value} END)"


_CHAIN = f"""{_BLOCKS}, ot AS (SELECT ob.instrument, ob.side, b.t AS ct, bar_low, bar_high FROM ob JOIN bars b ON b.instrument = ob.instrument AND b.bar_idx = ob.created_idx),
dr(dir, own, other) AS (VALUES (1, 'bullish', 'bearish'), (-1, 'bearish', 'bullish')),
ca AS (SELECT dir, own, other, instrument, t AS a_t, level AS al FROM brk JOIN dr ON side = own WHERE type = 'BOS'),
cb AS (SELECT ca.*, min(ot.ct) AS b_t FROM ca JOIN ot ON ot.instrument = ca.instrument AND ot.side = other AND ot.ct > a_t AND ot.ct <= a_t + 72 * 3600 AND {_between("CASE dir WHEN 1 THEN bar_low ELSE bar_high END", "al")} GROUP BY ALL),
cc AS (SELECT cb.*, min(k.t) AS c_t, arg_min(k.level, k.t) AS cl FROM cb JOIN brk k ON k.instrument = cb.instrument AND k.type = 'BOS' AND k.side = other AND k.t > b_t AND k.t <= b_t + 720 * 3600 AND {_between("al", "k.level")} GROUP BY ALL),
cp AS (SELECT cc.*, min(b.t) AS p_t FROM cc JOIN bars b ON b.instrument = cc.instrument AND b.t >= c_t AND b.t <= c_t + 720 * 3600 AND {_between("cl", "CASE dir WHEN 1 THEN b.l ELSE b.h END")} GROUP BY ALL),
cd AS (SELECT cp.*, min(b.t) AS d_t FROM cp JOIN bars b ON b.instrument = cp.instrument AND b.t >= p_t AND b.t <= p_t + 48 * 3600 AND {_between("b.c", "cl")} GROUP BY ALL),
ce AS (SELECT cd.*, min(ot.ct) AS e_t FROM cd JOIN ot ON ot.instrument = cd.instrument AND ot.side = own AND ot.ct >= d_t AND ot.ct <= d_t + 48 * 3600 AND NOT {_between("CASE dir WHEN 1 THEN bar_low ELSE bar_high END", "cl")} GROUP BY ALL),
cn AS (SELECT ce.*, min(b.bar_idx) AS entry_idx FROM ce JOIN bars b ON b.instrument = ce.instrument AND b.t > e_t GROUP BY ALL)"""


def _trapped(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    b = hourly(spark, sf_dir)
    broken = S.kept(P.breaks(P.swings(b, 5, "swing"), "swing"))
    made = P.order_blocks(broken, b).select(*KEY, "side", c("bar_low").alias("lo"), c("bar_high").alias("hi"), c("t").alias("made_t"))
    made = S.kept(made)
    return [H.trapped_breaks(broken, made, b, direction) for direction in (1, -1)]


@register(f"WITH {_CHAIN} SELECT instrument, CAST(dir AS INT) AS direction, min(a_t) AS a_t, arg_min(b_t, a_t) AS b_t, arg_min(c_t, a_t) AS c_t, arg_min(d_t, a_t) AS d_t, arg_min(e_t, a_t) AS e_t, entry_idx FROM cn GROUP BY instrument, dir, entry_idx")
def j_template_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks that are trapped and taken back, and their mirror: the time of each of five stages and the bar of the entry."""
    found = reduce(DataFrame.unionByName, [chains for chains, _ in _trapped(spark, sf_dir)])
    return found.select("instrument", "direction", "a_t", "b_t", "c_t", "d_t", "e_t", "entry_idx")


@register(f"""WITH {_CHAIN}, st AS (SELECT instrument, dir, 'A' AS stage FROM ca UNION ALL SELECT instrument, dir, 'B' FROM cb UNION ALL SELECT instrument, dir, 'C' FROM cc UNION ALL SELECT instrument, dir, 'D' FROM cd UNION ALL SELECT instrument, dir, 'E' FROM ce)
SELECT instrument, CAST(dir AS INT) AS direction, stage, count(*) AS n FROM st GROUP BY 1, 2, 3""")
def j_template_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chains reach each stage."""
    return reduce(DataFrame.unionByName, [funnel for _, funnel in _trapped(spark, sf_dir)])


_EXITS = f"""{_TRADES}, o AS (SELECT t.instrument, t.side, t.bar_idx, s, ei, entry, stop, risk, li, lc FROM trades t),
hit AS (SELECT o.*, min(CASE WHEN CASE WHEN s = 1 THEN b.l <= stop ELSE b.h >= stop END THEN b.bar_idx END) AS si, min(CASE WHEN CASE WHEN s = 1 THEN b.h >= entry + 2 * risk ELSE b.l <= entry - 2 * risk END THEN b.bar_idx END) AS ti
  FROM o JOIN bars b ON b.instrument = o.instrument AND b.bar_idx BETWEEN ei AND ei + 200 GROUP BY ALL),
opp AS (SELECT hit.*, min(k.bar_idx) AS xi FROM hit LEFT JOIN brk k ON k.instrument = hit.instrument AND k.side <> hit.side AND k.bar_idx > ei AND k.bar_idx <= ei + 200 GROUP BY ALL)"""


def _rule_sql(name: str, target: bool, structure: bool) -> str:
    ti, xi = "ti" if target else "NULL", "xi" if structure else "NULL"
    stop = f"si IS NOT NULL AND si <= coalesce({ti}, si) AND si <= coalesce({xi}, si)"
    goal = f"{ti} IS NOT NULL AND {ti} <= coalesce({xi}, {ti})"
    return f"""SELECT instrument, side, bar_idx, ei, s, entry, risk, '{name}' AS rule, CASE WHEN {stop} THEN 'stop' WHEN {goal} THEN 'target' WHEN {xi} IS NOT NULL THEN 'opposing' ELSE 'timeout' END AS why,
CASE WHEN {stop} THEN si WHEN {goal} THEN {ti} WHEN {xi} IS NOT NULL THEN {xi} END AS xx, stop FROM opp"""


_SIZES = ", ends AS (SELECT instrument, max(bar_idx) AS e FROM bars GROUP BY 1)"


@register(f"""WITH {_EXITS}{_SIZES}, r AS ({" UNION ALL ".join(_rule_sql(*x) for x in (("fixed", True, False), ("opposing", False, True), ("either", True, True)))}),
z AS (SELECT r.*, coalesce(xx, least(ei + 200, e)) AS xidx FROM r JOIN ends USING (instrument))
SELECT z.instrument, z.side, z.bar_idx, rule, why AS exit_reason, xidx AS exit_idx, round(CASE why WHEN 'stop' THEN stop WHEN 'target' THEN entry + s * 2 * risk ELSE b.c END, 6) AS exit FROM z JOIN bars b ON b.instrument = z.instrument AND b.bar_idx = xidx""")
def l_structural_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trades under three rules: a fixed target, the first opposite break, or whichever comes first; the stop before either, and at last a time-out."""
    t, b = trades(spark, sf_dir)
    t = t.select("event_id", *KEY, "side", "bar_idx", "entry_idx", "entry", "stop", "risk")
    marks = P.breaks(P.swings(b, 5, "swing"), "swing")
    out = O.structural_exits(t, b, marks, 2.0, {"fixed": (True, False), "opposing": (False, True), "either": (True, True)})
    return rounded(out, "instrument", "side", "bar_idx", "rule", "exit_reason", "exit_idx", "exit")


@register(f"""WITH {_TRADES}, ob0 AS{_BLOCKS.split("ob0 AS", 1)[1]}{_SIZES},
nx AS (SELECT t.instrument, t.side, t.bar_idx, s, ei, entry, t.stop, least(ei + 200, e, coalesce(min(ob.origin_idx), ei + 200)) AS nat FROM trades t JOIN ends USING (instrument)
  LEFT JOIN ob ON ob.instrument = t.instrument AND ob.side <> t.side AND ob.origin_idx > t.bar_idx GROUP BY t.instrument, t.side, t.bar_idx, s, ei, entry, t.stop, e),
hx AS (SELECT nx.*, min(CASE WHEN CASE WHEN s = 1 THEN b.l <= stop ELSE b.h >= stop END THEN b.bar_idx END) AS si FROM nx JOIN bars b ON b.instrument = nx.instrument AND b.bar_idx BETWEEN ei AND nat WHERE nat > ei GROUP BY ALL)
SELECT hx.instrument, hx.side, hx.bar_idx, coalesce(si, nat) AS exit_idx, round(CASE WHEN si IS NOT NULL THEN stop ELSE b.c END, 6) AS exit FROM hx JOIN bars b ON b.instrument = hx.instrument AND b.bar_idx = nat""")
def l_zone_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out at the origin of the first opposing zone after the signal, at the stop before that, or after 200 bars."""
    t, b = trades(spark, sf_dir)
    zones = P.order_blocks(P.breaks(P.swings(b, 5, "swing"), "swing"), b).select(*KEY, "side", "origin_idx")
    t = t.select("event_id", *KEY, "side", "bar_idx", "entry_idx", "entry", "stop")
    return rounded(O.zone_origin_exits(t, b, zones), "instrument", "side", "bar_idx", "exit_idx", "exit")


@register(f"""WITH RECURSIVE {_SWING}, {_atr(14)}, ev AS (SELECT DISTINCT k.instrument, k.bar_idx, b.c - wa.atr AS dn, b.c + wa.atr AS up FROM brk k JOIN bars b ON b.instrument = k.instrument AND b.bar_idx = k.bar_idx JOIN wa ON wa.instrument = k.instrument AND wa.bar_idx = k.bar_idx WHERE wa.atr > 0),
rc AS (SELECT ev.instrument, ev.bar_idx, min(CASE WHEN b.l <= dn THEN b.bar_idx END) AS di, min(CASE WHEN b.h >= up THEN b.bar_idx END) AS ui FROM ev LEFT JOIN bars b ON b.instrument = ev.instrument AND b.bar_idx > ev.bar_idx AND b.bar_idx <= ev.bar_idx + 24 GROUP BY 1, 2)
SELECT instrument, bar_idx, CASE WHEN di IS NULL AND ui IS NULL THEN NULL WHEN ui IS NULL OR di <= ui THEN 1 ELSE 0 END AS decline_first FROM rc""")
def l_decline_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the price falls by one ATR before it rises by one, within 24 bars; in one bar the fall counts first."""
    b = S.kept(recursive.atr(hourly(spark, sf_dir), 14))
    at = P.breaks(P.swings(b, 5, "swing"), "swing").select(*KEY, "bar_idx").distinct()
    rows = at.join(b.select(*KEY, "bar_idx", "c", "atr"), [*KEY, "bar_idx"]).where("atr > 0").withColumn("event_id", F.xxhash64(*KEY, "bar_idx"))
    return O.decline_first(S.kept(rows), b, 1.0, 24).select("instrument", "bar_idx", "decline_first")


_WICK = _SWING.replace("c > sh AND pc <= lag(sh)", "h > sh AND lag(h) OVER (PARTITION BY instrument ORDER BY bar_idx) <= lag(sh)").replace("c < sl AND pc >= lag(sl)", "l < sl AND lag(l) OVER (PARTITION BY instrument ORDER BY bar_idx) >= lag(sl)")


@register(f"WITH {_WICK} SELECT instrument, bar_idx, bias FROM x6 WHERE bias IS NOT NULL")
def p_wick_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bias where a wick through a swing level is a break already."""
    b = hourly(spark, sf_dir)
    broken = P.breaks(P.swings(b, 5, "swing"), "swing", "h", "l")
    return P.trend(b, broken).where("bias IS NOT NULL").select("instrument", "bar_idx", "bias")


@register(f"""WITH RECURSIVE {_TRADES}, o AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY xi, ei, side) AS k FROM trades),
q AS (SELECT instrument, side, bar_idx, k, greatest(1 + pnl / 100, 0) AS equity, greatest(1, 1 + pnl / 100) AS peak FROM o WHERE k = 1
  UNION ALL SELECT instrument, side, bar_idx, k, eq, greatest(peak, eq) FROM (SELECT o.instrument, o.side, o.bar_idx, o.k, q.equity * greatest(1 + o.pnl / 100, 0) AS eq, q.peak FROM q JOIN o ON o.instrument = q.instrument AND o.k = q.k + 1))
SELECT instrument, side, bar_idx, round(equity, 6) AS equity, round(peak, 6) AS peak, round(1 - equity / peak, 6) AS drawdown FROM q""")
def a_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: compounded equity after each trade, its peak and the fall from it, by blocks of trades."""
    t, _ = trades(spark, sf_dir)
    curve = A.equity_by_blocks(t, ["instrument"], ["exit_idx", "entry_idx", "side"], block=16)
    return rounded(curve, "instrument", "side", "bar_idx", "equity", "peak", "drawdown")


@register(f"""WITH {_TRADES}, y AS (SELECT *, (SELECT max(t) FROM bars b WHERE b.instrument = trades.instrument AND b.bar_idx = xi) - (SELECT min(t) FROM bars b WHERE b.instrument = trades.instrument AND b.bar_idx = ei) AS d,
(SELECT t FROM bars b WHERE b.instrument = trades.instrument AND b.bar_idx = ei) AS et, (SELECT t FROM bars b WHERE b.instrument = trades.instrument AND b.bar_idx = xi) AS xt FROM trades)
SELECT instrument, count(*) AS n, round((max(xt) - min(et)) / 31557600.0, 9) AS years, round(count(*) / nullif((max(xt) - min(et)) / 31557600.0, 0), 4) AS per_year, round(avg(pnl), 6) AS expectancy, round(exp(sum(ln(greatest(1 + pnl / 100, 1e-12)))), 6) AS multiple FROM y GROUP BY 1""")
def a_growth_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades a year and what a yearly growth rate is made of."""
    t, b = trades(spark, sf_dir)
    times = lambda at, name: b.select(*KEY, c("bar_idx").alias(at), c("t").alias(name))
    rows = t.join(times("entry_idx", "entry_t"), [*KEY, "entry_idx"]).join(times("exit_idx", "exit_t"), [*KEY, "exit_idx"])
    out = A.growth_inputs(rows, ["instrument"], "entry_t", "exit_t", "pnl_pct")
    return out.select("instrument", "n", F.round("years", 9).alias("years"), F.round("per_year", 4).alias("per_year"), F.round("expectancy", 6).alias("expectancy"), F.round("multiple", 6).alias("multiple"))


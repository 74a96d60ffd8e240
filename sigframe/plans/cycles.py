"""Registered queries over recursive series and their events, with SQL that steps through each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recursive, rows, windows
from ..operators import events as E
from ..operators import structure as P
from ..schema import KEY
from ..sources import tables as S
from .series import BARS, W, gate, hourly, last, register, rounded

c = F.col


def _ema(out: str, table: str, x: str, alpha: float, seed: int = 1) -> str:
    """SQL of an exponential mean as a table of its own name: from the mean of the first ``seed`` values on, step by step."""
    start = "x" if seed == 1 else f"(SELECT avg(x) FROM {out}_n m WHERE m.instrument = n.instrument AND m.i <= {seed})"
    return f"""{out}_n AS (SELECT instrument, bar_idx, {x} AS x, row_number() OVER (PARTITION BY instrument ORDER BY bar_idx) AS i FROM {table} WHERE {x} IS NOT NULL),
{out} AS (SELECT instrument, bar_idx, i, CAST({start} AS DOUBLE) AS {out} FROM {out}_n n WHERE i = {seed} UNION ALL SELECT n.instrument, n.bar_idx, n.i, p.{out} + {alpha!r}::DOUBLE * (n.x - p.{out}) FROM {out} p JOIN {out}_n n ON n.instrument = p.instrument AND n.i = p.i + 1)"""


def _joined(name: str, table: str, *parts: str) -> str:
    """SQL of a table with columns of others beside it, by bar."""
    return f"{name} AS (SELECT {table}.*, {', '.join(f'{p}.{p}' for p in parts)} FROM {table} {' '.join(f'LEFT JOIN {p} ON {p}.instrument = {table}.instrument AND {p}.bar_idx = {table}.bar_idx' for p in parts)})"


def _place(src: str) -> str:
    hi, lo = gate(10, src, f"max({src}) OVER {last(10)}"), gate(10, src, f"min({src}) OVER {last(10)}")
    return f"CASE WHEN {hi} > {lo} THEN ({src} - {lo}) / ({hi} - {lo}) * 100 END AS raw, {hi} IS NOT NULL AS whole"


_UPTO = "(PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BASE = f"""{BARS}, b1 AS (SELECT *, c - lag(c) OVER {W} AS step, (h + l + c) / 3 AS ap FROM bars), b2 AS (SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS up, CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END AS down, abs(step) AS size FROM b1)"""
_MFI = gate(14, "step", f"CASE WHEN sum(CASE WHEN step < 0 THEN c * v ELSE 0 END) OVER {last(14)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(CASE WHEN step > 0 THEN c * v ELSE 0 END) OVER {last(14)} / sum(CASE WHEN step < 0 THEN c * v ELSE 0 END) OVER {last(14)}) END")


_CYCLES = f"""WITH RECURSIVE {_BASE}, {_ema("f12", "b2", "c", 2 / 13, 12)}, {_ema("s26", "b2", "c", 2 / 27, 26)}, {_joined("m0", "b2", "f12", "s26")}, m1 AS (SELECT *, f12 - s26 AS macd FROM m0), {_ema("sig", "m1", "macd", 0.2)},
{_ema("e23", "b2", "c", 2 / 24)}, {_ema("e50", "b2", "c", 2 / 51)}, {_joined("n0", "b2", "e23", "e50")}, n1 AS (SELECT *, e23 - e50 AS m FROM n0), n2 AS (SELECT *, {_place("m")} FROM n1), n3 AS (SELECT *, CASE WHEN whole THEN last_value(raw IGNORE NULLS) OVER {_UPTO} END AS place FROM n2), {_ema("k1", "n3", "place", 0.5)},
{_joined("n4", "n1", "k1")}, n5 AS (SELECT *, {_place("k1")} FROM n4), n6 AS (SELECT *, CASE WHEN whole THEN last_value(raw IGNORE NULLS) OVER {_UPTO} END AS place FROM n5), {_ema("stc", "n6", "place", 0.5)},
{_ema("ce", "b2", "c", 0.2)}, {_joined("t0", "b2", "ce")}, t1 AS (SELECT *, abs(c - ce) AS dev FROM t0), {_ema("cd", "t1", "dev", 0.2)}, {_joined("t2", "t1", "cd")}, t3 AS (SELECT *, (c - ce) / nullif(cd * 0.025, 0) AS ci FROM t2), {_ema("tci", "t3", "ci", 2 / 7)}, {_ema("ag", "b2", "up", 1 / 3, 3)}, {_ema("al", "b2", "down", 1 / 3, 3)},
{_ema("d1", "b2", "step", 2 / 26)}, {_ema("d2", "d1", "d1", 2 / 14)}, {_ema("a1", "b2", "size", 2 / 26)}, {_ema("a2", "a1", "a1", 2 / 14)}, pk AS (SELECT instrument, bar_idx, abs(c) AS pk FROM b2 WHERE bar_idx = 0 UNION ALL SELECT b.instrument, b.bar_idx, greatest(0.991::DOUBLE * p.pk, abs(b.c)) FROM pk p JOIN b2 b ON b.instrument = p.instrument AND b.bar_idx = p.bar_idx + 1),
mf AS (SELECT instrument, bar_idx, {_MFI} AS mf FROM b2), {_joined("z", "b2", "f12", "s26", "sig", "stc", "tci", "ag", "al", "d2", "a2", "pk", "mf")}"""


@register(f"""{_CYCLES}
SELECT instrument, bar_idx, round(f12 - s26 + 1e-9, 4) AS macd, round(f12 - s26 - sig + 1e-9, 4) AS macd_hist, round(stc + 1e-9, 4) AS stc, round((tci + 50 + mf + CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END) / 3 + 1e-9, 4) AS blend, round(d2 / nullif(a2, 0) * 100 + 1e-9, 4) AS tsi, round(pk + 1e-9, 4) AS peak FROM z""")
def r_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD, Schaff cycle, blend, true strength, decaying peak."""
    b = S.kept(recursive.schaff(recursive.macd(hourly(spark, sf_dir))))
    b = recursive.tsi(recursive.trend_blend(b)).withColumn("peak", recursive.peak("c", 0.991))
    names = ["macd", "macd_hist", "stc", "blend", "tsi", "peak"]
    return rounded(b.withColumns({n: c(n) + 1e-9 for n in names}), "instrument", "bar_idx", *names, places=4)


_WAVE = f"""{_BASE}, {_ema("esa", "b2", "ap", 0.2)}, {_joined("w0", "b2", "esa")}, w1 AS (SELECT *, abs(ap - esa) AS dev FROM w0), {_ema("wd", "w1", "dev", 0.2)}, {_joined("w2", "w1", "wd")}, w3 AS (SELECT *, (ap - esa) / nullif(wd * 0.015, 0) AS ci FROM w2), {_ema("wt1", "w3", "ci", 2 / 13)}, {_joined("w4", "b2", "wt1")}, w5 AS (SELECT *, {gate(3, 'wt1', f'avg(wt1) OVER {last(3)}')} AS wt2 FROM w4)"""
_RIBBON = (5, 11, 15, 18, 21, 24, 28, 34)
_EMAS = ", ".join(_ema(f"ema{k + 1}", "b2", "c", 2 / (n + 1)) for k, n in enumerate(_RIBBON))


def _cross(a: str, b: str, up: bool) -> str:
    now, then = (">", "<=") if up else ("<", ">=")
    return f"({a} {now} {b} AND lag({a}) OVER {W} {then} lag({b}) OVER {W})"


_CONDITIONS = {
    "green_dot": (_cross("ema2", "ema8", True), "bullish"), "red_dot": (_cross("ema2", "ema8", False), "bearish"), "red_cross": (_cross("ema1", "ema2", False), "bearish"), "blue_triangle": (_cross("ema2", "ema3", True), "bullish"), "red_diamond": (_cross("wt1", "wt2", False), "bearish"),
    "blood_diamond": (f"{_cross('wt1', 'wt2', False)} AND {_cross('ema1', 'ema2', False)}", "bearish"), "bull_candle": ("c > o AND c > ema1 AND o <= ema1", "bullish"), "yellow_cross": (f"{_cross('wt1', 'wt2', True)} AND wt2 < 45 AND wt2 > -80", "bullish"),
    "turn_up": (f"lag(wt2) OVER {W} > -60 AND lag(wt2) OVER {W} < 60 AND lag(wt2) OVER {W} < lag(wt2, 2) OVER {W} AND wt2 > lag(wt2) OVER {W}", "bullish"), "turn_down": (f"lag(wt2) OVER {W} > -60 AND lag(wt2) OVER {W} < 60 AND lag(wt2) OVER {W} > lag(wt2, 2) OVER {W} AND wt2 < lag(wt2) OVER {W}", "bearish"),
    "buy": (f"{_cross('wt1', 'wt2', True)} AND wt2 <= -53", "bullish"), "sell": (f"{_cross('wt1', 'wt2', False)} AND wt2 >= 53", "bearish"),
    "stack_up": (" AND ".join(f"ema{k} > ema{k + 1}" for k in range(1, 8)), "bullish"), "stack_down": (" AND ".join(f"ema{k} < ema{k + 1}" for k in range(1, 8)), "bearish"),
}
_LIST = ", ".join(f"CASE WHEN {cond} THEN '{k} {side}' END" for k, (cond, side) in _CONDITIONS.items())


@register(f"""WITH RECURSIVE {_WAVE}, {_EMAS}, {_joined("w6", "w5", *[f"ema{k}" for k in range(1, 9)])}, ev AS (SELECT instrument, bar_idx, t, c, unnest([{_LIST}]) AS e FROM w6) SELECT instrument, split_part(e, ' ', 1) AS type, split_part(e, ' ', 2) AS side, bar_idx, t, t + 3600 AS known_at, round(c, 6) AS price FROM ev WHERE e IS NOT NULL""")
def e_oscillator_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WaveTrend crossings and turns, ribbon events and stack."""
    w = windows.series()
    b = S.kept(recursive.wavetrend(recursive.ribbon(hourly(spark, sf_dir))))
    b = b.withColumns({**E.ribbon_events(w), **E.turns("wt2", -60, 60, w), "buy": E.crossover("wt1", "wt2", w) & (c("wt2") <= -53), "sell": E.crossunder("wt1", "wt2", w) & (c("wt2") >= 53), "stack": rows.stacked(F.array(*[c(f"ema{k}") for k in range(1, 9)]))})
    found = {k: (c("stack") == k[6:] if k.startswith("stack") else c(k), side) for k, (_, side) in _CONDITIONS.items()}
    return rounded(E.emit(b, "oscillator", found).drop("family", "timeframe"))


_HELD3 = "(PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)"


@register(f"""WITH RECURSIVE {_WAVE}, f0 AS (SELECT *, lag(wt2, 1) OVER {W} AS q1, lag(wt2, 2) OVER {W} AS q2, lag(wt2, 3) OVER {W} AS q3, lag(wt2, 4) OVER {W} AS q4, lag(h, 2) OVER {W} AS ph, lag(l, 2) OVER {W} AS pl FROM w5),
f1 AS (SELECT *, CASE WHEN q2 > wt2 AND q2 > q1 AND q2 > q3 AND q2 > q4 AND q2 >= 0 THEN q2 END AS top, CASE WHEN q2 < wt2 AND q2 < q1 AND q2 < q3 AND q2 < q4 AND q2 <= 0 THEN q2 END AS bottom FROM f0),
g AS (SELECT *, last_value(top IGNORE NULLS) OVER {_HELD3} AS tv, last_value(CASE WHEN top IS NOT NULL THEN ph END IGNORE NULLS) OVER {_HELD3} AS tp, last_value(bottom IGNORE NULLS) OVER {_HELD3} AS bv, last_value(CASE WHEN bottom IS NOT NULL THEN pl END IGNORE NULLS) OVER {_HELD3} AS bp FROM f1),
u AS (SELECT instrument, bar_idx, unnest([CASE WHEN top < tv AND ph > tp THEN 'regular bearish' END, CASE WHEN bottom > bv AND pl < bp THEN 'regular bullish' END, CASE WHEN top > tv AND ph < tp THEN 'hidden bearish' END, CASE WHEN bottom < bv AND pl > bp THEN 'hidden bullish' END]) AS d FROM g)
SELECT instrument, bar_idx AS confirm_idx, bar_idx - 2 AS bar_idx, split_part(d, ' ', 1) AS kind, split_part(d, ' ', 2) AS side FROM u WHERE d IS NOT NULL""")
def d_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractal divergences of WaveTrend, regular and hidden, each once."""
    b = S.kept(recursive.wavetrend(hourly(spark, sf_dir)))
    return P.divergences(b, "wt2", 0, 0).dropDuplicates([*KEY, "confirm_idx", "side", "kind"]).drop("timeframe")


_N = f"""n0 AS (SELECT *, {gate(14, 'c', f'CASE WHEN max(h) OVER {last(14)} = min(l) OVER {last(14)} THEN 0 ELSE (c - min(l) OVER {last(14)}) / (max(h) OVER {last(14)} - min(l) OVER {last(14)}) * 100 END')} AS stoch, c - lag(c, 10) OVER {W} AS mom FROM bars)"""


def _sight(osc: str, side: str, hidden: bool = False) -> str:
    """SQL of the divergences of one oscillator on one side: every pivot in reach, the straight line from it held against each bar between."""
    s, kind = (1, "bottom") if side == "bullish" else (-1, "top")
    more, less = ("<", ">") if hidden else (">", "<")
    return f"""SELECT a.instrument, a.bar_idx + 1 AS bar_idx, '{side}' AS side, '{osc}' AS oscillator, max(p.i) AS pivot_idx FROM n1 a JOIN pv p ON p.instrument = a.instrument AND p.kind = '{kind}' AND p.known <= a.bar_idx AND p.i + 5 >= a.bar_idx - 100 AND p.i >= a.bar_idx - 100 AND a.bar_idx - p.i > 5 JOIN n1 o ON o.instrument = p.instrument AND o.bar_idx = p.i
WHERE a.{osc} IS NOT NULL AND o.{osc} IS NOT NULL AND ({s} * a.ahead_c > 0 OR {s} * a.ahead_{osc} > 0) AND {s} * a.{osc} {more} {s} * o.{osc} AND {s} * a.c {less} {s} * o.c AND (SELECT count(*) FROM pv r WHERE r.instrument = p.instrument AND r.kind = p.kind AND r.known <= a.bar_idx AND r.i > p.i) < 10
AND NOT EXISTS (SELECT 1 FROM n1 m WHERE m.instrument = a.instrument AND m.bar_idx > p.i AND m.bar_idx < a.bar_idx AND ({s} * m.c < {s} * (o.c + (a.c - o.c) * (m.bar_idx - p.i) / (a.bar_idx - p.i)) OR {s} * m.{osc} < {s} * (o.{osc} + (a.{osc} - o.{osc}) * (m.bar_idx - p.i) / (a.bar_idx - p.i)))) GROUP BY 1, 2"""


_PIVOTS5 = f"""pw AS (SELECT *, lag(c, 5) OVER {W} AS c5 FROM bars), pv AS (SELECT instrument, bar_idx AS known, bar_idx - 5 AS i, unnest([CASE WHEN n1 = 5 AND c5 > a AND c5 > b THEN 'top' END, CASE WHEN n1 = 5 AND c5 < x AND c5 < y THEN 'bottom' END]) AS kind FROM (SELECT *, count(c) OVER p AS n1, max(c) OVER p AS a, max(c) OVER q AS b, min(c) OVER p AS x, min(c) OVER q AS y FROM pw
 WINDOW p AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING), q AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))"""


@register(f"""WITH {BARS}, {_N}, n1 AS (SELECT *, lead(c) OVER {W} - c AS ahead_c, lead(stoch) OVER {W} - stoch AS ahead_stoch, lead(mom) OVER {W} - mom AS ahead_mom FROM n0), {_PIVOTS5}
{' UNION ALL '.join(_sight(o, s) for o in ('stoch', 'mom') for s in ('bullish', 'bearish'))}""")
def d_sight_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of several oscillators against recorded pivots with a clear line between, each with its pivot."""
    b = windows.bounded(hourly(spark, sf_dir), 30, lambda w: {"stoch": windows.stochastic(w), "mom": c("c") - F.lag("c", 10).over(w)})
    return P.sight_divergences(S.kept(b), ["stoch", "mom"]).drop("timeframe")


_FOUR = ("stoch", "mom", "mom5", "dev")
_N4 = f"""n00 AS (SELECT *, c - lag(c, 5) OVER {W} AS mom5, c - {gate(20, "c", f"avg(c) OVER {last(20)}")} AS dev FROM n0), n1 AS (SELECT *, lead(c) OVER {W} - c AS ahead_c, {", ".join(f"lead({o}) OVER {W} - {o} AS ahead_{o}" for o in _FOUR)} FROM n00), {_PIVOTS5}"""


def _all_sights(hidden: bool) -> str:
    return " UNION ALL ".join(_sight(o, s, hidden) for o in _FOUR for s in ("bullish", "bearish"))


@register(f"""WITH {BARS}, {_N}, {_N4}, fo AS (SELECT *, 'regular' AS kind FROM ({_all_sights(False)}) UNION ALL SELECT *, 'hidden' FROM ({_all_sights(True)}))
SELECT instrument, kind, bar_idx, side, count(DISTINCT oscillator) AS n FROM fo GROUP BY ALL HAVING count(DISTINCT oscillator) >= 3""")
def d_sight_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars at which at least three of four oscillators diverge from the price, of the regular and of the hidden kind."""
    b = windows.bounded(
        hourly(spark, sf_dir), 30,
        lambda w: {"stoch": windows.stochastic(w), "mom": c("c") - F.lag("c", 10).over(w), "mom5": c("c") - F.lag("c", 5).over(w), "dev": c("c") - windows.sma("c", 20, w)},
    )
    b = S.kept(b)
    badges = [P.badges(P.sight_divergences(b, list(_FOUR), hidden=hidden)).withColumn("kind", F.lit(kind)) for kind, hidden in (("regular", False), ("hidden", True))]
    return badges[0].unionByName(badges[1]).select("instrument", "kind", "bar_idx", "side", "n")


@register(f"""{_CYCLES}, ce1 AS (SELECT instrument, bar_idx, t, c, stc, lag(stc) OVER {W} AS s1, lag(stc, 2) OVER {W} AS s2 FROM z),
ce2 AS (SELECT *, unnest([CASE WHEN stc > 25 AND s1 <= 25 THEN 'up_25 bullish' END, CASE WHEN stc < 75 AND s1 >= 75 THEN 'down_75 bearish' END,
  CASE WHEN s1 > 25 AND s1 < 75 AND s1 < s2 AND stc > s1 THEN 'turn_up bullish' END, CASE WHEN s1 > 25 AND s1 < 75 AND s1 > s2 AND stc < s1 THEN 'turn_down bearish' END]) AS e FROM ce1)
SELECT instrument, split_part(e, ' ', 1) AS type, split_part(e, ' ', 2) AS side, bar_idx, t, t + 3600 AS known_at, round(c, 6) AS price FROM ce2 WHERE e IS NOT NULL""")
def e_cycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of the Schaff cycle with 25 and 75, and its turns inside the band."""
    w = windows.series()
    b = S.kept(recursive.schaff(hourly(spark, sf_dir)))
    rows = b.withColumns({"up_25": E.crossover("stc", 25, w), "down_75": E.crossunder("stc", 75, w)} | E.turns("stc", 25, 75, w))
    sides = {"up_25": "bullish", "down_75": "bearish", "turn_up": "bullish", "turn_down": "bearish"}
    return rounded(E.emit(rows, "cycle", {k: (c(k), s) for k, s in sides.items()}).drop("family", "timeframe"))

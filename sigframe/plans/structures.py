"""Registered queries over structure, oscillator events, divergences and zones, one for each kind, with the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows
from ..operators import bars as B
from ..operators import compose as C
from ..operators import events as E
from ..operators import structure as P
from ..operators import zones as Z
from ..schema import KEY
from ..sources import tables as S
from .relations import blocks
from .series import _BLOCKS, _SWING, BARS, W, gate, hourly, last, register, rounded

c = F.col

_BEFORE = "(PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING)"
_AFTER = "(PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_UPTO = "(PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
#: Bars with the mean range of 14 bars, and pivots with three bars on either side, known three bars later.
_PIVOTS = f"""rb AS (SELECT *, {gate(14, 'h', f'avg(h - l) OVER {last(14)}')} AS atr FROM bars), px AS (SELECT *, lag(h, 3) OVER {W} AS h3, lag(l, 3) OVER {W} AS l3 FROM rb),
pv0 AS (SELECT *, count(h) OVER {_BEFORE} = 3 AND h3 > max(h) OVER {_BEFORE} AND h3 > max(h) OVER {_AFTER} AS top, count(l) OVER {_BEFORE} = 3 AND l3 < min(l) OVER {_BEFORE} AND l3 < min(l) OVER {_AFTER} AS bottom FROM px),
pv AS (SELECT instrument, bar_idx, atr, 'high' AS kind, h3 AS price FROM pv0 WHERE top UNION ALL SELECT instrument, bar_idx, atr, 'low', l3 FROM pv0 WHERE bottom)"""
_GAPS = f"""gx AS (SELECT *, lag(h, 2) OVER {W} AS h2, lag(l, 2) OVER {W} AS l2 FROM bars), g AS (SELECT instrument, bar_idx, CASE WHEN l > h2 THEN 'bullish' ELSE 'bearish' END AS side, CASE WHEN l > h2 THEN h2 ELSE h END AS bottom, CASE WHEN l > h2 THEN l ELSE l2 END AS top FROM gx WHERE l > h2 OR h < l2),
g1 AS (SELECT *, CASE WHEN lag(bar_idx) OVER (PARTITION BY instrument, side ORDER BY bar_idx) = bar_idx - 1 THEN 0 ELSE 1 END AS n FROM g), g2 AS (SELECT *, sum(n) OVER (PARTITION BY instrument, side ORDER BY bar_idx) AS run FROM g1),
gz AS (SELECT instrument, side, min(bottom) AS bottom, max(top) AS top, min(bar_idx) AS created_idx FROM g2 GROUP BY instrument, side, run)"""


def ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with the mean range of the last 14 as ``atr``."""
    return S.kept(windows.bounded(hourly(spark, sf_dir).withColumn("_r", c("h") - c("l")), 20, lambda w: {"atr": windows.sma("_r", 14, w)}).drop("_r"))


def pivots_of(b: DataFrame) -> DataFrame:
    """Pivots of both kinds: (keys, bar_idx, atr, kind, price)."""
    w = windows.series()
    found = b.withColumns({"hi": P.pivot("h", 3, 3, w), "lo": P.pivot("l", 3, 3, w, False)})
    both = [F.when(c(x).isNotNull(), F.struct(F.lit(k).alias("kind"), c(x).alias("price"))) for k, x in (("high", "hi"), ("low", "lo"))]
    return S.kept(found.select(*KEY, "bar_idx", "atr", F.explode(F.array_compact(F.array(*both))).alias("p")).select(*KEY, "bar_idx", "atr", "p.*"))


def breaks_of(b: DataFrame) -> DataFrame:
    return S.kept(P.breaks(P.swings(b, 5, "swing"), "swing"))


@register(f"""WITH {BARS}, {_PIVOTS}, x AS (SELECT *, lag(price) OVER k AS before, lag(bar_idx) OVER k AS before_idx FROM pv WINDOW k AS (PARTITION BY instrument, kind ORDER BY bar_idx))
SELECT instrument, CASE kind WHEN 'high' THEN 'EQH' ELSE 'EQL' END AS side, bar_idx, before_idx, round(price, 6) AS price FROM x WHERE abs(price - before) < 0.1 * atr""")
def p_equal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: pivots at the level of the one before of their kind."""
    return rounded(P.equal_levels(pivots_of(ranged(spark, sf_dir)), "atr"), "instrument", "side", "bar_idx", "before_idx", "price")


@register(f"""WITH {BARS}, x AS (SELECT *, lag(h, 2) OVER {W} AS h2, lag(l, 2) OVER {W} AS l2, lag(c) OVER {W} AS c1, (lag(c) OVER {W} - lag(o) OVER {W}) / nullif(lag(o) OVER {W}, 0) AS m FROM bars), y AS (SELECT *, 2 * avg(abs(m)) OVER {_UPTO} AS mean FROM x),
z AS (SELECT *, CASE WHEN l > h2 AND c1 > h2 AND m > mean THEN 'bullish' WHEN h < l2 AND c1 < l2 AND -m > mean THEN 'bearish' END AS side FROM y)
SELECT instrument, bar_idx, side, round(CASE side WHEN 'bullish' THEN h2 ELSE h END, 6) AS bottom, round(CASE side WHEN 'bullish' THEN l ELSE l2 END, 6) AS top FROM z WHERE side IS NOT NULL""")
def p_threshold_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps whose middle bar moved more than twice the mean so far."""
    return rounded(P.threshold_gaps(hourly(spark, sf_dir)), "instrument", "bar_idx", "side", "bottom", "top")


@register(f"""WITH {BARS}, {_GAPS}, x AS (SELECT *, last_value(CASE WHEN side = 'bullish' THEN {{'b': bottom, 't': top, 'i': created_idx}} END IGNORE NULLS) OVER k AS bull, last_value(CASE WHEN side = 'bearish' THEN {{'b': bottom, 't': top, 'i': created_idx}} END IGNORE NULLS) OVER k AS bear
FROM gz WINDOW k AS (PARTITION BY instrument ORDER BY created_idx, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), y AS (SELECT *, CASE side WHEN 'bullish' THEN bear ELSE bull END AS z FROM x)
SELECT instrument, side, created_idx, z.i AS other_idx, round(greatest(bottom, z.b), 6) AS low, round(least(top, z.t), 6) AS high FROM y WHERE z IS NOT NULL AND greatest(bottom, z.b) < least(top, z.t)""")
def p_balanced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: where a gap overlaps the last one of the other side."""
    gaps = S.kept(P.fair_value_gaps(hourly(spark, sf_dir)).select(*KEY, "side", "bottom", "top", "created_idx"))
    return rounded(P.balanced_ranges(gaps), "instrument", "side", "created_idx", "other_idx", "low", "high")


@register(f"""WITH {_SWING} SELECT k.instrument, k.side, k.bar_idx, round(k.level, 6) AS level, min(b.bar_idx) AS reclaim_idx FROM brk k LEFT JOIN bars b ON b.instrument = k.instrument AND b.bar_idx BETWEEN k.bar_idx + 1 AND k.bar_idx + 12 AND CASE WHEN k.side = 'bullish' THEN b.c < k.level ELSE b.c > k.level END GROUP BY 1, 2, 3, 4""")
def p_failed_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks with the first close back through their level within twelve bars."""
    b = hourly(spark, sf_dir)
    return rounded(P.failed_breaks(breaks_of(b), b, 12), "instrument", "side", "bar_idx", "level", "reclaim_idx")


@register(f"""WITH {BARS}, {_PIVOTS}, n AS (SELECT a.instrument, a.kind, a.bar_idx, count(b.bar_idx) AS near FROM pv a LEFT JOIN pv b ON b.instrument = a.instrument AND b.kind = a.kind AND b.bar_idx < a.bar_idx AND b.bar_idx >= a.bar_idx - 200 AND abs(b.price - a.price) <= a.atr / 2 GROUP BY 1, 2, 3)
SELECT instrument, kind, bar_idx, CAST(near AS BIGINT) AS near, CASE WHEN near > 0 THEN 'clustered' ELSE 'isolated' END AS label FROM n""")
def p_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots with how many earlier ones of their kind lie near them."""
    return P.near_earlier(pivots_of(ranged(spark, sf_dir)).withColumn("band", c("atr") / 2), "band").select("instrument", "kind", "bar_idx", "near", "label")


@register(f"""WITH {BARS}, {_PIVOTS}, x AS (SELECT instrument, bar_idx, price, lag(price) OVER (PARTITION BY instrument ORDER BY bar_idx) AS before FROM pv WHERE kind = 'high'), f(share) AS (VALUES (0.0), (0.236), (0.382), (0.5), (0.618), (0.786), (1.0))
SELECT instrument, bar_idx, CAST(share AS DOUBLE) AS share, round(price + (before - price) * share::DOUBLE, 5) AS level FROM x, f WHERE before IS NOT NULL""")
def p_retracements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels between successive pivot highs."""
    highs = pivots_of(ranged(spark, sf_dir)).where("kind = 'high'")
    return P.retracements(highs.select(*KEY, "bar_idx", "price")).select("instrument", "bar_idx", "share", F.round("level", 5).alias("level"))


@register(f"""WITH {_SWING}, e AS (SELECT k.instrument, k.side, k.bar_idx, b.h + 10 AS up, b.l - 10 AS down FROM brk k JOIN bars b ON b.instrument = k.instrument AND b.bar_idx = k.bar_idx),
x AS (SELECT e.instrument, e.side, e.bar_idx, min(CASE WHEN b.h > up THEN b.bar_idx END) AS up_idx, min(CASE WHEN b.l < down THEN b.bar_idx END) AS down_idx FROM e LEFT JOIN bars b ON b.instrument = e.instrument AND b.bar_idx > e.bar_idx AND b.bar_idx <= e.bar_idx + 101 GROUP BY 1, 2, 3)
SELECT *, CASE WHEN up_idx IS NULL AND down_idx IS NULL THEN 'neither' WHEN down_idx IS NULL OR up_idx < down_idx THEN 'up' WHEN up_idx IS NULL OR down_idx < up_idx THEN 'down' ELSE 'both' END AS first FROM x""")
def p_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a break, which of two levels is passed first."""
    b = hourly(spark, sf_dir)
    e = breaks_of(b).join(b.select(*KEY, "bar_idx", (c("h") + 10).alias("up"), (c("l") - 10).alias("down")), [*KEY, "bar_idx"])
    e = e.withColumns({"event_id": F.xxhash64("instrument", "side", "bar_idx"), "start": c("bar_idx") + 1})
    return P.race(S.kept(e), b, "event_id", "start", "up", "down", most=100).select("instrument", "side", "bar_idx", "up_idx", "down_idx", "first")


@register(f"""WITH {BARS}, {_PIVOTS}, q AS (SELECT *, last_value(CASE WHEN bottom THEN l3 END IGNORE NULLS) OVER {_UPTO} AS level, last_value(CASE WHEN bottom THEN bar_idx END IGNORE NULLS) OVER {_UPTO} AS id, lag(c) OVER {W} AS pc FROM pv0)
SELECT instrument, min(bar_idx) AS bar_idx, round(any_value(level), 6) AS level, id AS pivot_known_idx FROM q WHERE c < level AND pc >= level GROUP BY instrument, id""")
def p_pivot_low_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes below the last confirmed pivot low, one for each."""
    return rounded(P.pivot_low_breaks(hourly(spark, sf_dir), 3, 3).withColumnRenamed("level_id", "pivot_known_idx"), "instrument", "bar_idx", "level", "pivot_known_idx")


_ZIGZAG = f"""{BARS}, {_PIVOTS}, z0 AS (SELECT *, CASE WHEN lag(kind) OVER k = kind THEN 0 ELSE 1 END AS n FROM pv WINDOW k AS (PARTITION BY instrument ORDER BY bar_idx, kind = 'high')), z1 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY instrument ORDER BY bar_idx, kind = 'high' ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM z0),
zz AS (SELECT instrument, bar_idx, kind, run, CASE kind WHEN 'high' THEN max(price) OVER r ELSE min(price) OVER r END AS level FROM z1 WINDOW r AS (PARTITION BY instrument, run ORDER BY bar_idx ROWS UNBOUNDED PRECEDING))"""


@register(f"WITH {_ZIGZAG} SELECT instrument, bar_idx, kind, run, round(level, 6) AS level FROM zz")
def p_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots by runs of one kind, with the extreme of each run so far."""
    return rounded(P.zigzag(pivots_of(ranged(spark, sf_dir))), "instrument", "bar_idx", "kind", "run", "level")


@register(f"""WITH {_ZIGZAG}, a AS (SELECT instrument, bar_idx, max(CASE WHEN kind = 'high' THEN level END) AS hi, max(CASE WHEN kind = 'low' THEN level END) AS lo FROM zz GROUP BY 1, 2),
b AS (SELECT x.instrument, x.bar_idx, x.c, lag(x.c) OVER k AS pc, last_value(hi IGNORE NULLS) OVER u AS hi, last_value(CASE WHEN hi IS NOT NULL THEN bar_idx END IGNORE NULLS) OVER u AS hid, last_value(lo IGNORE NULLS) OVER u AS lo, last_value(CASE WHEN lo IS NOT NULL THEN bar_idx END IGNORE NULLS) OVER u AS lid
 FROM bars x LEFT JOIN a USING (instrument, bar_idx) WINDOW k AS (PARTITION BY instrument ORDER BY bar_idx), u AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT instrument, min(bar_idx) AS bar_idx, any_value(hi) AS level, 'bullish' AS side FROM b WHERE c > hi AND pc <= hi GROUP BY instrument, hid UNION ALL SELECT instrument, min(bar_idx), any_value(lo), 'bearish' FROM b WHERE c < lo AND pc >= lo GROUP BY instrument, lid),
f AS (SELECT *, lag(side) OVER (PARTITION BY instrument ORDER BY bar_idx, side) AS before FROM e) SELECT instrument, bar_idx, side, round(level, 6) AS level FROM f WHERE before IS NULL OR before <> side""")
def p_structure_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes beyond the zigzag that turn its direction."""
    b = ranged(spark, sf_dir)
    return rounded(P.structure_shifts(b, S.kept(P.zigzag(pivots_of(b)))), "instrument", "bar_idx", "side", "level")


@register(f"""WITH {_SWING}, o0 AS (SELECT k.instrument, k.bar_idx, k.side, least(b.o, b.c) AS lo, greatest(b.o, b.c) AS hi, row_number() OVER (PARTITION BY k.instrument, k.bar_idx, k.side ORDER BY CASE WHEN k.side = 'bullish' THEN least(b.o, b.c) ELSE -greatest(b.o, b.c) END, b.bar_idx) AS rn FROM brk k JOIN bars b ON b.instrument = k.instrument AND b.bar_idx >= k.pivot_idx AND b.bar_idx < k.bar_idx),
x AS (SELECT o.instrument, o.side, o.bar_idx, lo, hi, min(b.bar_idx) AS breaker_idx FROM o0 o LEFT JOIN bars b ON b.instrument = o.instrument AND b.bar_idx > o.bar_idx AND CASE WHEN o.side = 'bullish' THEN b.c < lo ELSE b.c > hi END WHERE rn = 1 GROUP BY 1, 2, 3, 4, 5)
SELECT x.instrument, x.side, x.bar_idx AS created_idx, round(lo, 6) AS bar_low, round(hi, 6) AS bar_high, breaker_idx, min(b.bar_idx) AS removed_idx FROM x LEFT JOIN bars b ON b.instrument = x.instrument AND b.bar_idx >= breaker_idx AND CASE WHEN x.side = 'bullish' THEN b.c > hi ELSE b.c < lo END GROUP BY 1, 2, 3, 4, 5, 6""")
def p_breaker_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of bodies, the close that breaks each and the one that takes the breaker away."""
    b = hourly(spark, sf_dir)
    return rounded(P.breaker_blocks(breaks_of(b), b), "instrument", "side", "created_idx", "bar_low", "bar_high", "breaker_idx", "removed_idx")


@register(f"""WITH {BARS}, {_PIVOTS}, m AS (SELECT instrument, bar_idx, c - lag(c, 10) OVER {W} AS osc FROM bars), x AS (SELECT pv.*, m.osc FROM pv JOIN m ON m.instrument = pv.instrument AND m.bar_idx = pv.bar_idx - 3 WHERE m.osc IS NOT NULL),
y AS (SELECT *, lag(bar_idx) OVER k AS i, lag(price) OVER k AS p, lag(osc) OVER k AS q FROM x WINDOW k AS (PARTITION BY instrument, kind ORDER BY bar_idx))
SELECT instrument, CASE kind WHEN 'high' THEN 'bearish' ELSE 'bullish' END AS side, i AS from_idx, bar_idx, round((osc - q) / (bar_idx - i), 6) AS slope FROM y WHERE bar_idx - i <= 60 AND ((kind = 'high' AND price > p AND osc < q) OR (kind = 'low' AND price < p AND osc > q))""")
def d_pair_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive pivots between which price and momentum part, with the slope."""
    b = ranged(spark, sf_dir)
    momentum = windows.bounded(b, 10, lambda w: {"osc": c("c") - F.lag("c", 10).over(w)}).select(*KEY, (c("bar_idx") + 3).alias("bar_idx"), "osc")
    found = pivots_of(b).join(momentum.where("osc IS NOT NULL"), [*KEY, "bar_idx"])
    return rounded(P.pair_divergences(found), "instrument", "side", "from_idx", "bar_idx", "slope")


_MEANS = f"""{BARS}, mm AS (SELECT *, {gate(5, 'c', f'avg(c) OVER {last(5)}')} AS a, {gate(20, 'c', f'avg(c) OVER {last(20)}')} AS b FROM bars)"""


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kept(windows.bounded(hourly(spark, sf_dir), 20, lambda w: {"a": windows.sma("c", 5, w), "b": windows.sma("c", 20, w)}))


@register(f"""WITH {_MEANS}, s AS (SELECT *, sign(a - b) AS s FROM mm WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT *, CASE WHEN lag(s) OVER {W} = s THEN 0 ELSE 1 END AS n FROM s), r AS (SELECT *, sum(n) OVER {_UPTO} AS seg FROM n),
g AS (SELECT instrument, seg, s, min(bar_idx) AS start_idx, max(bar_idx) AS end_idx, max(abs(a)) AS extreme FROM r GROUP BY 1, 2, 3), b AS (SELECT *, lag(extreme) OVER (PARTITION BY instrument, s ORDER BY seg) AS before FROM g)
SELECT instrument, CASE WHEN s > 0 THEN 'bullish' ELSE 'bearish' END AS side, start_idx, end_idx, round(extreme, 6) AS extreme, round(before, 6) AS before FROM b WHERE before >= 40 AND extreme < before""")
def e_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one sign whose extreme shrinks."""
    return rounded(E.waves(means(spark, sf_dir), "a", "b", 40), "instrument", "side", "start_idx", "end_idx", "extreme", "before")


@register(f"""WITH {_MEANS}, x AS (SELECT *, coalesce(a > b AND lag(a) OVER {W} <= lag(b) OVER {W}, false) AS reset FROM mm), y AS (SELECT *, CAST(sum(reset::INT) OVER {_UPTO} AS BIGINT) AS seg FROM x)
SELECT instrument, bar_idx, seg, CAST(sum(CASE WHEN c < o AND NOT reset THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, seg ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS held FROM y""")
def e_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a condition has held since the last reset."""
    w = windows.series()
    b = means(spark, sf_dir).withColumn("reset", E.crossover("a", "b", w))
    seg, one = E.held_since_reset(c("reset"), c("c") < c("o"), w)
    b = b.withColumns({"seg": seg, "one": one})
    held = F.sum("one").over(windows.series(*KEY, "seg").rowsBetween(Window.unboundedPreceding, 0))
    return b.select("instrument", "bar_idx", "seg", held.alias("held"))


@register(f"""WITH {BARS}, d AS (SELECT *, sign(c - o) AS s FROM bars WHERE c <> o), f AS (SELECT * FROM (SELECT *, lag(s) OVER {W} AS p FROM d) WHERE p <> s)
SELECT b.instrument, max(f.bar_idx) AS flip_idx, arg_max(f.s, f.bar_idx) AS direction, round(arg_max(f.c, f.bar_idx), 6) AS flip_price, max(b.e) - max(f.bar_idx) AS bars_since FROM (SELECT instrument, max(bar_idx) AS e FROM bars GROUP BY 1) b LEFT JOIN f USING (instrument) GROUP BY 1""")
def e_last_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of direction of each series and how many bars ago it was."""
    b = hourly(spark, sf_dir).withColumn("dir", F.signum(c("c") - c("o")))
    return rounded(E.last_flip(b, E.flips(b.where("dir <> 0"), "dir"), "dir").drop("timeframe"))


_STOCH = f"""{BARS}, st AS (SELECT *, {gate(14, 'c', f'CASE WHEN max(h) OVER {last(14)} = min(l) OVER {last(14)} THEN 0 ELSE (c - min(l) OVER {last(14)}) / (max(h) OVER {last(14)} - min(l) OVER {last(14)}) * 100 END')} AS q,
 {gate(40, 'c', f'CASE WHEN max(h) OVER {last(40)} = min(l) OVER {last(40)} THEN 0 ELSE (c - min(l) OVER {last(40)}) / (max(h) OVER {last(40)} - min(l) OVER {last(40)}) * 100 END')} AS q40 FROM bars)"""


def oscillating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.bounded(hourly(spark, sf_dir), 40, lambda w: {"q": windows.stochastic(w), "q40": windows.stochastic(w, 40)})


@register(f"""WITH {_STOCH}, x AS (SELECT *, lag(q) OVER {W} AS p FROM st) SELECT instrument, bar_idx, CASE WHEN q >= 90 AND p < 90 THEN 'ceiling' ELSE 'floor' END AS type FROM x WHERE (q >= 90 AND p < 90) OR (q <= 10 AND p > 10)""")
def e_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars at which an oscillator comes to its ceiling or floor."""
    return E.excursions(oscillating(spark, sf_dir), "q", 90, 10).drop("timeframe")


@register(f"""WITH {_STOCH}, x AS (SELECT *, lag(q) OVER {W} AS p FROM st), e AS (SELECT instrument, bar_idx, q >= 90 AND p < 90 AS up FROM x WHERE (q >= 90 AND p < 90) OR (q <= 10 AND p > 10)),
n AS (SELECT f.instrument, f.bar_idx AS floor_idx, min(k.bar_idx) AS ceiling_idx FROM e f JOIN e k ON k.instrument = f.instrument AND k.up AND k.bar_idx > f.bar_idx WHERE NOT f.up GROUP BY 1, 2) SELECT *, ceiling_idx - floor_idx AS gap FROM n WHERE ceiling_idx - floor_idx <= 20""")
def e_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a floor to the first ceiling after it, within twenty bars."""
    return E.round_trips(S.kept(E.excursions(oscillating(spark, sf_dir), "q", 90, 10)), 20).drop("timeframe")


_TIERS = f"""{_STOCH}, t0 AS (SELECT *, q / 50 - 1 AS fast, q40 / 50 - 1 AS slow, {gate(2, 'q', f'avg(q) OVER {last(2)}')} AS trg, {gate(9, 'q', f'avg(q) OVER {last(9)}')} AS line FROM st),
t1 AS (SELECT *, coalesce(q > trg AND lag(q) OVER {W} <= lag(trg) OVER {W}, false) AS up, coalesce(q < trg AND lag(q) OVER {W} >= lag(trg) OVER {W}, false) AS down, coalesce(fast > -0.9 AND lag(fast) OVER {W} <= -0.9, false) AS fr, coalesce(fast < 0.9 AND lag(fast) OVER {W} >= 0.9, false) AS ff, coalesce(slow > -0.9 AND lag(slow) OVER {W} <= -0.9, false) AS sr,
 coalesce(q > 20 AND lag(q) OVER {W} <= 20, false) AS r20, coalesce(q > 80 AND lag(q) OVER {W} <= 80, false) AS r80 FROM t0)"""


def _lately(cond: str, n: int) -> str:
    return f"bool_or({cond}) OVER (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@register(f"""WITH {_TIERS}, v AS (SELECT instrument, bar_idx, unnest([CASE WHEN slow <= -0.9 AND up AND {_lately('fr', 7)} AND q <= 20 AND {_lately('r20', 21)} THEN 'long_lime' END, CASE WHEN {_lately('down AND q <= 0', 5)} AND up THEN 'long_blue' END, CASE WHEN {_lately('down AND q <= 20', 11)} AND up AND q <= 60 THEN 'long_gray' END,
 CASE WHEN slow <= -0.9 AND up THEN 'long_yellow' END, CASE WHEN slow >= -0.9 AND down AND {_lately('ff', 7)} AND q >= 99 AND {_lately('r80', 21)} THEN 'break_short' END, CASE WHEN fast <= -0.9 AND up AND {_lately('sr', 7)} THEN 'boom' END, CASE WHEN q <= 20 AND {_lately('up AND q < 10', 5)} AND up THEN 'long_enter4' END, CASE WHEN up AND q < line THEN 'long_enter' END]) AS type FROM t1)
SELECT instrument, bar_idx, type FROM v WHERE type IS NOT NULL""")
def e_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tiers and the break down of an oscillator, its trigger and two quotients."""
    b = S.kept(oscillating(spark, sf_dir))
    b = windows.bounded(
        b, 40, lambda w: {"fast": c("q") / 50 - 1, "slow": c("q40") / 50 - 1, "trigger": windows.sma("q", 2, w), "line": windows.sma("q", 9, w)}, lambda w: E.oscillator_marks(w), lambda w: E.oscillator_tiers(w),
    )
    names = ["long_lime", "long_blue", "long_gray", "long_yellow", "break_short", "boom", "long_enter4", "long_enter"]
    return b.select("instrument", "bar_idx", F.explode(F.array_compact(F.array(*[F.when(c(n), F.lit(n)) for n in names]))).alias("type"))


_DAY = "SELECT instrument, t - t % {s} AS t, first(o ORDER BY t) AS o, last(c ORDER BY t) AS c FROM bars GROUP BY 1, 2"


@register(f"""WITH {BARS}, a AS ({_DAY.format(s=14400)}), d AS ({_DAY.format(s=86400)}), m AS (SELECT *, {gate(20, 'c', f'sign(c - avg(c) OVER {last(20)})')} AS s FROM bars), x AS (SELECT m.instrument, m.t, m.s, (SELECT arg_max(sign(a.c - a.o), a.t) FROM a WHERE a.instrument = m.instrument AND a.t + 14400 <= m.t + 3600) AS w4, (SELECT arg_max(sign(d.c - d.o), d.t) FROM d WHERE d.instrument = m.instrument AND d.t + 86400 <= m.t + 3600) AS w1 FROM m)
SELECT instrument, t, CASE WHEN s = 1 AND w4 = 1 AND w1 = 1 THEN 'up' WHEN s = -1 AND w4 = -1 AND w1 = -1 THEN 'down' END AS flag FROM x""")
def e_candle_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An oscillator's sign with the last closed candles of two slower rungs."""
    b = windows.bounded(hourly(spark, sf_dir), 20, lambda w: {"m": windows.sma("c", 20, w)}).withColumns({"s": F.signum(c("c") - c("m")), "at": c("t") + 3600})
    rungs = {n: S.kept(B.rollup(hourly(spark, sf_dir), [n]).where(c("timeframe") == n)) for n in ("4h", "1d")}
    return C.candle_flags(b, rungs, "s").select("instrument", "t", "flag")


_ZONES = f"""{_BLOCKS}, z AS (SELECT ob.*, (SELECT min(b.bar_idx) FROM bars b WHERE b.instrument = ob.instrument AND b.bar_idx >= created_idx AND CASE WHEN ob.side = 'bullish' THEN b.l < bar_low ELSE b.h > bar_high END) AS m FROM ob)"""


@register(f"""WITH {_ZONES} SELECT z.instrument, z.side, z.created_idx, b.bar_idx FROM z JOIN bars b ON b.instrument = z.instrument AND b.bar_idx >= created_idx AND b.bar_idx <= coalesce(m, 1000000000) AND b.h > bar_high AND b.c < bar_low""")
def z_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that go through a zone's top and close below its bottom."""
    z, b = blocks(spark, sf_dir)
    return Z.rejections(z, b).join(z.select("zone_id", "side", c("from_idx").alias("created_idx")), "zone_id").select("instrument", "side", "created_idx", "bar_idx")


@register(f"""WITH {_ZONES}, rb AS (SELECT *, {gate(14, 'h', f'avg(h - l) OVER {last(14)}')} AS atr FROM bars), e AS (SELECT k.instrument, k.side, k.bar_idx, b.c, b.atr FROM brk k JOIN rb b ON b.instrument = k.instrument AND b.bar_idx = k.bar_idx),
d AS (SELECT e.instrument, e.side, e.bar_idx, any_value(e.atr) AS atr, min(CASE WHEN CASE WHEN e.side = 'bullish' THEN bar_low - e.c ELSE e.c - bar_low END > 0 THEN CASE WHEN e.side = 'bullish' THEN bar_low - e.c ELSE e.c - bar_low END END) AS d FROM e LEFT JOIN z ON z.instrument = e.instrument AND e.bar_idx >= z.created_idx AND e.bar_idx <= coalesce(m, 1000000000) GROUP BY 1, 2, 3)
SELECT instrument, side, bar_idx, round(d / nullif(atr, 0), 6) AS distance, CASE WHEN d / nullif(atr, 0) IS NULL THEN 'none' WHEN d / nullif(atr, 0) < 1 THEN 'near' WHEN d / nullif(atr, 0) < 3 THEN 'middle' ELSE 'far' END AS bucket FROM d""")
def z_nearest_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest standing level in a break's direction, in mean ranges."""
    z, b = blocks(spark, sf_dir)
    b = windows.bounded(b.withColumn("_r", c("h") - c("l")), 20, lambda w: {"atr": windows.sma("_r", 14, w)})
    e = breaks_of(b.drop("atr", "_r")).join(b.select(*KEY, "bar_idx", c("c").alias("price"), "atr"), [*KEY, "bar_idx"]).withColumn("event_id", F.xxhash64("instrument", "side", "bar_idx"))
    e = S.kept(e.select("event_id", *KEY, "side", "bar_idx", "price", "atr"))
    return rounded(Z.nearest_pool(e, z.select(*KEY, c("lo").alias("level"), "from_idx", "to_idx")), "instrument", "side", "bar_idx", "distance", "bucket")


@register(f"""WITH {_BLOCKS}, p AS (SELECT ob.*, (SELECT arg_max(sl, bar_idx) FROM x3 WHERE x3.instrument = ob.instrument AND x3.bar_idx <= created_idx) AS line, (SELECT arg_max(type, {{'i': bar_idx, 't': type}}) FROM brk WHERE brk.instrument = ob.instrument AND brk.bar_idx <= created_idx) AS structure FROM ob)
SELECT instrument, side, created_idx, CASE WHEN line IS NULL THEN 'none' WHEN abs((bar_low + bar_high) / 2 - line) <= 0.02 * line THEN 'at' WHEN (bar_low + bar_high) / 2 < line THEN 'below' ELSE 'above' END AS position, structure FROM p""")
def c_structure_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones by their place against the standing swing low, with the break before them."""
    z, b = blocks(spark, sf_dir)
    lines = P.swings(b, 5, "swing").where("swing_low IS NOT NULL").select(*KEY, "bar_idx", c("swing_low").alias("line"))
    return C.structure_position(z, lines, breaks_of(b), 0.02, KEY).select("instrument", "side", c("from_idx").alias("created_idx"), "position", "structure")

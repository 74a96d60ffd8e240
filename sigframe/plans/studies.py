"""Registered queries over trades, costs, groups, tests and nulls, each with the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows
from ..operators import aggregates as A
from ..operators import bars as B
from ..operators import compose as C
from ..operators import events as E
from ..operators import joins as J
from ..operators import outcomes as O
from ..operators import resampling as R
from ..operators import zones as Z
from ..schema import KEY, SECONDS
from ..sources import tables as S
from .further import _DRAW
from .relations import _TRADES, blocks, trades
from .series import _BLOCKS, _SWING, BARS, W, gate, hourly, last, register, rounded
from .structures import _ZONES, breaks_of, ranged

c = F.col
_RANGED = f"rb AS (SELECT *, {gate(14, 'h', f'avg(h - l) OVER {last(14)}')} AS atr FROM bars)"
_UPTO = "(PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register(f"""WITH {BARS}, {_RANGED}, x AS (SELECT *, lead(c, 5) OVER {W} - c AS f FROM rb) SELECT instrument, bar_idx, round(f / nullif(atr, 0), 6) AS fwd_atr FROM x""")
def l_scaled_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: moves over the next five bars in mean ranges."""
    return rounded(O.scaled_return(ranged(spark, sf_dir), 5), "instrument", "bar_idx", "fwd_atr")


@register(f"""WITH {BARS} SELECT instrument, bar_idx, round(max(h) OVER k - c, 6) AS rise, round(c - min(l) OVER k, 6) AS fall, count(*) OVER k > 0 AS has_next FROM bars WINDOW k AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""")
def l_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the greatest rise and fall within the next ten bars."""
    got = O.excursion(hourly(spark, sf_dir), 10)
    return rounded(got.withColumn("has_next", c("rise").isNotNull()), "instrument", "bar_idx", "rise", "fall", "has_next")


@register(f"""WITH {BARS}, x AS (SELECT a.instrument, a.bar_idx, b.bar_idx - a.bar_idx AS d, b.h, b.l FROM bars a JOIN bars b ON b.instrument = a.instrument AND b.bar_idx BETWEEN a.bar_idx + 1 AND a.bar_idx + 10) SELECT instrument, bar_idx, arg_max(d, {{'h': h, 'd': -d}}) AS rise_bars, arg_min(d, {{'l': l, 'd': d}}) AS fall_bars FROM x GROUP BY 1, 2""")
def l_excursion_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: how soon the greatest rise and fall come."""
    return O.excursion(hourly(spark, sf_dir), 10).where("rise IS NOT NULL").select("instrument", "bar_idx", "rise_bars", "fall_bars")


_HELD = f"""{_TRADES}, hb AS (SELECT *, {gate(14, 'h', f'avg(h - l) OVER {last(14)}')} AS atr FROM bars), ct AS (SELECT t.*, b.atr FROM trades t JOIN hb b ON b.instrument = t.instrument AND b.bar_idx = t.bar_idx)"""


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with the mean range at their signal."""
    t, b = trades(spark, sf_dir)
    b = windows.bounded(b.withColumn("_r", c("h") - c("l")), 20, lambda w: {"atr": windows.sma("_r", 14, w)})
    return t.join(b.select(*KEY, "bar_idx", "atr"), [*KEY, "bar_idx"])


@register(f"""WITH {_HELD}, x AS (SELECT *, entry + s * 0.1 * atr AS e2, ex - CASE WHEN why = 'target' THEN 0 ELSE 0.1 * s * atr END AS x2 FROM ct) SELECT instrument, side, bar_idx, round(s * (x2 - e2) / e2 * 100 - (0.05 + CASE WHEN why = 'target' THEN 0.02 ELSE 0.05 END), 5) AS net_pct FROM x""")
def l_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net of slippage in mean ranges and of makers' and takers' fees."""
    return rounded(O.slipped(held(spark, sf_dir), 0.1, 0.05, 0.02), "instrument", "side", "bar_idx", "net_pct", places=5)


@register(f"""WITH {_TRADES}, fees(taker) AS (VALUES (0.0::DOUBLE), (0.05), (0.1)) SELECT instrument, side, bar_idx, taker, round(pnl - 2 * taker - 0.01 * (held / 8.0), 5) AS pro_rata, round(pnl - 2 * taker - 0.01 * floor(held / 8.0), 5) AS stepped FROM trades, fees""")
def l_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees and funding in both modes, over a grid of fees."""
    t, _ = trades(spark, sf_dir)
    t = J.grid(t.withColumn("hours", c("bars_held").cast("double")), "taker", [0.0, 0.05, 0.1])
    net = {m: F.round(O.costed("pnl_pct", "hours", 0.0, 0.01, m) - 2 * c("taker"), 5).alias(m) for m in ("pro_rata", "stepped")}
    return t.select("instrument", "side", "bar_idx", "taker", *net.values())


@register(f"""WITH {_HELD}, x AS (SELECT *, entry - s * 1.5 * atr AS a, CASE WHEN s = 1 THEN stop - 1 ELSE stop + 1 END AS e, stop AS w FROM ct), y AS (SELECT instrument, side, bar_idx, unnest([{{'kind': 'atr', 'stop': a}}, {{'kind': 'edge', 'stop': e}}, {{'kind': 'swing', 'stop': w}}]) AS k, s, entry FROM x)
SELECT instrument, side, bar_idx, k.kind AS kind, round(k.stop, 6) AS stop, round(s * (entry - k.stop), 6) AS risk FROM y WHERE s * (entry - k.stop) > 0""")
def l_risk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops by mean range, by a zone's far edge and by a swing, where the risk is above nothing."""
    t = held(spark, sf_dir).withColumns({"edge": c("stop") - O.sign(), "swing": c("stop")})
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), O.risk_stop(k, 1.5).alias("stop")) for k in ("atr", "edge", "swing")])
    rows = t.select("instrument", "side", "bar_idx", "entry", F.explode(kinds).alias("k")).withColumn("risk", O.sign() * (c("entry") - c("k.stop")))
    return rounded(rows.where("risk > 0").select("instrument", "side", "bar_idx", c("k.kind").alias("kind"), c("k.stop").alias("stop"), "risk"))


@register(f"""WITH {BARS}, d AS (SELECT *, sign(c - o) AS s FROM bars WHERE c <> o), f AS (SELECT instrument, bar_idx, s, lead(bar_idx) OVER {W} AS n FROM (SELECT *, lag(s) OVER {W} AS p FROM d) WHERE p <> s), e AS (SELECT instrument, max(bar_idx) AS e, arg_max(c, bar_idx) AS lc FROM bars GROUP BY 1)
SELECT f.instrument, f.bar_idx, CASE WHEN s > 0 THEN 'bullish' ELSE 'bearish' END AS side, x.o IS NULL AS open_at_end, coalesce(n, e) - f.bar_idx AS bars_held, round(s * (coalesce(x.o, lc) - i.o) / i.o * 100, 5) AS pnl_pct FROM f JOIN bars i ON i.instrument = f.instrument AND i.bar_idx = f.bar_idx + 1 JOIN e ON e.instrument = f.instrument LEFT JOIN bars x ON x.instrument = f.instrument AND x.bar_idx = f.n + 1""")
def l_flip_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each change of direction to the next."""
    b = hourly(spark, sf_dir).withColumn("dir", F.signum(c("c") - c("o")))
    flips = E.flips(b.where("dir <> 0"), "dir").withColumn("side", F.when(c("dir") > 0, "bullish").otherwise("bearish"))
    got = O.flip_trades(S.kept(flips.select(*KEY, "bar_idx", "side")), b)
    return rounded(got, "instrument", "bar_idx", "side", "open_at_end", "bars_held", "pnl_pct", places=5)


@register(f"""WITH {_TRADES}, ends AS (SELECT instrument, max(bar_idx) AS e FROM bars GROUP BY 1) SELECT instrument, side, bar_idx, CASE WHEN xi <= e - 2 THEN 'resolved' ELSE 'open' END AS status FROM trades JOIN ends USING (instrument)""")
def l_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades that are over two bars before the last bar, and those still open."""
    t, b = trades(spark, sf_dir)
    return O.settled(t, b).select("instrument", "side", "bar_idx", "status")


@register(f"""WITH {_SWING}, k AS (SELECT *, lead(bar_idx) OVER (PARTITION BY instrument ORDER BY bar_idx, side) AS nxt FROM brk WHERE type = 'CHOCH'),
e AS (SELECT k.instrument, k.side, k.bar_idx, nxt, n.bar_idx AS ei, n.o AS entry, CASE WHEN k.side = 'bullish' THEN b.l - 20 ELSE b.h + 20 END AS stop, CASE WHEN k.side = 'bullish' THEN 1 ELSE -1 END AS s FROM k JOIN bars b ON b.instrument = k.instrument AND b.bar_idx = k.bar_idx JOIN bars n ON n.instrument = k.instrument AND n.bar_idx = k.bar_idx + 1),
h AS (SELECT e.instrument, e.side, e.bar_idx, nxt, ei, entry, stop, s, min(b.bar_idx) AS si FROM e LEFT JOIN bars b ON b.instrument = e.instrument AND b.bar_idx >= ei AND CASE WHEN s = 1 THEN b.l < stop ELSE b.h > stop END WHERE (entry - stop) * s > 0 GROUP BY ALL),
x AS (SELECT h.*, b.o AS no, CASE WHEN si IS NOT NULL AND (b.o IS NULL OR si <= nxt) THEN 'stop' WHEN b.o IS NOT NULL THEN 'opposite' ELSE 'open' END AS why FROM h LEFT JOIN bars b ON b.instrument = h.instrument AND b.bar_idx = nxt + 1)
SELECT instrument, side, bar_idx, ei AS entry_idx, why AS exit_reason, CASE why WHEN 'stop' THEN si WHEN 'opposite' THEN nxt + 1 END AS exit_idx, round(s * (CASE why WHEN 'stop' THEN stop WHEN 'opposite' THEN no END - entry) / entry * 100, 5) AS pnl_pct FROM x""")
def l_regime_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a turn of the bias to the next one, or to a stop beyond the bar."""
    b = hourly(spark, sf_dir)
    k = breaks_of(b).join(b.select(*KEY, "bar_idx", F.struct("l", "h").alias("_b")), [*KEY, "bar_idx"])
    k = k.withColumn("stop", F.when(c("side") == "bullish", c("_b.l") - 20).otherwise(c("_b.h") + 20)).drop("_b").withColumn("event_id", F.xxhash64("instrument", "side", "bar_idx"))
    return rounded(O.regime_holds(S.kept(k), b), "instrument", "side", "bar_idx", "entry_idx", "exit_reason", "exit_idx", "pnl_pct", places=5)


@register(f"""WITH {_BLOCKS} SELECT ob.instrument, ob.side, created_idx, min(b.bar_idx) AS entry_idx, round(CASE WHEN ob.side = 'bullish' THEN bar_high ELSE bar_low END, 6) AS entry FROM ob JOIN bars b ON b.instrument = ob.instrument AND b.bar_idx BETWEEN created_idx + 3 AND created_idx + 200 AND CASE WHEN ob.side = 'bullish' THEN b.l < bar_high ELSE b.h > bar_low END GROUP BY ob.instrument, ob.side, created_idx, bar_low, bar_high""")
def l_retest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first touch of a zone at least three bars after it began, at its near edge."""
    z, b = blocks(spark, sf_dir)
    return rounded(O.retest_entries(z, b).withColumnRenamed("from_idx", "created_idx"), "instrument", "side", "created_idx", "entry_idx", "entry")


@register(f"""WITH {_SWING}, v AS (SELECT instrument, bar_idx AS i, level FROM brk WHERE side = 'bearish'), m AS (SELECT v.instrument, i, v.level, min(b.bar_idx) AS hit FROM v JOIN bars b ON b.instrument = v.instrument AND b.bar_idx > i AND b.h > v.level GROUP BY 1, 2, 3),
r AS (SELECT m.instrument, i, m.level, hit, min(CASE WHEN b.h > m.level + 10 THEN b.bar_idx END) AS up, min(CASE WHEN b.l < m.level - 10 THEN b.bar_idx END) AS down FROM m LEFT JOIN bars b ON b.instrument = m.instrument AND b.bar_idx BETWEEN hit + 1 AND hit + 201 GROUP BY 1, 2, 3, 4)
SELECT instrument, i AS from_idx, hit AS hit_idx, CASE WHEN up IS NULL AND down IS NULL THEN 'neither' WHEN down IS NULL OR up < down THEN 'continuation' WHEN up IS NULL OR down < up THEN 'reversal' ELSE 'both' END AS reaction FROM r""")
def l_level_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether price turns back at a level met from below, or goes on."""
    b = hourly(spark, sf_dir)
    k = breaks_of(b).where("side = 'bearish'").select(F.xxhash64("instrument", "bar_idx").alias("level_id"), *KEY, "level", c("bar_idx").alias("at"), (c("bar_idx") + 1).alias("from_idx"), F.lit(10.0).alias("band"))
    return O.level_reactions(S.kept(k), b, "band").select("instrument", c("at").alias("from_idx"), "hit_idx", "reaction")


@register(f"""WITH {_TRADES}, y AS (SELECT t.*, year(make_timestamp(b.t * 1000000)) AS y FROM trades t JOIN bars b ON b.instrument = t.instrument AND b.bar_idx = ei) SELECT instrument, CAST(y AS BIGINT) AS year, count(*) AS n, CAST(count(CASE WHEN pnl > 0 THEN 1 END) AS BIGINT) AS wins, round(avg(pnl), 4) AS expectancy FROM y GROUP BY 1, 2""")
def a_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: results by calendar year of the entry."""
    t, b = trades(spark, sf_dir)
    t = t.join(b.select(*KEY, c("bar_idx").alias("entry_idx"), c("t")), [*KEY, "entry_idx"]).withColumn("year", F.year(F.timestamp_seconds("t")).cast("long"))
    return rounded(A.metrics(t, ["instrument", "year"]), "instrument", "year", "n", "wins", "expectancy", places=4)


@register(f"""WITH {BARS}, h AS (SELECT instrument, arg_max(c, bar_idx) / nullif(arg_min(o, bar_idx), 0) AS m, avg(CASE WHEN c > o THEN 1.0 ELSE 0.0 END) AS s, count(CASE WHEN c > o THEN 1 END) AS n FROM bars GROUP BY 1) SELECT instrument, round(m, 6) AS hold_multiple, round(s, 6) AS share, CAST(n AS BIGINT) AS bars FROM h""")
def a_hold_and_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holding brings, and the share of bars in a state."""
    b = hourly(spark, sf_dir)
    return rounded(A.buy_and_hold(b, ["instrument"]).join(A.share_in_state(b, c("c") > c("o"), ["instrument"]), "instrument"))


@register(f"""WITH {_TRADES}, m AS (SELECT instrument, ei AS t, 1 AS d FROM trades UNION ALL SELECT instrument, xi, -1 FROM trades), s AS (SELECT instrument, t, sum(d) AS d FROM m GROUP BY 1, 2), o AS (SELECT *, CAST(sum(d) OVER (PARTITION BY instrument ORDER BY t) AS BIGINT) AS open FROM s) SELECT instrument, open, count(*) AS times FROM o GROUP BY 1, 2""")
def a_concurrency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At how many times each number of trades was open."""
    t, _ = trades(spark, sf_dir)
    return A.concurrency_profile(t, ["instrument"], "entry_idx", "exit_idx")


@register(f"""WITH {_TRADES}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY held) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM trades) SELECT instrument, max(CASE WHEN i = floor(n * 0.25) THEN held END) AS q25, max(CASE WHEN i = floor(n * 0.5) THEN held END) AS q50, max(CASE WHEN i = floor(n * 0.9) THEN held END) AS q90 FROM k GROUP BY 1""")
def a_hold_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of how long trades are held."""
    t, _ = trades(spark, sf_dir)
    cuts = windows.quantile_cuts(t, "bars_held", [0.25, 0.5, 0.9], ["instrument"])
    return cuts.select("instrument", *[c("cuts")[i].alias(n) for i, n in enumerate(("q25", "q50", "q90"))])


@register(f"""WITH {_TRADES} SELECT least(held, 4) AS bucket, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS rate FROM trades GROUP BY 1""")
def a_rate_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rates by a count, the top bucket open."""
    t, _ = trades(spark, sf_dir)
    return A.rate_by_count(t, "bars_held", c("r") > 0).select("bucket", "n", F.round("rate", 6).alias("rate"))


@register(f"""WITH {_TRADES} SELECT count(*) AS entered, CAST(count(CASE WHEN why <> 'timeout' THEN 1 END) AS BIGINT) AS decided, CAST(count(CASE WHEN why <> 'timeout' AND r > 0 THEN 1 END) AS BIGINT) AS won, CAST(count(CASE WHEN why <> 'timeout' AND r > 0 AND held <= 2 THEN 1 END) AS BIGINT) AS won_soon FROM trades""")
def a_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many trades pass each condition and all before it."""
    t, _ = trades(spark, sf_dir)
    return A.funnel(t, {"entered": F.lit(True), "decided": c("exit_reason") != "timeout", "won": c("r") > 0, "won_soon": c("bars_held") <= 2})


@register(f"""WITH {_TRADES}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ei DESC, xi DESC, side) AS i FROM trades) SELECT instrument, side, ei AS entry_idx, xi AS exit_idx, round(pnl, 5) AS pnl_pct FROM k WHERE i <= 3""")
def a_last_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three trades of each instrument, by entry and exit."""
    t, _ = trades(spark, sf_dir)
    return rounded(A.top(t, ["instrument"], [F.desc("entry_idx"), F.desc("exit_idx"), c("side")], 3), "instrument", "side", "entry_idx", "exit_idx", "pnl_pct", places=5)


@register(f"""WITH {_SWING}, g AS (SELECT *, lag(h, 2) OVER {W} AS h2, lag(l, 2) OVER {W} AS l2 FROM bars), u AS (SELECT instrument, bar_idx, side, 'break' AS source FROM brk UNION ALL SELECT instrument, bar_idx, CASE WHEN l > h2 THEN 'bullish' ELSE 'bearish' END, 'gap' FROM g WHERE l > h2 OR h < l2)
SELECT instrument, bar_idx, side, min(source) AS source FROM u GROUP BY 1, 2, 3""")
def a_pooled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two strategies put together, each bar and side once."""
    b = hourly(spark, sf_dir)
    w = windows.series()
    gap = F.when(c("l") > F.lag("h", 2).over(w), "bullish").when(c("h") < F.lag("l", 2).over(w), "bearish")
    gaps = b.withColumn("side", gap).where("side IS NOT NULL").select("instrument", "bar_idx", "side", F.lit("gap").alias("source"))
    both = breaks_of(b).select("instrument", "bar_idx", "side", F.lit("break").alias("source")).unionByName(gaps)
    return C.dedupe_entries(both, ["instrument", "bar_idx", "side"], ["source"])


_RUNGS = f"""{BARS}, r(timeframe, s, off) AS (VALUES ('4h', 14400, 0), ('1d', 86400, 0), ('1w', 604800, 345600)), x AS (SELECT b.instrument, r.timeframe, r.s, b.t - (b.t - off) % s AS t, first(o ORDER BY b.t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY b.t) AS c FROM bars b, r GROUP BY 1, 2, 3, 4)"""


def rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of three slower timeframes."""
    return S.kept(B.rollup(B.from_ticks(S.ticks(spark, sf_dir)), ["4h", "1d", "1w"]).where("timeframe <> '1h'"))


@register(f"""WITH {_RUNGS}, z AS (SELECT instrument, timeframe, t, c FROM x WHERE c > 0 AND c > o), p AS (SELECT a.instrument, a.timeframe, a.t, b.timeframe AS tb FROM z a JOIN z b ON b.instrument = a.instrument AND (b.timeframe, b.t) <> (a.timeframe, a.t) AND abs(b.c - a.c) <= 0.02 * greatest(a.c, b.c) AND abs(b.t - a.t) <= 604800)
SELECT z.instrument, z.timeframe, z.t, CAST(count(DISTINCT CASE WHEN tb <> z.timeframe THEN tb END) AS BIGINT) AS timeframes, CAST(count(tb) AS BIGINT) AS zones, CAST(count(CASE WHEN tb = z.timeframe THEN 1 END) AS BIGINT) AS same_timeframe FROM z LEFT JOIN p USING (instrument, timeframe, t) GROUP BY 1, 2, 3""")
def c_confluence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many timeframes a level near in price and time stands."""
    x = rungs(spark, sf_dir).where("c > 0 AND c > o")
    zones = S.kept(x.select(F.xxhash64("instrument", "timeframe", "t").alias("zone_id"), "instrument", "timeframe", "t", c("c").alias("price")))
    week = F.floor(c("t") / 604800)
    left = zones.withColumn("cell", F.explode(F.array(week - 1, week, week + 1)))
    right = zones.select("instrument", week.alias("cell"), c("zone_id").alias("other"), c("t").alias("u"), "price")
    pairs = J.price_band(left, right, ["instrument", "cell"], "zone_id", "other", "price", 0.02).where("a <> b")
    times = zones.select("zone_id", "t")
    near = pairs.join(times.select(c("zone_id").alias("a"), c("t").alias("ta")), "a").join(times.select(c("zone_id").alias("b"), c("t").alias("tb")), "b").where("abs(ta - tb) <= 604800")
    return C.confluence(zones, near).join(zones, "zone_id").select("instrument", "timeframe", "t", "timeframes", "zones", "same_timeframe")


@register(f"""WITH {_RUNGS}, s AS (SELECT b.instrument, b.t, (SELECT arg_max(sign(x.c - x.o), x.t) FROM x WHERE x.instrument = b.instrument AND x.timeframe = '1w' AND x.t + 604800 <= b.t + 3600) AS w, (SELECT arg_max(sign(x.c - x.o), x.t) FROM x WHERE x.instrument = b.instrument AND x.timeframe = '1d' AND x.t + 86400 <= b.t + 3600) AS d, (SELECT arg_max(sign(x.c - x.o), x.t) FROM x WHERE x.instrument = b.instrument AND x.timeframe = '4h' AND x.t + 14400 <= b.t + 3600) AS h FROM bars b)
SELECT instrument, t, CASE WHEN w IS NULL THEN 0 WHEN d IS NULL OR d <> w THEN 1 WHEN h IS NULL OR h <> w THEN 2 ELSE 3 END AS depth FROM s""")
def c_agreement_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rungs from the slowest on agree."""
    x = rungs(spark, sf_dir).withColumn("state", F.signum(c("c") - c("o")))
    b = hourly(spark, sf_dir).withColumn("at", c("t") + 3600)
    seen = C.snapshot(b, {n: S.kept(x.where(c("timeframe") == n)) for n in ("1w", "1d", "4h")}, ["state"])
    return C.agreement_depth(seen, ["1w", "1d", "4h"]).select("instrument", "t", "depth")


@register(f"""WITH {BARS}, {_RANGED.replace("rb AS", "rx AS")}, m AS (SELECT *, {gate(20, 'c', f'avg(c) OVER {last(20)}')} AS m FROM bars), e AS (SELECT instrument, t, bar_idx FROM bars WHERE c > o), s AS (SELECT instrument, t, sign(c - m) AS s FROM m WHERE m IS NOT NULL)
SELECT e.instrument, e.bar_idx FROM e JOIN s ON s.instrument = e.instrument AND s.t = e.t WHERE s.s > 0""")
def c_state_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events where the last state of another indicator agrees."""
    b = S.kept(windows.bounded(hourly(spark, sf_dir), 20, lambda w: {"m": windows.sma("c", 20, w)}))
    states = b.where("m IS NOT NULL").select("instrument", "t", F.signum(c("c") - c("m")).alias("state"))
    return C.state_gate(b.where("c > o").select("instrument", "t", "bar_idx"), states, "t", "state", c("state_asof") > 0, ["instrument"]).select("instrument", "bar_idx")


@register(f"""WITH {_RUNGS}, y AS (SELECT instrument, timeframe, t, c FROM x UNION ALL SELECT instrument, '1h', t, c FROM bars) SELECT instrument, max(CASE WHEN timeframe = '1h' THEN v END) AS "1h", max(CASE WHEN timeframe = '4h' THEN v END) AS "4h", max(CASE WHEN timeframe = '1d' THEN v END) AS "1d", max(CASE WHEN timeframe = '1w' THEN v END) AS "1w" FROM (SELECT instrument, timeframe, round(arg_max(c, t), 6) AS v FROM y GROUP BY 1, 2) GROUP BY 1""")
def c_latest_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each instrument on each rung."""
    columns = ["instrument", "timeframe", "t", "c"]
    got = C.latest_matrix(rungs(spark, sf_dir).select(columns).unionByName(hourly(spark, sf_dir).select(columns)), c("c"))
    return rounded(got, "instrument", "1h", "4h", "1d", "1w")


@register(f"""WITH {_TRADES}, x AS (SELECT t.*, b.c > b.o AS up FROM trades t JOIN bars b ON b.instrument = t.instrument AND b.bar_idx = t.bar_idx), h AS (SELECT instrument, count(*) AS n FROM trades GROUP BY 1)
SELECT instrument, CAST(count(*) AS BIGINT) AS n FROM trades t WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.instrument = t.instrument AND b.bar_idx BETWEEN t.bar_idx - 3 AND t.bar_idx AND b.v > 150) GROUP BY 1""")
def j_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades without a bar of high volume shortly before."""
    t, b = trades(spark, sf_dir)
    near = b.where("v > 150").select("instrument", F.explode(F.sequence(c("bar_idx"), c("bar_idx") + 3)).alias("bar_idx")).distinct()
    return t.join(near, ["instrument", "bar_idx"], "left_anti").groupBy("instrument").agg(F.count("*").alias("n"))


@register(f"""WITH {_TRADES} SELECT instrument, round(avg(CASE WHEN held >= 3 THEN CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END END) - avg(CASE WHEN held <= 1 THEN CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END END), 6) AS gap FROM trades GROUP BY 1""")
def q_bucket_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: win rate of the top bucket less that of the bottom one."""
    t, _ = trades(spark, sf_dir)
    return rounded(R.bucket_gap(t, "bars_held", c("r") > 0, c("bars_held") <= 1, c("bars_held") >= 3, ["instrument"]))


@register(f"""WITH {_TRADES}, k AS (SELECT instrument, avg(pnl) AS m, stddev_samp(pnl) AS s, count(*) AS n, count(CASE WHEN side = 'bullish' THEN 1 END)::DOUBLE AS na, count(CASE WHEN side = 'bullish' AND pnl > 0 THEN 1 END)::DOUBLE AS wa, count(CASE WHEN side = 'bearish' THEN 1 END)::DOUBLE AS nb, count(CASE WHEN side = 'bearish' AND pnl > 0 THEN 1 END)::DOUBLE AS wb FROM trades GROUP BY 1)
SELECT instrument, round(m / nullif(s / sqrt(n), 0), 6) AS t, round((wa / nullif(na, 0) - wb / nullif(nb, 0)) / nullif(sqrt((wa + wb) / (na + nb) * (1 - (wa + wb) / (na + nb)) * (1 / nullif(na, 0) + 1 / nullif(nb, 0))), 0), 6) AS z FROM k""")
def q_one_and_two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: t of the mean result, z of the win rates of both sides."""
    t, _ = trades(spark, sf_dir)
    one = R.one_sample(t, "pnl_pct", ["instrument"]).select("instrument", "t")
    n = lambda s, w: F.nullif(F.count(F.when((c("side") == s) & (c("pnl_pct") > 0 if w else F.lit(True)), 1)).cast("double"), F.lit(-1.0))
    sides = t.groupBy("instrument").agg(*[n(s, w).alias(f"{k}{v}") for s, k in (("bullish", "a"), ("bearish", "b")) for w, v in ((True, "w"), (False, "n"))])
    z = R.two_proportions(c("aw"), F.nullif(c("an"), F.lit(0.0)), c("bw"), F.nullif(c("bn"), F.lit(0.0)))
    return rounded(one.join(sides.select("instrument", z.alias("z")), "instrument"))


@register(f"""WITH {_TRADES}, k AS (SELECT instrument, count(*) AS n, count(CASE WHEN r > 0 THEN 1 END) AS w FROM trades GROUP BY 1), i AS (SELECT k.*, unnest(generate_series(w, n)) AS j FROM k) SELECT instrument, n, CAST(w AS BIGINT) AS wins, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + n * ln(0.5)))), 6) AS p FROM i GROUP BY 1, 2, 3""")
def q_binomial_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14: the chance of as many wins or more by tosses of a coin."""
    t, _ = trades(spark, sf_dir)
    k = t.groupBy("instrument").agg(F.count("*").alias("n"), F.count(F.when(c("r") > 0, 1)).alias("wins"))
    return rounded(k.withColumn("p", R.binomial_tail(c("wins"), c("n"), 0.5)))


@register(f"""WITH {BARS}, x AS (SELECT instrument, CAST(c > o AS INT) AS up, CAST(lead(c) OVER {W} > lead(o) OVER {W} AS INT) AS nxt FROM bars), k AS (SELECT instrument, up, nxt, count(*) AS n FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT *, sum(n) OVER (PARTITION BY instrument) AS t, sum(n) OVER (PARTITION BY instrument, up) AS a, sum(n) OVER (PARTITION BY instrument, nxt) AS b FROM k),
m AS (SELECT instrument, max(t) AS w, sum(n / t * log2(n * t / (a * b))) AS mi FROM p GROUP BY 1) SELECT round(sum(mi * w) / sum(w), 6) AS cmi FROM m""")
def q_conditional_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15: mutual information within instruments, weighted by their size."""
    w = windows.series()
    b = hourly(spark, sf_dir).select("instrument", (c("c") > c("o")).cast("int").alias("up"), (F.lead("c").over(w) > F.lead("o").over(w)).cast("int").alias("nxt")).where("nxt IS NOT NULL")
    return rounded(R.conditional_information(A.contingency(b, "instrument", "up", "nxt"), "up", "nxt", ["instrument"]))


@register(f"""WITH {_TRADES}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY held) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM trades), m AS (SELECT instrument, max(CASE WHEN i = floor(n * 0.5) THEN held END) AS cut FROM k GROUP BY 1)
SELECT instrument, side, held > cut AS high, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM trades JOIN m USING (instrument) GROUP BY 1, 2, 3""")
def q_within_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7, Q19: rates above and below the middle of a count, within sides."""
    t, _ = trades(spark, sf_dir)
    return rounded(R.within_strata(t, "bars_held", "side", c("r") > 0, ["instrument"]))


@register(f"""WITH {BARS}, {_RANGED}, z AS (SELECT instrument, count(*) AS n FROM bars GROUP BY 1), j AS (SELECT unnest(generate_series(0, 99)) AS draw), ks AS (SELECT unnest(generate_series(1, 200)) AS k), {_DRAW},
dr AS (SELECT z.instrument, draw, CAST(floor(p.u * n) AS BIGINT) AS i, q.u AS u FROM z, j JOIN u p ON p.k = 2 * draw + 1 JOIN u q ON q.k = 2 * draw + 2), l AS (SELECT dr.instrument, draw, i, b.c + dr.u * 3.0 * b.atr AS level FROM dr JOIN rb b ON b.instrument = dr.instrument AND b.bar_idx = i WHERE atr IS NOT NULL)
SELECT l.instrument, draw, i AS bar_idx, round(level, 5) AS level, min(b.bar_idx) AS hit_idx FROM l LEFT JOIN bars b ON b.instrument = l.instrument AND b.bar_idx > i AND b.bar_idx <= i + 50 AND b.h > level GROUP BY 1, 2, 3, 4""")
def q_random_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: random levels above random bars, and when they are swept."""
    return rounded(R.random_level_sweeps(ranged(spark, sf_dir), 100, 50, 3.0, ["instrument"]), "instrument", "draw", "bar_idx", "level", "hit_idx", places=5)


@register(f"""WITH {BARS}, s AS (SELECT instrument, bar_idx AS unit, c, count(*) OVER (PARTITION BY instrument) AS n FROM bars), g AS (SELECT unnest(generate_series(0, 9)) AS rep), rk AS (SELECT s.*, rep, rep * n + unit + 1 AS k FROM s, g), ks AS (SELECT DISTINCT k FROM rk), {_DRAW}, o AS (SELECT instrument, rep, c, row_number() OVER (PARTITION BY instrument, rep ORDER BY u.u, unit) AS i FROM rk JOIN u USING (k))
SELECT instrument, rep, round(avg(c) + 1e-9, 5) AS mean FROM o WHERE i <= 30 GROUP BY 1, 2""")
def q_random_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: means of random subsets of bars."""
    b = hourly(spark, sf_dir).withColumnRenamed("bar_idx", "unit")
    got = R.random_subsets(b, "c", 30, 10, ["instrument"])
    return got.select("instrument", "rep", F.round(c("mean") + 1e-9, 5).alias("mean"))


@register(f"""WITH {_TRADES}, y AS (SELECT *, max(xi) OVER (PARTITION BY instrument ORDER BY ei, xi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM trades), z AS (SELECT *, sum(CASE WHEN ei < m THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY ei, xi ROWS UNBOUNDED PRECEDING) AS k FROM y), ch AS (SELECT instrument, k, avg(pnl) AS p FROM z GROUP BY 1, 2),
s AS (SELECT instrument, avg(p) AS m, stddev_samp(p) AS s, count(*) AS n FROM ch GROUP BY 1), fw AS (SELECT instrument, (lead(c, 5) OVER {W} - c) / nullif(c, 0) * 100 AS f FROM bars)
SELECT s.instrument, round(any_value(m), 5) AS m, round(any_value(m) / nullif(any_value(s.s) / sqrt(any_value(n)), 0), 5) AS t, any_value(n) AS n, round(avg(CASE WHEN fw.f < m THEN 1.0 ELSE 0.0 END) * 100, 5) AS percentile FROM s JOIN fw ON fw.instrument = s.instrument AND fw.f IS NOT NULL GROUP BY 1""")
def q_cluster_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q17: t of the means of chains of overlapping trades, and their place in the moves of all bars."""
    t, b = trades(spark, sf_dir)
    chains = A.overlap_clusters(t, ["instrument"], "entry_idx", "exit_idx", "pnl_pct")
    null = O.forward_return(b, 5).withColumn("f", F.try_divide(c("fwd"), c("c")) * 100).where("f IS NOT NULL")
    return rounded(R.cluster_t(chains, "mean_pnl", null, "f", ["instrument"]), "instrument", "m", "t", "n", "percentile", places=5)


@register(f"""WITH {BARS}, x AS (SELECT *, {gate(8, 'c', f'avg(c) OVER {last(8)}')} AS e8, t - t % 86400 AS day, c - lag(c) OVER {W} AS step FROM bars), y AS (SELECT *, sum((h + l + c) / 3 * v) OVER d / nullif(sum(v) OVER d, 0) AS vwap, CASE WHEN count(step) OVER {last(3)} < 3 THEN 50 WHEN sum(greatest(-step, 0)) OVER {last(3)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(greatest(step, 0)) OVER {last(3)} / sum(greatest(-step, 0)) OVER {last(3)}) END AS rsi FROM x WINDOW d AS (PARTITION BY instrument, day ORDER BY bar_idx ROWS UNBOUNDED PRECEDING))
SELECT instrument, bar_idx, CASE WHEN c > vwap AND c > e8 AND rsi < 60 THEN 'buy' WHEN c < vwap AND c < e8 AND rsi > 40 THEN 'sell' ELSE 'flat' END AS bias FROM y""")
def w_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of price against session price and mean, with the short strength."""
    b = hourly(spark, sf_dir).withColumn("day", c("t") - c("t") % 86400).withColumn("vwap", windows.session_vwap("day"))
    b = windows.bounded(b, 20, lambda w: {"e8": windows.sma("c", 8, w), "step": c("c") - F.lag("c").over(w)}, lambda w: {"rsi": windows.short_rsi("step", w)})
    return b.select("instrument", "bar_idx", windows.bias("vwap", "e8", "rsi", 60, 40).alias("bias"))


@register(f"""WITH {BARS}, {_RANGED} SELECT instrument, bar_idx, round((c - lag(c, 5) OVER {W}) / nullif(atr, 0), 6) AS displacement FROM rb""")
def w_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The move over five bars in mean ranges."""
    return rounded(windows.bounded(ranged(spark, sf_dir), 5, lambda w: {"displacement": windows.displacement(5, "atr", w)}), "instrument", "bar_idx", "displacement")


@register(f"""WITH {_ZONES}, p AS (SELECT b.*, lag(c) OVER {W} AS pc FROM bars b), x AS (SELECT z.instrument, z.side, z.created_idx, bar_low, bar_high, b.bar_idx, CASE WHEN b.l > bar_high THEN b.l - bar_high ELSE bar_low - b.h END AS d FROM z JOIN p b ON b.instrument = z.instrument AND b.bar_idx > created_idx AND b.bar_idx <= coalesce(m, 1000000000) WHERE b.l > bar_high OR b.h < bar_low) SELECT instrument, side, created_idx, count(*) AS outside FROM x GROUP BY 1, 2, 3""")
def z_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each standing zone the bars wholly outside it."""
    z, b = blocks(spark, sf_dir)
    own = z.select("zone_id", *KEY, "side", "lo", "hi", (c("from_idx") + 1).alias("begin"), c("from_idx").alias("created_idx"), "to_idx")
    hit = J.in_intervals(b.select(*KEY, "bar_idx", "h", "l"), own, KEY, "bar_idx", "begin", "to_idx", 256, (c("l") > c("hi")) | (c("h") < c("lo")))
    return hit.groupBy("instrument", "side", "created_idx").agg(F.count("*").alias("outside"))

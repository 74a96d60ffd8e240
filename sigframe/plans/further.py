"""Registered queries over exits, refits, agreement, tiers, depth across timeframes, placebos and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import bars as B
from ..operators import compose as C
from ..operators import outcomes as O
from ..operators import resampling as R
from ..operators import structure as P
from ..operators import zones as Z
from ..schema import KEY, SECONDS
from ..sources import tables as S
from .relations import _TRADES, blocks, trades
from .series import _BLOCKS, _SWING, BARS, W, hourly, register, rounded

c = F.col


def breaks_of(b: DataFrame) -> DataFrame:
    return P.breaks(P.swings(b, 5, "swing"), "swing")


@register(f"""WITH {_TRADES}, x AS (SELECT t.instrument, t.side, t.bar_idx, s, b.bar_idx AS i, s * CASE WHEN s = 1 THEN b.l ELSE b.h END AS worst, greatest(s * entry, coalesce(max(s * CASE WHEN s = 1 THEN b.h ELSE b.l END) OVER (PARTITION BY t.instrument, t.side, t.bar_idx ORDER BY b.bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s * entry)) - 20 AS stop
FROM trades t JOIN bars b ON b.instrument = t.instrument AND b.bar_idx BETWEEN ei AND ei + 200) SELECT instrument, side, bar_idx, min(CASE WHEN worst <= stop THEN i END) AS exit_idx, round(arg_min(s * stop, i) FILTER (WHERE worst <= stop), 6) AS exit FROM x GROUP BY 1, 2, 3""")
def l_trailing_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop that follows the best price since the entry."""
    t, b = trades(spark, sf_dir)
    t = t.select("event_id", *KEY, "side", "bar_idx", "entry_idx", "entry").withColumn("distance", F.lit(20.0))
    return rounded(O.trailing_stop(t, b, "distance"), "instrument", "side", "bar_idx", "exit_idx", "exit")


@register(f"""WITH {_TRADES} SELECT t.instrument, t.side, t.bar_idx, min(k.bar_idx) AS opposite_idx FROM trades t LEFT JOIN brk k ON k.instrument = t.instrument AND k.side <> t.side AND k.bar_idx > ei AND k.bar_idx <= ei + 200 GROUP BY 1, 2, 3""")
def l_opposite_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first break of the other side after an entry."""
    t, b = trades(spark, sf_dir)
    return O.opposite_exit(t, breaks_of(b)).select("instrument", "side", "bar_idx", "opposite_idx")


@register(f"""WITH {_BLOCKS}, p AS (SELECT ob.*, min(b.bar_idx) AS touch_idx FROM ob JOIN bars b ON b.instrument = ob.instrument AND b.bar_idx > created_idx AND CASE WHEN ob.side = 'bullish' THEN b.l < bar_high ELSE b.h > bar_low END GROUP BY ALL)
SELECT p.instrument, p.side, created_idx, touch_idx, min(b.bar_idx) AS reclaim_idx, min(b.bar_idx) + 1 AS entry_idx FROM p JOIN bars b ON b.instrument = p.instrument AND b.bar_idx BETWEEN touch_idx AND touch_idx + 12 AND CASE WHEN p.side = 'bullish' THEN b.c > bar_high ELSE b.c < bar_low END GROUP BY 1, 2, 3, 4""")
def l_reclaim_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones touched and closed out of again, and the bar after."""
    z, b = blocks(spark, sf_dir)
    return O.reclaim_entries(z, b).select("instrument", "side", c("from_idx").alias("created_idx"), "touch_idx", "reclaim_idx", "entry_idx")


@register(f"""WITH {_SWING}, s AS (SELECT k.instrument, k.side, k.bar_idx, CASE WHEN k.side = 'bullish' THEN b.c - 0.5 * 20 ELSE b.c + 0.5 * 20 END AS lim FROM brk k JOIN bars b ON b.instrument = k.instrument AND b.bar_idx = k.bar_idx)
SELECT s.instrument, s.side, s.bar_idx, round(lim, 6) AS "limit", min(b.bar_idx) AS fill_idx FROM s LEFT JOIN bars b ON b.instrument = s.instrument AND b.bar_idx > s.bar_idx AND b.bar_idx <= s.bar_idx + 24 AND CASE WHEN s.side = 'bullish' THEN b.l < lim ELSE b.h > lim END GROUP BY 1, 2, 3, 4""")
def l_resting_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits beyond a signal's close and the bar that fills each."""
    b = hourly(spark, sf_dir)
    k = breaks_of(b).select(*KEY, "bar_idx", "side").join(b.select(*KEY, "bar_idx", "c"), [*KEY, "bar_idx"])
    k = k.withColumns({"event_id": F.xxhash64("instrument", "side", "bar_idx"), "atr": F.lit(20.0)})
    return rounded(O.resting_limits(k, b, 0.5), "instrument", "side", "bar_idx", "limit", "fill_idx")


@register(f"""WITH {_TRADES}, m AS (SELECT instrument, min(xi) AS lo, max(xi) AS hi FROM trades GROUP BY 1), steps AS (SELECT instrument, unnest(generate_series(lo + 100, hi, 50)) AS refit FROM m WHERE hi >= lo + 100)
SELECT w.instrument, refit, count(t.xi) AS n, round(avg(pnl), 4) AS edge FROM steps w LEFT JOIN trades t ON t.instrument = w.instrument AND t.xi < refit GROUP BY 1, 2""")
def a_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each refit the mean of what had ended before it."""
    t, _ = trades(spark, sf_dir)
    return rounded(A.walk_forward(t, ["instrument"], "exit_idx", "pnl_pct", 100, 50), places=4)


@register(f"""WITH {_TRADES}, a AS (SELECT instrument, avg(pnl) AS m FROM trades GROUP BY 1), k AS (SELECT instrument, side, count(*) AS n, avg(pnl) AS m FROM trades GROUP BY 1, 2) SELECT k.instrument, side, n, round(CASE WHEN n >= 30 THEN k.m ELSE a.m END, 4) AS edge FROM k JOIN a USING (instrument)""")
def a_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean results by bucket, or the strategy's where a bucket is small."""
    t, _ = trades(spark, sf_dir)
    return rounded(A.edges(t, "instrument", "side", "pnl_pct"), places=4)


@register(f"""WITH {BARS}, s AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY c) - 1 AS kc, row_number() OVER (PARTITION BY instrument ORDER BY v) - 1 AS kv, count(*) OVER (PARTITION BY instrument) AS n FROM bars),
cuts AS (SELECT instrument, max(CASE WHEN kc = floor(n * 0.25) THEN c END) AS c1, max(CASE WHEN kc = floor(n * 0.5) THEN c END) AS c2, max(CASE WHEN kc = floor(n * 0.75) THEN c END) AS c3, max(CASE WHEN kv = floor(n * 0.25) THEN v END) AS v1, max(CASE WHEN kv = floor(n * 0.5) THEN v END) AS v2, max(CASE WHEN kv = floor(n * 0.75) THEN v END) AS v3 FROM s GROUP BY 1),
d AS (SELECT instrument, c, v, (c > c1)::INT + (c > c2)::INT + (c > c3)::INT AS i, (v > v1)::INT + (v > v2)::INT + (v > v3)::INT AS j FROM bars JOIN cuts USING (instrument)), r AS (SELECT instrument, corr(c, v) AS r, count(*) AS n FROM d GROUP BY 1),
k AS (SELECT instrument, i, j, count(*) AS n FROM d GROUP BY 1, 2, 3), p AS (SELECT *, sum(n) OVER (PARTITION BY instrument) AS t, sum(n) OVER (PARTITION BY instrument, i) AS a, sum(n) OVER (PARTITION BY instrument, j) AS b FROM k),
q AS (SELECT instrument, sum(n / t * log2(n * t / (a * b))) AS mi, -sum(n / t * log2(a / t)) AS h_x, -sum(n / t * log2(b / t)) AS h_y FROM p GROUP BY 1)
SELECT instrument, 'c' AS a, 'v' AS b, round(r, 6) AS r, n, round(mi, 6) AS mi, round(h_x, 6) AS h_x, round(h_y, 6) AS h_y, round(mi / nullif(least(h_x, h_y), 0), 6) AS nmi FROM q JOIN r USING (instrument)""")
def a_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far columns agree, by correlation and by information over equal-count bins."""
    return rounded(A.agreement(hourly(spark, sf_dir), ["c", "v"], ["instrument"]))


@register(f"""WITH {_BLOCKS} SELECT ob.instrument, ob.side, ob.created_idx, arg_min(k.type, CASE k.type WHEN 'CHOCH' THEN 0 ELSE 1 END) AS tier FROM ob LEFT JOIN brk k ON k.instrument = ob.instrument AND k.bar_idx <= created_idx AND k.bar_idx >= created_idx - 20 AND abs(k.level / ob.bar_high - 1) <= 0.1 WHERE bar_high > 0 GROUP BY 1, 2, 3""")
def c_best_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the best kind of break shortly before and near them."""
    z, b = blocks(spark, sf_dir)
    own = z.where("hi > 0").select(c("zone_id").alias("block_id"), *KEY, "side", c("from_idx").alias("bar_idx"), c("hi").alias("price"))
    tiers = breaks_of(b).select(*KEY, "bar_idx", c("level").alias("price"), "type")
    return C.best_before(own, tiers, 20, 0.1, {"CHOCH": 0, "BOS": 1}, KEY).select("instrument", "side", c("bar_idx").alias("created_idx"), "tier")


_SIDED = f"""{BARS}, r(timeframe, s, off) AS (VALUES ('4h', 14400, 0), ('1d', 86400, 0), ('1w', 604800, 345600)),
x AS (SELECT b.instrument, r.timeframe, r.s, b.t - (b.t - off) % s AS t, first(o ORDER BY b.t) AS o, last(c ORDER BY b.t) AS c FROM bars b, r GROUP BY 1, 2, 3, 4), e AS (SELECT *, t + s AS known_at, CASE WHEN c > o THEN 'bullish' ELSE 'bearish' END AS side FROM x WHERE c <> o AND c > 0)"""


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of three timeframes as events with a side and a price."""
    b = B.rollup(B.from_ticks(S.ticks(spark, sf_dir)), ["4h", "1d", "1w"]).where("c <> o AND c > 0")
    seconds = F.create_map(*[x for n, s in SECONDS.items() for x in (F.lit(n), F.lit(s))])
    return S.kept(b.select(F.xxhash64(*KEY, "t").alias("event_id"), *KEY, "t", (c("t") + seconds[c("timeframe")]).alias("known_at"), c("c").alias("price"), F.when(c("c") > c("o"), "bullish").otherwise("bearish").alias("side")))


@register(f"""WITH {_SIDED} SELECT a.instrument, a.t, CAST(count(DISTINCT b.timeframe) AS BIGINT) AS depth FROM e a LEFT JOIN e b ON b.instrument = a.instrument AND b.side = a.side AND b.s > a.s AND b.t <= a.t AND b.t >= a.t - 10 * b.s AND abs(b.c / a.c - 1) <= 0.02 WHERE a.timeframe = '4h' GROUP BY 1, 2""")
def c_nested_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many slower timeframes an event of its side stands near its price."""
    e = sided(spark, sf_dir)
    return C.nested_depth(e.where("timeframe = '4h'"), e, share=0.02).select("instrument", "t", "depth")


@register(f"""WITH {_SIDED}, k AS (SELECT a.instrument, a.t, b.timeframe, count(*) AS n FROM e a JOIN e b ON b.instrument = a.instrument AND b.side = a.side AND b.timeframe <> '4h' AND abs(b.known_at - a.known_at) <= b.s WHERE a.timeframe = '4h' GROUP BY 1, 2, 3)
SELECT a.instrument, a.t, CAST(count(k.timeframe) AS INT) AS confirmations FROM e a LEFT JOIN k ON k.instrument = a.instrument AND k.t = a.t WHERE a.timeframe = '4h' GROUP BY 1, 2""")
def c_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many rungs an event of its side lies within a bar of it."""
    e = sided(spark, sf_dir)
    return C.confirmations(e.where("timeframe = '4h'"), e, ["1d", "1w"], 1).select("instrument", "t", "confirmations")


@register(f"""WITH {BARS}, m AS (SELECT instrument, 'close' AS metric, arg_max(c, t) AS value FROM bars GROUP BY 1 UNION ALL SELECT instrument, 'volume', arg_max(v, t) FROM bars GROUP BY 1),
k(rule, metric, low, high, call, rank) AS (VALUES ('cheap', 'close', -1e9, 40.0, 'buy', 1), ('dear', 'close', 60.0, 1e9, 'sell', 2), ('any', 'close', 50.0, 1e9, 'watch', 3), ('busy', 'volume', 100.0, 1e9, 'watch', 1)),
p AS (SELECT m.*, k.rule, k.call, row_number() OVER (PARTITION BY m.instrument, m.metric ORDER BY k.rank NULLS LAST) AS i FROM m LEFT JOIN k ON k.metric = m.metric AND value >= low AND value < high) SELECT instrument, metric, round(value, 6) AS value, rule, coalesce(call, 'neutral') AS call FROM p WHERE i = 1""")
def c_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest values with the first rule that holds."""
    last = hourly(spark, sf_dir).groupBy("instrument").agg(F.max_by("c", "t").alias("close"), F.max_by("v", "t").alias("volume"))
    rules = spark.createDataFrame([("cheap", "close", -1e9, 40.0, "buy", 1), ("dear", "close", 60.0, 1e9, "sell", 2), ("any", "close", 50.0, 1e9, "watch", 3), ("busy", "volume", 100.0, 1e9, "watch", 1)], "rule string, metric string, low double, high double, call string, rank int")
    return rounded(C.watchlist(last.unpivot("instrument", ["close", "volume"], "metric", "value"), rules))


_DRAW = """a AS (SELECT k, (42 + k * 1831565813) % 4294967296 AS a FROM ks), b AS (SELECT k, CAST((xor(a, a // 32768)::HUGEINT * (a | 1)::HUGEINT) % 4294967296 AS BIGINT) AS t FROM a), d AS (SELECT k, xor(t, (t + CAST((xor(t, t // 128)::HUGEINT * (t | 61)::HUGEINT) % 4294967296 AS BIGINT)) % 4294967296) AS t FROM b), u AS (SELECT k, xor(t, t // 16384) / 4294967296.0::DOUBLE AS u FROM d)"""


@register(f"""WITH l AS (SELECT event_id AS n, value, copy FROM events, (SELECT unnest(generate_series(0, 2)) AS copy)), ks AS (SELECT (n * 3 + copy) * 2 + 1 AS k FROM l UNION ALL SELECT (n * 3 + copy) * 2 + 2 FROM l), {_DRAW}
SELECT n, CAST(copy AS INT) AS copy, round(value + CASE WHEN p.u < 0.5 THEN -1 ELSE 1 END * (1 + 2 * q.u) * 2.0 + 1e-9, 5) AS level FROM l JOIN u p ON p.k = (n * 3 + copy) * 2 + 1 JOIN u q ON q.k = (n * 3 + copy) * 2 + 2""")
def q_displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placebo levels beside the real ones."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(c("event_id").alias("n"), c("value").alias("level"), F.lit(2.0).alias("atr"))
    return R.displaced(e, "atr").select("n", "copy", F.round(c("level") + 1e-9, 5).alias("level"))


@register(f"""WITH {BARS}, f AS (SELECT *, lead(c, 5) OVER {W} - c AS fwd FROM bars), m AS (SELECT instrument, fwd, row_number() OVER (PARTITION BY instrument ORDER BY bar_idx) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM f WHERE c > o AND fwd IS NOT NULL),
g AS (SELECT unnest(generate_series(0, 49)) AS rep), ks AS (SELECT rep, rep * 40 + j + 1 AS k FROM g, (SELECT unnest(generate_series(0, 39)) AS j)), {_DRAW}
SELECT m.instrument, rep, round(avg(fwd) + 1e-9, 5) AS mean FROM ks JOIN u USING (k) JOIN m ON m.i = CAST(floor(u.u * m.n) AS BIGINT) GROUP BY 1, 2""")
def q_matched_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean outcomes of random bars of a pool."""
    got = R.matched_draws(O.forward_return(hourly(spark, sf_dir), 5), c("c") > c("o"), 40, 50, ["instrument"], "fwd")
    return got.select("instrument", "rep", F.round(c("mean") + 1e-9, 5).alias("mean"))


@register(f"""WITH {_BLOCKS}, z AS (SELECT ob.*, (SELECT min(b.bar_idx) FROM bars b WHERE b.instrument = ob.instrument AND b.bar_idx >= created_idx AND CASE WHEN ob.side = 'bullish' THEN b.l < bar_low ELSE b.h > bar_high END) AS m FROM ob WHERE bar_low > 0),
p AS (SELECT b.instrument, b.bar_idx, created_idx, CASE WHEN m <= b.bar_idx THEN CASE z.side WHEN 'bullish' THEN 'bearish' ELSE 'bullish' END ELSE z.side END AS polarity, CASE WHEN bar_low > b.c THEN bar_low - b.c WHEN bar_high < b.c THEN bar_high - b.c ELSE 0 END / b.c AS distance FROM bars b JOIN z ON z.instrument = b.instrument AND created_idx <= b.bar_idx WHERE b.c > 0)
SELECT instrument, bar_idx, created_idx, polarity, round(distance, 6) AS distance FROM p WHERE abs(distance) <= 0.01""")
def z_levels_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels known at an instant and near its price, ended ones with their side turned."""
    z, b = blocks(spark, sf_dir)
    levels = z.where("lo > 0").select(*KEY, "lo", "hi", "side", c("from_idx").alias("known_at"), c("to_idx").alias("ended_at"))
    at = b.where("c > 0").select(*KEY, c("bar_idx").alias("at"), c("c").alias("price"))
    return rounded(Z.levels_near(levels, at, 0.01, KEY).select("instrument", c("at").alias("bar_idx"), c("known_at").alias("created_idx"), "polarity", "distance"))


@register(f"""WITH {_BLOCKS} SELECT DISTINCT instrument, round(bar_low, 2) AS lo, round(bar_high, 2) AS hi FROM ob""")
def z_level_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and boxes, each once."""
    z, _ = blocks(spark, sf_dir)
    return Z.level_set(z, ["instrument"])


@register("""SELECT event_type AS "table", event_id // 4 AS "row", string_agg(CAST(event_id AS VARCHAR), ' | ' ORDER BY event_id % 4) AS line FROM events GROUP BY 1, 2""")
def z_cells_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells as lines of text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(c("event_type").alias("table"), F.floor(c("event_id") / 4).alias("row"), (c("event_id") % 4).alias("col"), c("event_id").cast("string").alias("text"))
    return Z.cells_to_lines(e, "table")

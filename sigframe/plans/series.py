"""Registered queries over bars, indicators and events, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import recursive, rows, windows
from ..operators import bars as B
from ..operators import events as E
from ..operators import structure as P
from ..schema import KEY
from ..sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, kept: most queries read them several times."""
    return S.kept(B.indexed(B.from_ticks(S.ticks(spark, sf_dir), "1h")))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c(x), places).alias(x) if df.schema[x].dataType.typeName() == "double" else c(x) for x in (columns or df.columns)])


TICKS = "ticks AS (SELECT event_type AS instrument, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"
BARS = TICKS + """, b0 AS (SELECT instrument, '1h' AS timeframe, ts - ts % 3600 AS t, first(price ORDER BY ts, seq) AS o, max(price) AS h, min(price) AS l, last(price ORDER BY ts, seq) AS c, sum(volume) AS v FROM ticks GROUP BY 1, 2, 3),
bars AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t) - 1 AS bar_idx FROM b0)"""
W = "(PARTITION BY instrument ORDER BY bar_idx)"


def last(n: int, m: int = 0) -> str:
    return f"(PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gate(n: int, x: str, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {last(n)} = {n} THEN {value} END"


@register(f"""WITH {BARS}, r(timeframe, s, off) AS (VALUES ('4h', 14400, 0), ('1d', 86400, 0), ('1w', 604800, 345600)),
x AS (SELECT b.instrument, r.timeframe, b.t - (b.t - off) % s AS t, first(o ORDER BY b.t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY b.t) AS c, sum(v) AS v FROM bars b, r GROUP BY 1, 2, 3)
SELECT instrument, timeframe, t, row_number() OVER (PARTITION BY instrument, timeframe ORDER BY t) - 1 AS bar_idx, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 6) AS v FROM x""")
def b_rollup_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to hours, hours to coarser bars with Monday weeks, dense numbers."""
    return rounded(B.indexed(B.rollup(B.from_ticks(S.ticks(spark, sf_dir)), ["4h", "1d", "1w"])), "instrument", "timeframe", "t", "bar_idx", *"ohlcv")


@register(f"""WITH {BARS}, p(phase) AS (VALUES (0), (3600), (7200), (10800))
SELECT instrument, phase, t - (t - phase) % 14400 AS bt, round(first(o ORDER BY t), 6) AS o, round(max(h), 6) AS h, round(min(l), 6) AS l, round(last(c ORDER BY t), 6) AS c, count(*) AS n_bars FROM bars, p GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def b_phased_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets at every phase, complete ones only."""
    return rounded(B.phased(hourly(spark, sf_dir), 14400, [0, 3600, 7200, 10800]))


@register(f"""WITH {BARS}, x AS (SELECT *, max(bar_idx) OVER (PARTITION BY instrument) AS e FROM bars), y AS (SELECT * FROM x WHERE bar_idx > e - 100)
SELECT instrument, timeframe, count(*) AS n, round(first(o ORDER BY bar_idx), 6) AS open, round(last(c ORDER BY bar_idx), 6) AS close, round(max(h), 6) AS high, round(min(l), 6) AS low, round(avg(v), 6) AS avg_volume,
round(max(h) - min(l), 6) AS range, round(last(c ORDER BY bar_idx) - first(o ORDER BY bar_idx), 6) AS change, round((last(c ORDER BY bar_idx) - first(o ORDER BY bar_idx)) * 100 / first(o ORDER BY bar_idx), 6) AS change_pct FROM y GROUP BY 1, 2""")
def b_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 100 bars of each series."""
    return rounded(B.summary(hourly(spark, sf_dir)).drop("last_closes"))


@register(f"""WITH {BARS}, x AS (SELECT instrument, timeframe, t, count(*) AS n FROM bars GROUP BY 1, 2, 3), y AS (SELECT *, lead(t) OVER (PARTITION BY instrument ORDER BY t) - t AS step FROM x)
SELECT instrument, timeframe, count(*) AS n_times, CAST(sum(n - 1) AS BIGINT) AS repeated, CAST(count(CASE WHEN step > 3600 THEN 1 END) AS BIGINT) AS gaps, CAST(coalesce(sum(CASE WHEN step > 3600 THEN step / 3600 - 1 END), 0) AS BIGINT) AS missing FROM y GROUP BY 1, 2""")
def b_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and repeats."""
    return B.audit(hourly(spark, sf_dir), 3600)


@register(f"""WITH {BARS}, d AS (SELECT instrument, timeframe, t - t % 86400 AS period, first(o ORDER BY t) AS open, last(c ORDER BY t) AS close FROM bars GROUP BY 1, 2, 3)
SELECT instrument, timeframe, period, round(open, 6) AS open, round(close, 6) AS close, round(open - lag(close) OVER (PARTITION BY instrument ORDER BY period), 6) AS gap FROM d""")
def b_opening_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each day's close to the next day's open."""
    return rounded(B.opening_gaps(hourly(spark, sf_dir)))


@register(f"""WITH RECURSIVE {BARS}, x AS (SELECT *, (o + h + l + c) / 4 AS hc FROM bars),
r AS (SELECT instrument, bar_idx, (o + c) / 2 AS ho, hc FROM x WHERE bar_idx = 0 UNION ALL SELECT x.instrument, x.bar_idx, r.ho * 0.5 + r.hc * 0.5, x.hc FROM r JOIN x ON x.instrument = r.instrument AND x.bar_idx = r.bar_idx + 1)
SELECT r.instrument, r.bar_idx, round(r.ho + 1e-9, 6) AS ha_o, round(r.hc + 1e-9, 6) AS ha_c, round(greatest(h, r.ho, r.hc) + 1e-9, 6) AS ha_h, round(least(l, r.ho, r.hc) + 1e-9, 6) AS ha_l FROM r JOIN bars USING (instrument, bar_idx)""")
def b_heikin_ashi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed candles by the affine scan."""
    b = recursive.heikin_ashi(hourly(spark, sf_dir))
    return rounded(b.withColumns({k: c(k) + 1e-9 for k in ("ha_o", "ha_c", "ha_h", "ha_l")}), "instrument", "bar_idx", "ha_o", "ha_c", "ha_h", "ha_l")


@register(f"""WITH {BARS}, d AS (SELECT instrument, t - t % 86400 AS bt, max(h) AS ph, first(t ORDER BY h DESC, t) AS pht, min(l) AS pl, first(t ORDER BY l, t) AS plt FROM bars GROUP BY 1, 2),
p AS (SELECT instrument, bt, lag(ph) OVER w AS ph, lag(pht) OVER w AS pht, lag(pl) OVER w AS pl, lag(plt) OVER w AS plt FROM d WINDOW w AS (PARTITION BY instrument ORDER BY bt))
SELECT b.instrument, b.t, round(ph, 6) AS prev_high, pht AS prev_high_t, round(pl, 6) AS prev_low, plt AS prev_low_t FROM bars b JOIN p ON p.instrument = b.instrument AND p.bt = b.t - b.t % 86400""")
def b_previous_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the high and low of the day before."""
    return rounded(B.previous_levels(hourly(spark, sf_dir), "1d"), "instrument", "t", "prev_high", "prev_high_t", "prev_low", "prev_low_t")


@register(f"""WITH {TICKS}, x AS (SELECT *, ts - ts % 3600 AS hr, lag(ts) OVER (PARTITION BY instrument ORDER BY seq) AS b FROM ticks), y AS (SELECT instrument, count(*) AS n, CAST(count(CASE WHEN b > ts THEN 1 END) AS BIGINT) AS out_of_order FROM x GROUP BY 1),
k AS (SELECT instrument, hr, first(price ORDER BY seq DESC) AS price FROM x GROUP BY 1, 2)
SELECT y.instrument, y.n, y.out_of_order, count(*) AS kept, round(sum(k.price), 4) AS total FROM y JOIN k USING (instrument) GROUP BY 1, 2, 3""")
def s_dedupe_and_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick scan, rows out of order, the last row of each time."""
    t = S.ticks(spark, sf_dir)
    kept = S.latest(t.withColumn("hr", c("ts") - c("ts") % 3600), ["instrument", "hr"], "seq").groupBy("instrument").agg(F.count("*").alias("kept"), F.round(F.sum("price"), 4).alias("total"))
    return S.out_of_order(t, ["instrument"], "ts", "seq").join(kept, "instrument")


@register(f"""WITH {BARS}, m AS (SELECT min(t) + (max(t) - min(t)) // 2 AS cut FROM bars), a AS (SELECT instrument, last(c ORDER BY t) AS lc, max(t) AS lt, min(t) AS ft, count(*) AS n FROM bars, m WHERE t < cut GROUP BY 1), b AS (SELECT instrument, first(o ORDER BY t) AS fo, min(t) AS ft, max(t) AS lt, count(*) AS n FROM bars, m WHERE t >= cut GROUP BY 1)
SELECT instrument, round(a.lc, 6) AS last_close, round(b.fo, 6) AS first_open, round(b.fo - a.lc, 6) AS gap, round(a.n * 100.0 / ((a.lt - a.ft) / 3600 + 1), 6) AS old_coverage, round(b.n * 100.0 / ((b.lt - b.ft) / 3600 + 1), 6) AS new_coverage, a.n + b.n AS spliced FROM a JOIN b USING (instrument)""")
def s_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sources about a cut, and the seam between them."""
    b = hourly(spark, sf_dir)
    lo, hi = b.agg(F.min("t"), F.max("t")).first()
    cut = lo + (hi - lo) // 2
    n = S.splice(b, b, cut, KEY).groupBy("instrument").agg(F.count("*").alias("spliced"))
    return rounded(S.seam(b, b, cut, "instrument", 3600).join(n, "instrument"), "instrument", "last_close", "first_open", "gap", "old_coverage", "new_coverage", "spliced")


@register(f"""WITH {BARS}, m AS (SELECT instrument, max(t) AS e FROM bars WHERE bar_idx < (SELECT max(bar_idx) FROM bars z WHERE z.instrument = bars.instrument) // 2 GROUP BY 1) SELECT b.instrument, count(*) AS candle_count, min(t) AS range_start, max(t) AS range_end FROM bars b LEFT JOIN m USING (instrument) WHERE e IS NULL OR t > e GROUP BY 1""")
def s_gap_fill_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after what is stored, each once, and a row for the run."""
    b = hourly(spark, sf_dir)
    half = b.groupBy("instrument").agg(F.floor(F.max("bar_idx") / 2).alias("half"))
    stored = b.join(half, "instrument").where("bar_idx < half").select(b.columns)
    fresh = S.gap_fill(stored, b.unionByName(b), ["instrument"])
    return S.runs(S.insert_new(stored, fresh, ["instrument", "t"]), ["instrument"])


@register(f"""WITH {BARS} SELECT coalesce(CASE WHEN bar_idx % 2 = 0 THEN NULL ELSE instrument END, 'default') AS instrument, count(*) AS n, CAST(count(CASE WHEN bar_idx % 2 = 1 THEN v END) AS BIGINT) AS with_volume FROM bars GROUP BY 1""")
def s_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows without later columns."""
    b = hourly(spark, sf_dir)
    old = b.where("bar_idx % 2 = 0").drop("instrument", "v")
    return S.evolve(old, b.where("bar_idx % 2 = 1"), "default").groupBy("instrument").agg(F.count("*").alias("n"), F.count("v").alias("with_volume"))


@register("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, year(ts) AS y, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def x_payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON payload, the year of a time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.from_json("props", "k long")["k"]
    return e.groupBy("event_type", k.alias("k"), F.year("ts").cast("long").alias("y")).agg(F.count("*").alias("n"))


_RANGE = "greatest(h - l, abs(h - pc), abs(l - pc))"


@register(f"""WITH {BARS}, x AS (SELECT *, lag(c) OVER {W} AS pc, lag(c, 3) OVER {W} AS c3 FROM bars), y AS (SELECT *, CASE WHEN pc IS NULL THEN h - l ELSE {_RANGE} END AS tr, CASE WHEN c > 0 THEN pow(10.0, floor(log10(c) + 1e-12) - 1) END AS st FROM x)
SELECT instrument, bar_idx, round(tr, 6) AS tr, round((h + l + c) / 3, 6) AS hlc3, round((h + l) / 2, 6) AS hl2, round(abs(c - o), 6) AS body, round(greatest(o, c), 6) AS body_top, round(least(o, c), 6) AS body_bottom, round(h - greatest(o, c), 6) AS upper_wick, round(least(o, c) - l, 6) AS lower_wick,
round(CASE WHEN h - l >= 2 * tr THEN l ELSE h END, 6) AS parsed_high, round(CASE WHEN h - l >= 2 * tr THEN h ELSE l END, 6) AS parsed_low, round((c / 1000 + 0.25) / (c / 1000 * 0.25 + 1) * 60 + 50, 6) AS mobius,
round(CASE WHEN h = l THEN 0 ELSE ((c - l) - (h - c)) / (h - l) * v END, 6) AS mfv, round(CASE WHEN h = l THEN 0 ELSE (c - o) / (h - l) * 150 END, 6) AS body_ratio, round(c - c3, 6) AS momentum,
CASE WHEN c > (h + l) / 2 + 1 THEN 'above' WHEN c < (h + l) / 2 - 1 THEN 'below' ELSE 'inside' END AS position, round(st, 6) AS round_step, round(ceil(c / st + 1e-9) * st, 6) AS round_above, round(ceil(c / st + 1e-9) * st - st, 6) AS round_below,
CASE WHEN h = l THEN NULL WHEN (c - l) / (h - l) >= 0.95 THEN 'premium' WHEN (c - l) / (h - l) <= 0.05 THEN 'discount' WHEN abs((c - l) / (h - l) - 0.5) <= 0.025 THEN 'equilibrium' ELSE 'between' END AS zone, CASE WHEN c > 0 THEN round(ln(c), 6) END AS log_c FROM y""")
def x_row_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions of a bar and the one before."""
    w = windows.series()
    b = hourly(spark, sf_dir).withColumn("tr", rows.true_range(w))
    levels = rows.round_levels(c("c"))
    out = b.withColumns({
        **rows.shape(), "parsed_high": rows.parsed_high(c("tr")), "parsed_low": rows.parsed_low(c("tr")), "mobius": rows.mobius(c("c") / 1000, 0.25), "mfv": rows.money_flow_volume(), "body_ratio": rows.body_ratio(),
        "momentum": rows.momentum(3, w), "position": rows.position(c("c"), (c("h") + c("l")) / 2 - 1, (c("h") + c("l")) / 2 + 1), "round_step": levels["round_step"], "round_above": levels["round_above"], "round_below": levels["round_below"],
        "zone": rows.range_zone(c("c"), c("l"), c("h")), "log_c": F.when(c("c") > 0, F.ln(F.when(c("c") > 0, c("c")).otherwise(1.0))),
    })
    return rounded(out.drop("timeframe", "t", *"ohlcv"))


@register("""WITH x AS (SELECT event_id, 4278190080 + (event_id * 7919) % 16777216 AS argb, (event_id % 600 - 300) / 100.0 AS z, CASE WHEN event_id % 3 = 0 THEN 'EQH' WHEN event_id % 3 = 1 THEN 'EQL' END AS kind FROM events), y AS (SELECT *, 1 / (1 + abs(z) / sqrt(2.0) * 0.3275911) AS k FROM x)
SELECT event_id, CASE kind WHEN 'EQH' THEN 'bearish' WHEN 'EQL' THEN 'bullish' END AS kind_side, CASE WHEN (argb // 256) % 256 > (argb // 65536) % 256 THEN 'bullish' WHEN (argb // 65536) % 256 > (argb // 256) % 256 THEN 'bearish' END AS colour_side,
round(CASE WHEN z >= 0 THEN (1 + e) / 2 ELSE (1 - e) / 2 END, 6) AS cdf FROM (SELECT *, 1 - (((((1.061405429 * k - 1.453152027) * k) + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-z * z / 2) AS e FROM y)""")
def x_sides_and_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides from kinds and colours, the normal distribution."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.lit(4278190080) + (c("event_id") * 7919) % 16777216).alias("argb"), ((c("event_id") % 600 - 300) / 100.0).alias("z"), F.when(c("event_id") % 3 == 0, "EQH").when(c("event_id") % 3 == 1, "EQL").alias("kind"))
    return e.select("event_id", rows.side_of_kind(c("kind")).alias("kind_side"), rows.side_of_colour(c("argb")).alias("colour_side"), F.round(rows.normal_cdf(c("z").cast("double")), 6).alias("cdf"))


_STEP = f"c - lag(c) OVER {W}"


@register(f"""WITH {BARS}, x AS (SELECT *, {_STEP} AS step, (h + l + c) / 3 AS tp, CASE WHEN h = l THEN 0 ELSE ((c - l) - (h - c)) / (h - l) * v END AS mfv, CASE WHEN h = l THEN 0 ELSE (c - o) / (h - l) * 150 END AS br FROM bars),
y AS (SELECT *, {gate(14, 'c', f'CASE WHEN max(h) OVER {last(14)} = min(l) OVER {last(14)} THEN 0 ELSE (c - min(l) OVER {last(14)}) / (max(h) OVER {last(14)} - min(l) OVER {last(14)}) * 100 END')} AS k,
{gate(10, 'tp', f'avg(tp) OVER {last(10)}')} AS m10, array_agg(tp) OVER {last(10)} AS tps FROM x)
SELECT instrument, bar_idx, round({gate(20, 'c', f'avg(c) OVER {last(20)}')}, 5) AS sma20, round({gate(20, 'c', f'avg(c) OVER {last(20)} + 2 * stddev_pop(c) OVER {last(20)}')}, 5) AS bb_upper, round({gate(20, 'c', f'avg(c) OVER {last(20)} - 2 * stddev_pop(c) OVER {last(20)}')}, 5) AS bb_lower,
round({gate(10, 'h', f'max(h) OVER {last(10)}')}, 5) AS hi10, round({gate(10, 'l', f'min(l) OVER {last(10)}')}, 5) AS lo10, round({gate(3, 'k', f'avg(k) OVER {last(3)}')}, 5) AS stoch,
round(CASE WHEN m10 IS NULL THEN NULL WHEN list_sum(list_transform(tps, lambda z: abs(z - m10))) = 0 THEN 0 ELSE (tp - m10) / (list_sum(list_transform(tps, lambda z: abs(z - m10))) / 10 * 0.015) END, 5) AS cci,
round({gate(12, 'c', f'sum(c * v) OVER {last(12)} / nullif(sum(v) OVER {last(12)}, 0)')}, 5) AS vwma12, round({gate(21, 'c', f'sum(mfv) OVER {last(21)} / nullif(sum(v) OVER {last(21)}, 0)')}, 5) AS cmf,
round({gate(14, 'step', f'CASE WHEN sum(CASE WHEN step < 0 THEN c * v ELSE 0 END) OVER {last(14)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(CASE WHEN step > 0 THEN c * v ELSE 0 END) OVER {last(14)} / sum(CASE WHEN step < 0 THEN c * v ELSE 0 END) OVER {last(14)}) END')}, 5) AS mfi,
round({gate(60, 'c', f'avg(br) OVER {last(60)} - 2.5')}, 5) AS body_flow, round({gate(21, 'c', f'regr_slope(c, bar_idx) OVER {last(21)} * bar_idx + regr_intercept(c, bar_idx) OVER {last(21)}')}, 4) AS linreg,
round(CASE WHEN count(step) OVER {last(3)} < 3 THEN 50 WHEN sum(greatest(-step, 0)) OVER {last(3)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(greatest(step, 0)) OVER {last(3)} / sum(greatest(-step, 0)) OVER {last(3)}) END, 5) AS rsi3,
bar_idx - max(CASE WHEN step > 0 THEN bar_idx END) OVER (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS since_up FROM y""")
def w_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators over bounded windows, by blocks with a halo."""
    b = windows.bounded(
        hourly(spark, sf_dir), 80,
        lambda w: {"step": c("c") - F.lag("c").over(w), "tp": (c("h") + c("l") + c("c")) / 3, "k": windows.stochastic(w)},
        lambda w: {
            "sma20": windows.sma("c", 20, w), **windows.bollinger("c", w), "hi10": windows.highest("h", 10, w), "lo10": windows.lowest("l", 10, w), "stoch": windows.sma("k", 3, w), "cci": windows.cci("tp", w), "vwma12": windows.vwma(12, w),
            "cmf": windows.chaikin(w), "mfi": windows.money_flow("step", w), "body_flow": windows.body_flow(w, shift=2.5), "linreg": F.round(windows.regression_end("c", 21, w), 4), "rsi3": windows.short_rsi("step", w), "since_up": windows.bars_since(c("step") > 0, 5, w),
        },
        block=256,
    )
    return rounded(b, "instrument", "bar_idx", "sma20", "bb_upper", "bb_lower", "hi10", "lo10", "stoch", "cci", "vwma12", "cmf", "mfi", "body_flow", "linreg", "rsi3", "since_up", places=5)


@register(f"""WITH {BARS}, x AS (SELECT *, t - t % 86400 AS day FROM bars), q AS (SELECT instrument, c, cume_dist() OVER (PARTITION BY instrument ORDER BY c) AS cd FROM bars),
s AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY c) - 1 AS k, count(*) OVER (PARTITION BY instrument) AS n FROM bars), cuts AS (SELECT instrument, max(CASE WHEN k = floor(n * 0.25) THEN c END) AS q1, max(CASE WHEN k = floor(n * 0.5) THEN c END) AS q2, max(CASE WHEN k = floor(n * 0.75) THEN c END) AS q3 FROM s GROUP BY 1)
SELECT x.instrument, x.bar_idx, round(sum((h + l + c) / 3 * v) OVER d / nullif(sum(v) OVER d, 0), 5) AS vwap, round((SELECT count(*) FROM bars z WHERE z.instrument = x.instrument AND z.c < x.c) * 1.0 / count(*) OVER (PARTITION BY x.instrument), 6) AS c_rank,
CAST((c > q1)::INT + (c > q2)::INT + (c > q3)::INT AS INT) AS c_bin, round(abs((c - lag(c, 3) OVER w) / 3) + abs((lead(c, 3) OVER w - c) / 3), 5) AS tip, round(max(h) OVER a, 5) AS max_around_h, round(min(h) OVER a, 5) AS min_around_h,
round((c - max(c) OVER f) / nullif(max(c) OVER f - min(c) OVER f, 0) * 60 + 80, 5) AS osc FROM x JOIN cuts USING (instrument)
WINDOW d AS (PARTITION BY x.instrument, day ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY x.instrument ORDER BY bar_idx), a AS (PARTITION BY x.instrument ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), f AS (PARTITION BY x.instrument ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""".replace("(c - max(c) OVER f) / nullif", "CASE WHEN bar_idx >= 4 THEN (c - max(c) OVER f) / nullif").replace("* 60 + 80, 5) AS osc", "* 60 + 80 END, 5) AS osc"))
def w_ranks_and_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session VWAP, percentile ranks, quantile bins, tips, neighbourhood extremes, range oscillator."""
    b = hourly(spark, sf_dir).withColumn("day", c("t") - c("t") % 86400)
    b = windows.binned(windows.percentile_rank(b, "c"), "c", 4).withColumn("vwap", windows.session_vwap("day"))
    b = windows.bounded(b, 10, lambda w: {"osc": windows.range_oscillator("c", 5, w)}).withColumns({"tip": windows.tip("c", windows.series()), **windows.around("h", windows.series())})
    return rounded(b.withColumn("c_rank", F.round("c_rank", 6)), "instrument", "bar_idx", "vwap", "c_rank", "c_bin", "tip", "max_around_h", "min_around_h", "osc", places=5).drop("c_rank").join(b.select("instrument", "bar_idx", F.round("c_rank", 6).alias("c_rank")), ["instrument", "bar_idx"])


@register(f"""WITH RECURSIVE {BARS}, x AS (SELECT instrument, bar_idx, o, h, l, c, v, (h + l + c) / 3 AS ap, {_STEP} AS step, CASE WHEN lag(c) OVER {W} IS NULL THEN h - l ELSE greatest(h - l, abs(h - lag(c) OVER {W}), abs(l - lag(c) OVER {W})) END AS tr FROM bars),
s AS (SELECT *, avg(tr) OVER {last(10)} AS tr10, avg(greatest(step, 0)) OVER {last(14)} AS g14, avg(greatest(-step, 0)) OVER {last(14)} AS l14, avg(c) OVER {last(12)} AS c12 FROM x),
r AS (SELECT instrument, bar_idx, c AS e11, CAST(NULL AS DOUBLE) AS e12, CAST(NULL AS DOUBLE) AS atr, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al, ap AS esa, 0.0::DOUBLE AS d FROM s WHERE bar_idx = 0
UNION ALL SELECT s.instrument, s.bar_idx, r.e11 + (s.c - r.e11) * 2 / 12, CASE WHEN s.bar_idx < 11 THEN NULL WHEN s.bar_idx = 11 THEN s.c12 ELSE r.e12 + (s.c - r.e12) * 2 / 13 END, CASE WHEN s.bar_idx < 9 THEN NULL WHEN s.bar_idx = 9 THEN s.tr10 ELSE (r.atr * 9 + s.tr) / 10 END,
CASE WHEN s.bar_idx < 14 THEN NULL WHEN s.bar_idx = 14 THEN s.g14 ELSE (r.ag * 13 + greatest(s.step, 0)) / 14 END, CASE WHEN s.bar_idx < 14 THEN NULL WHEN s.bar_idx = 14 THEN s.l14 ELSE (r.al * 13 + greatest(-s.step, 0)) / 14 END,
r.esa + (s.ap - r.esa) * 2 / 10, r.d + (abs(s.ap - (r.esa + (s.ap - r.esa) * 2 / 10)) - r.d) * 2 / 10 FROM r JOIN s ON s.instrument = r.instrument AND s.bar_idx = r.bar_idx + 1),
ci AS (SELECT r.*, (x.ap - esa) / nullif(d * 0.015, 0) AS ci, x.c, x.v, x.step FROM r JOIN x USING (instrument, bar_idx)),
k AS (SELECT instrument, min(bar_idx) AS f FROM ci WHERE ci IS NOT NULL GROUP BY 1),
q AS (SELECT ci.instrument, ci.bar_idx, ci.ci AS wt1 FROM ci JOIN k ON k.instrument = ci.instrument AND ci.bar_idx = k.f UNION ALL SELECT ci.instrument, ci.bar_idx, q.wt1 + (ci.ci - q.wt1) * 2 / 13 FROM q JOIN ci ON ci.instrument = q.instrument AND ci.bar_idx = q.bar_idx + 1)
SELECT ci.instrument, ci.bar_idx, round(e11 + 1e-9, 5) AS ema11, round(e12 + 1e-9, 5) AS ema12, round(atr + 1e-9, 5) AS atr, round(CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END, 4) AS rsi, round(wt1, 4) AS wt1, round(CASE WHEN count(wt1) OVER z = 3 THEN avg(wt1) OVER z END, 4) AS wt2,
round(sum(coalesce(sign(step), 0) * v) OVER (PARTITION BY ci.instrument ORDER BY ci.bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS obv FROM ci LEFT JOIN q USING (instrument, bar_idx) WINDOW z AS (PARTITION BY ci.instrument ORDER BY ci.bar_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def r_recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential and Wilder means in both seedings, relative strength, WaveTrend, on-balance volume, without a pass over a whole series."""
    b = hourly(spark, sf_dir)
    b = recursive.ema(recursive.ema(b, "c", 11, "ema11"), "c", 12, "ema12", "sma")
    b = recursive.wavetrend(recursive.rsi(recursive.atr(b, 10), "c", 14))
    b = windows.bounded(b, 1, lambda w: {"step": c("c") - F.lag("c").over(w)}).withColumn("obv", recursive.on_balance_volume())
    b = b.withColumns({k: F.round(k, 4) for k in ("rsi", "wt1", "wt2")} | {k: c(k) + 1e-9 for k in ("ema11", "ema12", "atr")})
    return rounded(b, "instrument", "bar_idx", "ema11", "ema12", "atr", "rsi", "wt1", "wt2", "obv", places=5)


def oscillated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with WaveTrend and a ribbon, for events."""
    return recursive.wavetrend(recursive.ribbon(hourly(spark, sf_dir)))


_FLAT = f"""WITH {BARS}, x AS (SELECT *, avg(c) OVER {last(5)} AS f, avg(c) OVER {last(20)} AS s, lag(o) OVER {W} AS po, lag(c) OVER {W} AS pc, lag(h) OVER {W} AS ph, lag(l) OVER {W} AS pl, avg(abs(c - o)) OVER (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mb FROM bars),
y AS (SELECT *, CASE WHEN bar_idx >= 4 THEN f END AS ff, CASE WHEN bar_idx >= 19 THEN s END AS ss FROM x), z AS (SELECT *, lag(ff) OVER {W} AS pf, lag(ss) OVER {W} AS ps FROM y)"""


@register(_FLAT + """, e AS (SELECT *, 'cross_up' AS type, 'bullish' AS side FROM z WHERE ff > ss AND pf <= ps UNION ALL SELECT *, 'cross_down', 'bearish' FROM z WHERE ff < ss AND pf >= ps
UNION ALL SELECT *, 'displacement_up', 'bullish' FROM z WHERE bar_idx >= 5 AND abs(c - o) > mb AND h - greatest(o, c) < abs(c - o) * 0.36 AND least(o, c) - l < abs(c - o) * 0.36 AND c > o UNION ALL SELECT *, 'displacement_down', 'bearish' FROM z WHERE bar_idx >= 5 AND abs(c - o) > mb AND h - greatest(o, c) < abs(c - o) * 0.36 AND least(o, c) - l < abs(c - o) * 0.36 AND c <= o
UNION ALL SELECT *, 'imbalance_up', 'bullish' FROM z WHERE least(o, c) > greatest(po, pc) AND l <= ph UNION ALL SELECT *, 'imbalance_down', 'bearish' FROM z WHERE greatest(o, c) < least(po, pc) AND h >= pl)
SELECT instrument, bar_idx, t, t + 3600 AS known_at, type, side, round(c, 6) AS price FROM e""")
def e_point_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, E18, E19 in one event schema: crossings, displacement candles, volume imbalances."""
    b = windows.bounded(hourly(spark, sf_dir), 30, lambda w: {"f": windows.sma("c", 5, w), "s": windows.sma("c", 20, w), **E.displacement_candle(w), **E.volume_imbalance(w)}, lambda w: {"up": E.crossover("f", "s", w), "down": E.crossunder("f", "s", w)})
    ev = E.emit(b, "basic", {"cross_up": (c("up"), "bullish"), "cross_down": (c("down"), "bearish"), "displacement_up": (c("displaced") == "bullish", "bullish"), "displacement_down": (c("displaced") == "bearish", "bearish"), "imbalance_up": (c("imbalance") == "bullish", "bullish"), "imbalance_down": (c("imbalance") == "bearish", "bearish")})
    return rounded(ev, "instrument", "bar_idx", "t", "known_at", "type", "side", "price")


@register(f"""WITH {BARS}, x AS (SELECT *, CASE WHEN c > o THEN 'up' WHEN c < o THEN 'down' ELSE 'flat' END AS state FROM bars), y AS (SELECT *, CASE WHEN lag(state) OVER {W} = state THEN 0 ELSE 1 END AS n FROM x), z AS (SELECT *, sum(n) OVER {W} AS run FROM y)
SELECT instrument, state, min(bar_idx) AS start_idx, max(bar_idx) AS end_idx, count(*) AS bars FROM z GROUP BY instrument, state, run""")
def e_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of bars in one state."""
    return E.islands(hourly(spark, sf_dir), F.when(c("c") > c("o"), "up").when(c("c") < c("o"), "down").otherwise("flat")).drop("timeframe")


@register(f"""WITH {BARS}, x AS (SELECT *, lag(c) OVER {W} AS pc, avg(c) OVER (PARTITION BY instrument) AS m FROM bars), dn AS (SELECT * FROM x WHERE c < m AND pc >= m), up AS (SELECT * FROM x WHERE c > m AND pc <= m),
e AS (SELECT d.instrument, d.bar_idx AS start_idx, min(u.bar_idx) AS end_idx FROM dn d JOIN up u ON u.instrument = d.instrument AND u.bar_idx > d.bar_idx GROUP BY 1, 2), f AS (SELECT instrument, min(start_idx) AS start_idx, end_idx FROM e GROUP BY instrument, end_idx)
SELECT f.instrument, start_idx, end_idx, EXISTS (SELECT 1 FROM x WHERE x.instrument = f.instrument AND x.bar_idx BETWEEN f.start_idx AND f.end_idx AND x.v > 90) AS has_flag FROM f""")
def e_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a crossing down to the next one up, and whether a flag stood in between."""
    w = windows.series()
    b = hourly(spark, sf_dir).withColumn("m", F.avg("c").over(Window.partitionBy("instrument"))).withColumn("pc", F.lag("c").over(w))
    return E.episodes(b, (c("c") < c("m")) & (c("pc") >= c("m")), (c("c") > c("m")) & (c("pc") <= c("m")), c("v") > 90).drop("timeframe")



@register(f"""WITH {BARS}, x AS (SELECT *, lag(h, 3) OVER {W} AS h3, lag(l, 3) OVER {W} AS l3 FROM bars)
SELECT instrument, bar_idx, round(CASE WHEN count(h) OVER p = 3 AND count(h) OVER q = 3 AND h3 > max(h) OVER p AND h3 > max(h) OVER q THEN h3 END, 6) AS high, round(CASE WHEN count(l) OVER p = 3 AND count(l) OVER q = 3 AND l3 < min(l) OVER p AND l3 <= min(l) OVER q THEN l3 END, 6) AS low FROM x
WINDOW p AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING), q AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def p_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots known three bars later, strict on both sides or loose on the right."""
    w = windows.series()
    return rounded(hourly(spark, sf_dir).select("instrument", "bar_idx", P.pivot("h", 3, 3, w).alias("high"), P.pivot("l", 3, 3, w, False, True, False).alias("low")))


_SWING = f"""{BARS}, x0 AS (SELECT *, lag(h, 5) OVER {W} AS oh, lag(l, 5) OVER {W} AS ol, lag(c) OVER {W} AS pc, max(h) OVER {last(5)} AS mh, min(l) OVER {last(5)} AS ml FROM bars),
x1 AS (SELECT *, coalesce(last_value(CASE WHEN oh > mh THEN 0 WHEN ol < ml THEN 1 END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS leg FROM x0),
x2 AS (SELECT *, leg - coalesce(lag(leg) OVER {W}, 0) AS turn FROM x1),
x3 AS (SELECT *, last_value(CASE WHEN turn = -1 THEN oh END IGNORE NULLS) OVER u AS sh, last_value(CASE WHEN turn = -1 THEN bar_idx - 5 END IGNORE NULLS) OVER u AS shi, last_value(CASE WHEN turn = 1 THEN ol END IGNORE NULLS) OVER u AS sl, last_value(CASE WHEN turn = 1 THEN bar_idx - 5 END IGNORE NULLS) OVER u AS sli FROM x2 WINDOW u AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x4 AS (SELECT *, coalesce(c > sh AND pc <= lag(sh) OVER {W}, false) AS xu, coalesce(c < sl AND pc >= lag(sl) OVER {W}, false) AS xd FROM x3),
x5 AS (SELECT *, xu AND row_number() OVER (PARTITION BY instrument, shi, xu ORDER BY bar_idx) = 1 AS bu, xd AND row_number() OVER (PARTITION BY instrument, sli, xd ORDER BY bar_idx) = 1 AS bd FROM x4),
x6 AS (SELECT *, last_value(CASE WHEN bd THEN -1 WHEN bu THEN 1 END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bias FROM x5),
x7 AS (SELECT *, coalesce(lag(bias) OVER {W}, 0) AS before FROM x6),
brk AS (SELECT instrument, bar_idx, t, 'bullish' AS side, CASE WHEN before = -1 THEN 'CHOCH' ELSE 'BOS' END AS type, sh AS level, shi AS pivot_idx FROM x7 WHERE bu UNION ALL SELECT instrument, bar_idx, t, 'bearish', CASE WHEN before = 1 THEN 'CHOCH' ELSE 'BOS' END, sl, sli FROM x7 WHERE bd)"""


@register(f"WITH {_SWING} SELECT instrument, bar_idx, t, side, type, round(level, 6) AS level, pivot_idx FROM brk")
def p_structure_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swings and the first close through each, with or against the bias."""
    return rounded(P.breaks(P.swings(hourly(spark, sf_dir), 5, "swing"), "swing"), "instrument", "bar_idx", "t", "side", "type", "level", "pivot_idx")


@register(f"WITH {_SWING} SELECT instrument, bar_idx, bias FROM x6 WHERE bias IS NOT NULL")
def p_trend_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of the last break, carried forward."""
    b = hourly(spark, sf_dir)
    return P.trend(b, P.breaks(P.swings(b, 5, "swing"), "swing")).where("bias IS NOT NULL").select("instrument", "bar_idx", "bias")


_BLOCKS = f"""{_SWING}, ob0 AS (SELECT k.instrument, k.bar_idx, k.side, k.pivot_idx, b.bar_idx AS oi, b.l, b.h, row_number() OVER (PARTITION BY k.instrument, k.bar_idx, k.side ORDER BY CASE WHEN k.side = 'bullish' THEN b.l ELSE -b.h END, b.bar_idx) AS rn FROM brk k JOIN bars b ON b.instrument = k.instrument AND b.bar_idx >= k.pivot_idx AND b.bar_idx < k.bar_idx),
ob AS (SELECT instrument, side, bar_idx AS created_idx, oi AS origin_idx, l AS bar_low, h AS bar_high FROM ob0 WHERE rn = 1)"""


@register(f"""WITH {_BLOCKS} SELECT ob.instrument, ob.side, created_idx, origin_idx, round(bar_low, 6) AS bar_low, round(bar_high, 6) AS bar_high, min(b.bar_idx) AS mitigated_idx FROM ob LEFT JOIN bars b ON b.instrument = ob.instrument AND b.bar_idx >= created_idx AND CASE WHEN ob.side = 'bullish' THEN b.l < bar_low ELSE b.h > bar_high END GROUP BY ALL""")
def p_order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extreme bar behind each break, and the first bar beyond its far edge."""
    b = hourly(spark, sf_dir)
    ob = S.kept(P.order_blocks(P.breaks(P.swings(b, 5, "swing"), "swing"), b))
    return rounded(P.mitigated(ob, b), "instrument", "side", "created_idx", "origin_idx", "bar_low", "bar_high", "mitigated_idx")


@register(f"""WITH {BARS}, x AS (SELECT *, lag(h, 2) OVER {W} AS h2, lag(l, 2) OVER {W} AS l2 FROM bars), g AS (SELECT instrument, bar_idx, CASE WHEN l > h2 THEN 'bullish' ELSE 'bearish' END AS side, CASE WHEN l > h2 THEN h2 ELSE h END AS bottom, CASE WHEN l > h2 THEN l ELSE l2 END AS top FROM x WHERE l > h2 OR h < l2),
g1 AS (SELECT *, CASE WHEN lag(bar_idx) OVER (PARTITION BY instrument, side ORDER BY bar_idx) = bar_idx - 1 THEN 0 ELSE 1 END AS n FROM g), g2 AS (SELECT *, sum(n) OVER (PARTITION BY instrument, side ORDER BY bar_idx) AS run FROM g1),
z AS (SELECT instrument, side, min(bottom) AS bottom, max(top) AS top, min(bar_idx) AS created_idx, max(bar_idx) AS last_idx, first(top - bottom ORDER BY bar_idx) AS size, count(*) AS merged_bars FROM g2 GROUP BY instrument, side, run)
SELECT z.instrument, z.side, round(bottom, 6) AS bottom, round(top, 6) AS top, created_idx, last_idx, round(size, 6) AS size, merged_bars, min(CASE WHEN CASE WHEN z.side = 'bullish' THEN b.l < top ELSE b.h > bottom END THEN b.bar_idx END) AS touch_idx, min(CASE WHEN CASE WHEN z.side = 'bullish' THEN b.l < bottom ELSE b.h > top END THEN b.bar_idx END) AS break_idx
FROM z LEFT JOIN bars b ON b.instrument = z.instrument AND b.bar_idx > z.last_idx GROUP BY z.instrument, z.side, bottom, top, created_idx, last_idx, size, merged_bars""")
def p_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-bar gaps, merged over runs, with their touch and break."""
    return rounded(P.fair_value_gaps(hourly(spark, sf_dir)).drop("gap_id", "timeframe"))

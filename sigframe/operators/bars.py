"""Ticks to bars, bars to coarser bars, and what is read off a series of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, LADDER, OFFSET, SECONDS, bucket

DAY = 86400


def from_ticks(ticks: DataFrame, timeframe: str = "1h") -> DataFrame:
    """Open, high, low, close, volume of each bucket that has ticks; ties in time go by ``seq``."""
    at = F.struct("ts", "seq")
    rows = ticks.withColumn("t", bucket(F.col("ts"), SECONDS[timeframe], OFFSET[timeframe])).groupBy("instrument", "t")
    out = rows.agg(F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.sum("volume").alias("v"))
    return out.withColumn("timeframe", F.lit(timeframe))


def rollup(bars: DataFrame, timeframes: list[str]) -> DataFrame:
    """Coarser bars of every timeframe given, in one pass over the finer ones."""
    spec = F.array(*[F.struct(F.lit(n).alias("timeframe"), F.lit(s).cast("long").alias("s"), F.lit(off).cast("long").alias("off")) for n, s, off in LADDER if n in timeframes])
    rows = bars.drop("timeframe", "bar_idx").withColumn("_r", F.explode(spec)).withColumn("_t", bucket(F.col("t"), F.col("_r.s"), F.col("_r.off"))).groupBy("instrument", F.col("_r.timeframe").alias("timeframe"), "_t")
    out = rows.agg(F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v"))
    return out.withColumnRenamed("_t", "t")


def indexed(bars: DataFrame, keys: list[str] = KEY, span: int = 100 * DAY) -> DataFrame:
    """A dense ``bar_idx`` from 0 per key. Rows are numbered within spans of time and spans are summed, so no task sorts a whole key."""
    part = bars.withColumn("_span", F.floor(F.col("t") / span))
    sizes = part.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "_span", before.alias("_start"))
    number = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy("t")) - 1
    return part.withColumn("_k", number).join(starts, [*keys, "_span"]).withColumn("bar_idx", (F.col("_start") + F.col("_k")).cast("long")).drop("_span", "_k", "_start")


def phased(bars: DataFrame, seconds: int, phases: list[int], least: int = 3) -> DataFrame:
    """Buckets that begin at every phase given; those with fewer than ``least`` bars go."""
    rows = bars.withColumn("phase", F.explode(F.array(*[F.lit(p).cast("long") for p in phases]))).withColumn("bt", bucket(F.col("t"), seconds, F.col("phase")))
    out = rows.groupBy("instrument", "phase", "bt").agg(F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.count("*").alias("n_bars"))
    return out.where(F.col("n_bars") >= least)


def summary(bars: DataFrame, last: int = 100, shown: int = 5, keys: list[str] = KEY) -> DataFrame:
    """Open, close, range, change and mean volume over the last bars, and the last few closes."""
    top = bars.groupBy(*keys).agg(F.max("bar_idx").alias("_last"))
    rows = bars.join(top, keys).where(F.col("bar_idx") > F.col("_last") - last).groupBy(*keys)
    out = rows.agg(F.count("*").alias("n"), F.min_by("o", "bar_idx").alias("open"), F.max_by("c", "bar_idx").alias("close"), F.max("h").alias("high"), F.min("l").alias("low"), F.avg("v").alias("avg_volume"), F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("bar_idx", "c")))), 1, shown).alias("_tail"))
    change = F.col("close") - F.col("open")
    return out.withColumns({"range": F.col("high") - F.col("low"), "change": change, "change_pct": F.try_divide(change * 100, F.col("open")), "last_closes": F.array_join(F.transform("_tail", lambda x: F.format_string("%.4f", x["c"])), " ")}).drop("_tail")


def audit(bars: DataFrame, seconds: int, keys: list[str] = KEY) -> DataFrame:
    """Missing buckets and repeated times of each series."""
    times = bars.groupBy(*keys, "t").agg(F.count("*").alias("n"))
    step = F.lead("t").over(Window.partitionBy(*keys).orderBy("t")) - F.col("t")
    rows = times.withColumn("step", step).groupBy(*keys)
    return rows.agg(F.count("*").alias("n_times"), F.sum(F.col("n") - 1).alias("repeated"), F.coalesce(F.sum(F.when(F.col("step") > seconds, 1)), F.lit(0)).alias("gaps"), F.coalesce(F.sum(F.when(F.col("step") > seconds, F.col("step") / seconds - 1)), F.lit(0.0)).cast("long").alias("missing"))


#: Trading sessions as hours of local time.
SESSIONS = {"new_york": ("America/New_York", 7, 9), "london": ("Europe/London", 7, 10), "london_close": ("Europe/London", 15, 17), "asian": ("Asia/Tokyo", 10, 14)}


def in_session(t: Column, session: str) -> Column:
    zone, begin, end = SESSIONS[session]
    hour = F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("SECOND", t.cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))))
    return (hour >= begin) & (hour < end)


def opening_gaps(bars: DataFrame, seconds: int = DAY, offset: int = 0, keys: list[str] = KEY) -> DataFrame:
    """From each period's last close to the next period's first open."""
    rows = bars.withColumn("period", bucket(F.col("t"), seconds, offset)).groupBy(*keys, "period").agg(F.min_by("o", "t").alias("open"), F.max_by("c", "t").alias("close"))
    return rows.withColumn("gap", F.col("open") - F.lag("close").over(Window.partitionBy(*keys).orderBy("period")))


def previous_levels(bars: DataFrame, timeframe: str) -> DataFrame:
    """Each bar with the high and low of the last closed bar of a slower timeframe, and when they were set."""
    s, off = SECONDS[timeframe], OFFSET[timeframe]
    slow = bars.withColumn("bt", bucket(F.col("t"), s, off)).groupBy("instrument", "bt").agg(F.max("h").alias("prev_high"), F.max_by("t", F.struct("h", -F.col("t"))).alias("prev_high_t"), F.min("l").alias("prev_low"), F.min_by("t", F.struct("l", "t")).alias("prev_low_t"))
    order = Window.partitionBy("instrument").orderBy("bt")
    names = ["prev_high", "prev_high_t", "prev_low", "prev_low_t"]
    prior = slow.select("instrument", "bt", *[F.lag(c).over(order).alias(c) for c in names])
    return bars.withColumn("bt", bucket(F.col("t"), s, off)).join(prior, ["instrument", "bt"]).drop("bt")

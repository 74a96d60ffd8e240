"""Indicators over a bounded number of bars.

Each takes the ordered window of a series and gives a column. ``bounded`` runs them over blocks of bars with as
many bars of the block before as they look back, so that a long series is shared among tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import KEY
from .rows import body_ratio, c, money_flow_volume, ratio

BLOCK = 4096
Stage = Callable[[WindowSpec], dict[str, Column]]


def series(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or KEY)).orderBy("bar_idx")


def bounded(bars: DataFrame, reach: int, *stages: Stage, block: int = BLOCK, keys: list[str] = KEY) -> DataFrame:
    """Adds the stages' columns, each stage over those before it; together they look back ``reach`` bars at most."""
    if reach >= block:
        raise ValueError("a block must be longer than what is looked back on")
    own = F.floor(F.col("bar_idx") / block)
    both = F.when(F.col("bar_idx") % block >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))
    rows = bars.withColumn("_block", F.explode(both))
    w = Window.partitionBy(*keys, "_block").orderBy("bar_idx")
    for stage in stages:
        rows = rows.withColumns(stage(w))
    return rows.where(F.col("_block") == own).drop("_block")


def last(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def full(x: Column | str, value: Column, w: WindowSpec, n: int) -> Column:
    """The value once the last n bars all have an ``x``."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(last(w, n)) == n, value)


def sma(x: str, n: int, w: WindowSpec) -> Column:
    return full(x, F.avg(x).over(last(w, n)), w, n)


def bollinger(x: str, w: WindowSpec, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = sma(x, n, w), full(x, F.stddev_pop(x).over(last(w, n)), w, n)
    return {"bb_mid": mid, "bb_upper": mid + k * sd, "bb_lower": mid - k * sd}


def highest(x: str, n: int, w: WindowSpec) -> Column:
    return full(x, F.max(x).over(last(w, n)), w, n)


def lowest(x: str, n: int, w: WindowSpec) -> Column:
    return full(x, F.min(x).over(last(w, n)), w, n)


def stochastic(w: WindowSpec, n: int = 14, value: str = "c", high: str = "h", low: str = "l") -> Column:
    """Place of the value in the range of the last n bars, from 0 to 100; 0 for a flat range. A mean of it is taken in a second stage."""
    hi, lo = F.max(high).over(last(w, n)), F.min(low).over(last(w, n))
    return full(value, F.when(hi == lo, 0.0).otherwise(ratio(c(value) - lo, hi - lo) * 100), w, n)


def cci(typical: str, w: WindowSpec, n: int = 10) -> Column:
    xs, mean = F.collect_list(typical).over(last(w, n)), F.avg(typical).over(last(w, n))
    deviation = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return full(typical, F.when(deviation == 0, 0.0).otherwise(ratio(c(typical) - mean, deviation * 0.015)), w, n)


def vwma(n: int, w: WindowSpec) -> Column:
    return full("c", ratio(F.sum(c("c") * c("v")).over(last(w, n)), F.sum("v").over(last(w, n))), w, n)


def chaikin(w: WindowSpec, n: int = 21) -> Column:
    return full("c", ratio(F.sum(money_flow_volume()).over(last(w, n)), F.sum("v").over(last(w, n))), w, n)


def money_flow(step: str, w: WindowSpec, n: int = 14) -> Column:
    """Money flow index; ``step`` is a column with the change of the price. Without a loss it is 100."""
    up = F.sum(F.when(c(step) > 0, c("c") * c("v")).otherwise(0.0)).over(last(w, n))
    down = F.sum(F.when(c(step) < 0, c("c") * c("v")).otherwise(0.0)).over(last(w, n))
    return full(step, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + ratio(up, down))), w, n)


def body_flow(w: WindowSpec, n: int = 60, shift: float = 0.0) -> Column:
    return full("c", F.avg(body_ratio()).over(last(w, n)) - shift, w, n)


def regression_end(x: str, n: int, w: WindowSpec) -> Column:
    """Where the least-squares line of the last n values ends."""
    s = last(w, n)
    sum_y, sum_iy = F.sum(x).over(s), F.sum(c(x) * c("bar_idx")).over(s)
    # Places 1..n in the window: i - (bar_idx - n).
    sum_py = sum_iy - (c("bar_idx") - n) * sum_y
    slope = (n * sum_py - sum_y * (n * (n + 1) / 2)) / (n * n * (n * n - 1) / 12)
    return full(x, sum_y / n + slope * ((n - 1) / 2), w, n)


def short_rsi(step: str, w: WindowSpec, n: int = 3) -> Column:
    gain, loss = F.sum(F.greatest(c(step), F.lit(0.0))).over(last(w, n)), F.sum(F.greatest(-c(step), F.lit(0.0))).over(last(w, n))
    return F.when(F.count(step).over(last(w, n)) < n, 50.0).otherwise(F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss))))


def session_vwap(session: str, keys: list[str] = KEY) -> Column:
    """Volume-weighted price since the session began. Sessions are short, so each is a window of its own."""
    w = Window.partitionBy(*keys, session).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    typical = (c("h") + c("l") + c("c")) / 3
    return ratio(F.sum(typical * c("v")).over(w), F.sum("v").over(w))


def bias(vwap: str, ema: str, rsi: str, low: float = 30, high: float = 70) -> Column:
    """Buy below an oversold reading in an upward market, sell above an overbought one in a downward market."""
    return F.when((c("c") > c(vwap)) & (c("c") > c(ema)) & (c(rsi) < low), "buy").when((c("c") < c(vwap)) & (c("c") < c(ema)) & (c(rsi) > high), "sell").otherwise("flat")


def bars_since(condition: Column, n: int, w: WindowSpec) -> Column:
    """Bars since the condition held, if in the last n."""
    return c("bar_idx") - F.max(F.when(condition, c("bar_idx"))).over(w.rowsBetween(-n, 0))


def tip(x: str, w: WindowSpec, n: int = 3) -> Column:
    """How sharply a series turns at a bar: its slopes over n bars before and after."""
    return F.abs((c(x) - F.lag(x, n).over(w)) / n) + F.abs((F.lead(x, n).over(w) - c(x)) / n)


def around(x: str, w: WindowSpec, n: int = 5) -> dict[str, Column]:
    s = w.rowsBetween(-n, n)
    return {f"max_around_{x}": F.max(x).over(s), f"min_around_{x}": F.min(x).over(s)}


def displacement(k: int, atr: str, w: WindowSpec) -> Column:
    return ratio(c("c") - F.lag("c", k).over(w), c(atr))


def range_oscillator(x: str, n: int, w: WindowSpec) -> Column:
    hi, lo = highest(x, n, w), lowest(x, n, w)
    return ratio(c(x) - hi, hi - lo) * 60 + 80


def percentile_rank(df: DataFrame, x: str, keys: list[str] = KEY) -> DataFrame:
    """Share of a series' values below each one. Equal values are counted first, so that the window runs over different values only."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(x)
    below = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    return df.join(counts.select(*keys, x, (below / total).alias(f"{x}_rank")), [*keys, x], "left")


def quantile_cuts(df: DataFrame, x: str, shares: list[float], keys: list[str] = KEY) -> DataFrame:
    """Per key the values at sorted places floor(n * share), not interpolated: an array in the order of ``shares``."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(x)
    upto, total = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("_n").over(Window.partitionBy(*keys))
    placed = counts.select(*keys, F.col(x).alias("_x"), upto.alias("_upto"), total.alias("_total"), "_n")
    at = [F.least(F.floor(F.col("_total") * s), F.col("_total") - 1) for s in shares]
    return placed.groupBy(*keys).agg(F.array(*[F.max(F.when((a >= F.col("_upto") - F.col("_n")) & (a < F.col("_upto")), F.col("_x"))) for a in at]).alias("cuts"))


def binned(df: DataFrame, x: str, bins: int, keys: list[str] = KEY) -> DataFrame:
    """With the number of cuts that are below each value."""
    cuts = quantile_cuts(df, x, [k / bins for k in range(1, bins)], keys)
    return df.join(cuts, keys, "left").withColumn(f"{x}_bin", F.size(F.filter("cuts", lambda k: F.col(x) > k))).drop("cuts")


def three_means(x: str, w: WindowSpec, n: int = 100) -> Column:
    """The three centres (high, middle, low) of the last n values by one-dimensional k-means; every row is a problem of its own.

    The first guesses lie at three quarters, a half and a quarter of the range. Values as near to two centres as to one belong to none.
    """
    @F.pandas_udf("array<double>")
    def centres(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        whole = np.flatnonzero(values.map(lambda v: v is not None and len(v) == n).to_numpy(bool))
        for part in np.array_split(whole, max(1, len(whole) // 2048)):  # all rows of a part at once
            if len(part):
                v = np.stack(values.iloc[part].to_numpy()).astype(float)
                lo, hi = v.min(1, keepdims=True), v.max(1, keepdims=True)
                at = lo + (hi - lo) * np.array([0.75, 0.5, 0.25])
                for _ in range(200):
                    d = np.abs(v[:, :, None] - at[:, None, :])
                    near = d == d.min(2, keepdims=True)
                    near &= near.sum(2, keepdims=True) == 1
                    count = near.sum(1)
                    new = np.where(count > 0, (v[:, :, None] * near).sum(1) / np.maximum(count, 1), at)
                    if (new == at).all():
                        break
                    at = new
                out.iloc[part] = list(at)
        return out

    return centres(F.collect_list(x).over(last(w, n)))

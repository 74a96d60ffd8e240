"""Series in which each value depends on the one before: y[t] = a * y[t-1] + b[t].

Written out, y[t] is the sum of b[i] * a ** (t - i); after enough rows a term is below the last digit of a double. So ``affine_scan`` is a window: rows lie in blocks as long as
that reach, each block also holds the rows of the one before, and within it terms are scaled by powers of ``a``. No pass over a whole series, no join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY
from .rows import c, ratio, true_range
from .windows import bounded, highest, lowest, money_flow, series, sma

DIGITS = 42.0  # e ** -42 is below half a unit in the last place of a sum


def affine_scan(df: DataFrame, b: str, a: float, name: str, keys: list[str] = KEY, place: str = "bar_idx") -> DataFrame:
    """Adds ``name`` with y = a * y_before + b for 0 < a < 1. A missing ``b`` counts as 0; ``place`` counts the steps."""
    reach = math.ceil(DIGITS / -math.log(a))
    own = F.floor(F.col(place) / reach)
    rows = df.withColumn("_blk", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(*keys, "_blk").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col(place) - (F.col("_blk") - 1) * reach  # 0 .. 2 * reach
    y = F.sum(F.coalesce(c(b), F.lit(0.0)) * F.exp(p * -math.log(a))).over(w) * F.exp(p * math.log(a))
    return rows.withColumn(name, y).where(F.col("_blk") == own).drop("_blk")


def ema(df: DataFrame, x: str, n: int, name: str, seed: str = "first", on_null: str = "null", keys: list[str] = KEY, alpha: float | None = None) -> DataFrame:
    """Exponential mean of ``x`` over n bars, or of factor ``alpha``.

    seed "first": begins with the first value; "sma": with the mean of the first n values. Missing values are passed over; their rows are NULL, or with
    on_null "carry" repeat the last mean.
    """
    k = alpha if alpha is not None else 2.0 / (n + 1)
    w = Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    there = df.withColumn("_i", F.count(x).over(w) - 1)
    start = n - 1 if seed == "sma" else 0
    # Up to the seed the running mean of what there is; it is the seed's value there.
    first = F.avg(x).over(w) if seed == "sma" else c(x)
    begin = F.when(c(x).isNull() | (c("_i") < start), F.lit(None)).when(c("_i") == start, first).otherwise(c(x) * k)
    out = affine_scan(there.withColumn("_eb", begin), "_eb", 1 - k, name, keys, "_i")
    ready = c("_i") >= start if on_null == "carry" else (c("_i") >= start) & c(x).isNotNull()
    return out.withColumn(name, F.when(c("_i") == start, F.last("_eb", True).over(w)).when(ready, c(name)) if on_null == "carry" else F.when(ready & (c("_i") == start), c("_eb")).when(ready, c(name))).drop("_i", "_eb")


def wilder(df: DataFrame, x: str, n: int, name: str, keys: list[str] = KEY) -> DataFrame:
    """Wilder's mean: the plain mean of the first n values, then one nth of each new one."""
    return ema(df, x, n, name, "sma", "null", keys, 1.0 / n)


def atr(df: DataFrame, n: int, name: str = "atr", keys: list[str] = KEY) -> DataFrame:
    ranged = bounded(df, 1, lambda w: {"_tr": true_range(w)}, keys=keys)
    return wilder(ranged, "_tr", n, name, keys).drop("_tr")


def rsi(df: DataFrame, x: str, n: int, name: str = "rsi", keys: list[str] = KEY) -> DataFrame:
    step = bounded(df, 1, lambda w: {"_d": c(x) - F.lag(x).over(w)}, keys=keys)
    step = step.withColumns({"_g": F.greatest("_d", F.lit(0.0)), "_l": F.greatest(-c("_d"), F.lit(0.0))}).withColumns({k: F.when(c("_d").isNotNull(), c(k)) for k in ("_g", "_l")})
    both = wilder(wilder(step, "_g", n, "_ag", keys), "_l", n, "_al", keys)
    return both.withColumn(name, F.when(c("_al") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(c("_ag"), c("_al"))))).drop("_d", "_g", "_l", "_ag", "_al")


def macd(df: DataFrame, x: str = "c", fast: int = 12, slow: int = 26, signal: int = 9, keys: list[str] = KEY) -> DataFrame:
    """Line and histogram; the means are seeded by plain means, the signal by the line's first value."""
    both = ema(ema(df, x, fast, "_f", "sma", keys=keys), x, slow, "_s", "sma", keys=keys).withColumn("macd", c("_f") - c("_s"))
    return ema(both, "macd", signal, "_sig", "first", keys=keys).withColumn("macd_hist", c("macd") - c("_sig")).drop("_f", "_s", "_sig")


def on_balance_volume(keys: list[str] = KEY) -> Column:
    """Needs ``step``, the change of the close."""
    return F.sum(F.coalesce(F.signum("step"), F.lit(0.0)) * c("v")).over(series(*keys).rowsBetween(Window.unboundedPreceding, 0))


def wavetrend(df: DataFrame, channel: int = 9, average: int = 12, signal: int = 3, keys: list[str] = KEY) -> DataFrame:
    """Channel index of the typical price, smoothed (wt1), and its short mean (wt2)."""
    rows = df.withColumn("_ap", (c("h") + c("l") + c("c")) / 3)
    rows = ema(rows, "_ap", channel, "_esa", keys=keys).withColumn("_dev", F.abs(c("_ap") - c("_esa")))
    rows = ema(rows, "_dev", channel, "_d", keys=keys).withColumn("_ci", ratio(c("_ap") - c("_esa"), c("_d") * 0.015))
    rows = ema(rows, "_ci", average, "wt1", keys=keys)
    return bounded(rows, signal, lambda w: {"wt2": sma("wt1", signal, w)}, keys=keys).drop("_ap", "_esa", "_dev", "_d", "_ci")


def schaff(df: DataFrame, x: str = "c", fast: int = 23, slow: int = 50, cycle: int = 10, smooth: float = 0.5, keys: list[str] = KEY) -> DataFrame:
    """Schaff trend cycle: two stochastic passes over the difference of means, each smoothed; a flat range holds the last place."""
    rows = ema(ema(df, x, fast, "_f", keys=keys), x, slow, "_s", keys=keys).withColumn("_m", c("_f") - c("_s"))
    held = Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    for src, out in (("_m", "_k1"), ("_k1", "stc")):
        rows = bounded(rows, cycle, lambda w, s=src: {"_hi": highest(s, cycle, w), "_lo": lowest(s, cycle, w)}, keys=keys)
        rows = rows.withColumn("_place", F.last(F.when(c("_hi") > c("_lo"), (c(src) - c("_lo")) / (c("_hi") - c("_lo")) * 100), True).over(held)).withColumn("_place", F.when(c("_hi").isNotNull(), c("_place")))
        rows = ema(rows, "_place", 0, out, keys=keys, alpha=smooth).drop("_hi", "_lo", "_place")
    return rows.drop("_f", "_s", "_m", "_k1")


def trend_blend(df: DataFrame, channel: int = 9, average: int = 6, flow: int = 14, strength: int = 3, keys: list[str] = KEY) -> DataFrame:
    """Channel index, money flow and relative strength in equal parts."""
    rows = ema(df, "c", channel, "_e", keys=keys).withColumn("_dev", F.abs(c("c") - c("_e")))
    rows = ema(rows, "_dev", channel, "_d", keys=keys).withColumn("_ci", ratio(c("c") - c("_e"), c("_d") * 0.025))
    rows = ema(rows, "_ci", average, "_tci", keys=keys)
    rows = bounded(rows, flow + 1, lambda w: {"step": c("c") - F.lag("c").over(w)}, lambda w: {"_mf": money_flow("step", w, flow)}, keys=keys)
    rows = rsi(rows, "c", strength, "_rsi", keys)
    return rows.withColumn("blend", (c("_tci") + 50 + c("_mf") + c("_rsi")) / 3).drop("_e", "_dev", "_d", "_ci", "_tci", "_mf", "_rsi")


def tsi(df: DataFrame, x: str = "c", long: int = 25, short: int = 13, keys: list[str] = KEY) -> DataFrame:
    """True strength index: a twice smoothed change over its twice smoothed size."""
    rows = bounded(df, 1, lambda w: {"_d": c(x) - F.lag(x).over(w)}, keys=keys).withColumn("_a", F.abs("_d"))
    for k in ("_d", "_a"):
        rows = ema(ema(rows, k, long, f"{k}1", keys=keys), f"{k}1", short, f"{k}2", keys=keys)
    return rows.withColumn("tsi", ratio(c("_d2"), c("_a2")) * 100).drop("_d", "_a", "_d1", "_d2", "_a1", "_a2")


def ribbon(df: DataFrame, lengths: tuple[int, ...] = (5, 11, 15, 18, 21, 24, 28, 34), keys: list[str] = KEY) -> DataFrame:
    """ema1 .. ema8 of the close."""
    return reduce(lambda d, k: ema(d, "c", k[1], f"ema{k[0] + 1}", keys=keys), enumerate(lengths), df)


def peak(x: str, decay: float, keys: list[str] = KEY) -> Column:
    """A peak that rises at once and decays: max(decay * peak, |x|), as a running maximum of logarithms."""
    w = series(*keys).rowsBetween(Window.unboundedPreceding, 0)
    log = F.when(F.abs(c(x)) > 0, F.ln(F.abs(c(x))) - c("bar_idx") * math.log(decay))
    return F.coalesce(F.exp(F.max(log).over(w) + c("bar_idx") * math.log(decay)), F.lit(0.0))


def heikin_ashi(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Smoothed candles: the open is half the last open and half the last close."""
    close = df.withColumn("ha_c", (c("o") + c("h") + c("l") + c("c")) / 4)
    rows = bounded(close, 1, lambda w: {"_b": F.coalesce(F.lag("ha_c").over(w) * 0.5, (c("o") + c("c")) / 2)}, keys=keys)
    rows = affine_scan(rows, "_b", 0.5, "ha_o", keys).drop("_b")
    return rows.withColumns({"ha_h": F.greatest("h", "ha_o", "ha_c"), "ha_l": F.least("l", "ha_o", "ha_c")})


def high_pass(df: DataFrame, x: str, period: float, name: str, keys: list[str] = KEY) -> DataFrame:
    """Two-pole high pass. Its poles are one double real one, so it is two affine scans; missing values and history count as zero."""
    w = 0.707 * 2 * math.pi / period
    alpha = (math.cos(w) + math.sin(w) - 1) / math.cos(w)
    k = (1 - alpha / 2) ** 2
    v = F.coalesce(c(x), F.lit(0.0))
    back = lambda n, s: F.coalesce(F.lag(v, n).over(s), F.lit(0.0))
    rows = bounded(df, 2, lambda s: {"_in": k * (v - 2 * back(1, s) + back(2, s))}, keys=keys)
    return affine_scan(affine_scan(rows, "_in", 1 - alpha, "_once", keys), "_once", 1 - alpha, name, keys).drop("_in", "_once")


def super_smoother(df: DataFrame, x: str, period: float, name: str, keys: list[str] = KEY) -> DataFrame:
    """Two-pole low pass of the mean of two values. Its poles are a * e ** (+-i * turn): the sums of a ** (t - j) * b[j] with the sine and with the cosine of
    j * turn are affine scans, and turned back they give the response a ** (t - j) * sin((t - j + 1) * turn) / sin(turn)."""
    a, turn = math.exp(-math.sqrt(2) * math.pi / period), math.sqrt(2) * math.pi / period
    k = (1 - 2 * a * math.cos(turn) + a * a) / 2
    v = F.coalesce(c(x), F.lit(0.0))
    rows = bounded(df, 1, lambda s: {"_in": k * (v + F.coalesce(F.lag(v).over(s), F.lit(0.0)))}, keys=keys)
    rows = rows.withColumns({"_inc": c("_in") * F.cos(c("bar_idx") * turn), "_ins": c("_in") * F.sin(c("bar_idx") * turn)})
    rows = affine_scan(affine_scan(rows, "_inc", a, "_p", keys), "_ins", a, "_q", keys)
    out = (F.sin((c("bar_idx") + 1) * turn) * c("_p") - F.cos((c("bar_idx") + 1) * turn) * c("_q")) / math.sin(turn)
    return rows.withColumn(name, out).drop("_in", "_inc", "_ins", "_p", "_q")

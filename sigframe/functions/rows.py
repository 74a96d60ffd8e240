"""Expressions over the columns of one row, or of a row and a few before it."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

c = F.col


def ratio(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def true_range(w: WindowSpec) -> Column:
    before = F.lag("c").over(w)
    return F.when(before.isNull(), c("h") - c("l")).otherwise(F.greatest(c("h") - c("l"), F.abs(c("h") - before), F.abs(c("l") - before)))


def shape() -> dict[str, Column]:
    """Means of prices, body and wicks."""
    top, bottom = F.greatest("o", "c"), F.least("o", "c")
    return {"hlc3": (c("h") + c("l") + c("c")) / 3, "hl2": (c("h") + c("l")) / 2, "body": F.abs(c("c") - c("o")), "body_top": top, "body_bottom": bottom, "upper_wick": c("h") - top, "lower_wick": bottom - c("l")}


def parsed_high(atr: Column) -> Column:
    return F.when(c("h") - c("l") >= 2 * atr, c("l")).otherwise(c("h"))


def parsed_low(atr: Column) -> Column:
    return F.when(c("h") - c("l") >= 2 * atr, c("h")).otherwise(c("l"))


def mobius(x: Column, k: float) -> Column:
    """(x + k) / (k x + 1), on a scale around 50."""
    return ratio(x + k, x * k + 1) * 60 + 50


def money_flow_volume() -> Column:
    return F.when(c("h") == c("l"), 0.0).otherwise(ratio((c("c") - c("l")) - (c("h") - c("c")), c("h") - c("l")) * c("v"))


def body_ratio() -> Column:
    return F.when(c("h") == c("l"), 0.0).otherwise(ratio(c("c") - c("o"), c("h") - c("l")) * 150)


def momentum(n: int, w: WindowSpec) -> Column:
    return c("c") - F.lag("c", n).over(w)


def side_of_kind(kind: Column) -> Column:
    """Equal highs point down, equal lows up."""
    return F.when(kind == "EQH", "bearish").when(kind == "EQL", "bullish")


def side_of_colour(argb: Column) -> Column:
    """The greater of a colour's red and green bytes."""
    red, green = (F.shiftright(argb, n).bitwiseAND(F.lit(255)) for n in (16, 8))
    return F.when(green > red, "bullish").when(red > green, "bearish")


def position(price: Column, low: Column, high: Column) -> Column:
    return F.when(price > high, "above").when(price < low, "below").when(price.isNotNull(), "inside")


def stacked(values: Column) -> Column:
    """Whether a ribbon's values all rise or all fall from each to the next."""
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: b - a)
    return F.when(F.forall(pairs, lambda d: d < 0), "up").when(F.forall(pairs, lambda d: d > 0), "down").otherwise("tangled")


def round_step(price: Column) -> Column:
    return F.when(price > 0, F.pow(F.lit(10.0), F.floor(F.log10(F.when(price > 0, price).otherwise(1.0)) + 1e-12) - 1))


def round_levels(price: Column) -> dict[str, Column]:
    step = round_step(price)
    above = F.ceil(price / step + 1e-9) * step
    return {"round_step": step, "round_above": above, "round_below": above - step, "round_offset": (above - price) / step}


def range_zone(price: Column, low: Column, high: Column) -> Column:
    """Premium, equilibrium or discount: top, middle and bottom twentieth of a range."""
    at = ratio(price - low, high - low)
    return F.when(at >= 0.95, "premium").when(at <= 0.05, "discount").when(F.abs(at - 0.5) <= 0.025, "equilibrium").when(at.isNotNull(), "between")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for the error function; absolute error below 1.5e-7."""
    #: The formula's coefficients.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x * p)
    poly = F.lit(0.0)
    for k in reversed(a):
        poly = (poly + k) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)

"""Point events read off series. Conditions are columns; ``emit`` turns them into rows of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import KEY, closes
from .joins import asof

c = F.col


def _value(x: str | float | Column) -> tuple[Column, bool]:
    return (x, False) if isinstance(x, Column) else (c(x), True) if isinstance(x, str) else (F.lit(float(x)), False)


def crossover(a: str, b: str | float, w: WindowSpec) -> Column:
    """``a`` above ``b`` after being at or below it on the bar before. NULLs never fire."""
    now, moves = _value(b)
    before = F.lag(b).over(w) if moves else now
    return F.coalesce((c(a) > now) & (F.lag(a).over(w) <= before), F.lit(False))


def crossunder(a: str, b: str | float, w: WindowSpec) -> Column:
    now, moves = _value(b)
    before = F.lag(b).over(w) if moves else now
    return F.coalesce((c(a) < now) & (F.lag(a).over(w) >= before), F.lit(False))


def turns(x: str, low: float, high: float, w: WindowSpec) -> dict[str, Column]:
    """Turns of a series inside a band."""
    a, b = F.lag(x, 2).over(w), F.lag(x).over(w)
    inside = (b > low) & (b < high)
    return {"turn_up": F.coalesce(inside & (b < a) & (c(x) > b), F.lit(False)), "turn_down": F.coalesce(inside & (b > a) & (c(x) < b), F.lit(False))}


def fractal(x: str, w: WindowSpec, high: float, low: float) -> dict[str, Column]:
    """The value two bars ago if it was the extreme of five bars and beyond a bound; known now."""
    v = [F.lag(x, k).over(w) for k in range(5)]
    top = (v[2] > v[0]) & (v[2] > v[1]) & (v[2] > v[3]) & (v[2] > v[4]) & (v[2] >= high)
    bottom = (v[2] < v[0]) & (v[2] < v[1]) & (v[2] < v[3]) & (v[2] < v[4]) & (v[2] <= low)
    return {"top": F.when(top, v[2]), "bottom": F.when(bottom, v[2])}


def waves(df: DataFrame, a: str, b: str, least: float, keys: list[str] = KEY) -> DataFrame:
    """Segments of one sign of a - b; a wave is one whose extreme is nearer to zero than that of the last segment of its side, which reached ``least``."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    rows = df.where(c(a).isNotNull() & c(b).isNotNull()).withColumn("_s", F.signum(c(a) - c(b))).withColumn("_new", F.when(F.lag("_s").over(w) == c("_s"), 0).otherwise(1))
    rows = rows.withColumn("_seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    segs = rows.groupBy(*keys, "_seg", "_s").agg(F.min("bar_idx").alias("start_idx"), F.max("bar_idx").alias("end_idx"), F.max(F.abs(a)).alias("extreme"))
    before = F.lag("extreme").over(Window.partitionBy(*keys, "_s").orderBy("_seg"))
    out = segs.withColumn("before", before).where((c("before") >= least) & (c("extreme") < c("before")))
    return out.select(*keys, F.when(c("_s") > 0, "bullish").otherwise("bearish").alias("side"), "start_idx", "end_idx", "extreme", "before")


def displacement_candle(w: WindowSpec, n: int = 5, wick: float = 0.36) -> dict[str, Column]:
    """A body above the mean of the bodies before, with short wicks."""
    body = F.abs(c("c") - c("o"))
    mean = F.when(F.count("c").over(w.rowsBetween(-n, -1)) == n, F.avg(body).over(w.rowsBetween(-n, -1)))
    upper, lower = c("h") - F.greatest("o", "c"), F.least("o", "c") - c("l")
    hit = (body > mean) & (upper < body * wick) & (lower < body * wick)
    return {"displaced": F.when(F.coalesce(hit, F.lit(False)), F.when(c("c") > c("o"), "bullish").otherwise("bearish")), "body_ratio": F.try_divide(body, F.nullif(mean, F.lit(0.0)))}


def volume_imbalance(w: WindowSpec) -> dict[str, Column]:
    """Space between two bars' bodies that their wicks close."""
    po, pc, ph, pl = (F.lag(x).over(w) for x in "ochl")
    up = (F.least("o", "c") > F.greatest(po, pc)) & (c("l") <= ph)
    down = (F.greatest("o", "c") < F.least(po, pc)) & (c("h") >= pl)
    return {"imbalance": F.when(up, "bullish").when(down, "bearish"), "imbalance_size": F.when(up, F.least("o", "c") - F.greatest(po, pc)).when(down, F.least(po, pc) - F.greatest("o", "c"))}


def ribbon_events(w: WindowSpec) -> dict[str, Column]:
    """Events of a ribbon ema1 .. ema8 with wt1 and wt2."""
    red_cross, diamond = crossunder("ema1", "ema2", w), crossunder("wt1", "wt2", w)
    candle = (c("c") > c("o")) & (c("c") > c("ema1")) & (c("o") <= c("ema1"))
    yellow = crossover("wt1", "wt2", w) & (c("wt2") < 45) & (c("wt2") > -80)
    return {
        "green_dot": crossover("ema2", "ema8", w), "red_dot": crossunder("ema2", "ema8", w), "red_cross": red_cross, "blue_triangle": crossover("ema2", "ema3", w),
        "red_diamond": diamond, "blood_diamond": diamond & red_cross, "bull_candle": F.coalesce(candle, F.lit(False)), "yellow_cross": F.coalesce(yellow, F.lit(False)),
    }


def islands(df: DataFrame, state: Column, keys: list[str] = KEY) -> DataFrame:
    """Runs of bars in one state, with the length of each: (keys, state, start_idx, end_idx, bars)."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    rows = df.withColumn("state", state).where("state IS NOT NULL")
    rows = rows.withColumn("_new", F.when((F.lag("state").over(w) == c("state")) & (F.lag("bar_idx").over(w) == c("bar_idx") - 1), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run", "state").agg(F.min("bar_idx").alias("start_idx"), F.max("bar_idx").alias("end_idx"), F.count("*").alias("bars")).drop("_run")


def episodes(df: DataFrame, down: Column, up: Column, flag: Column, keys: list[str] = KEY) -> DataFrame:
    """From each crossing down to the next crossing up, and whether a flag stood in between; open ones are left out."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    rows = df.withColumns({"_down": F.coalesce(down, F.lit(False)), "_up": F.coalesce(up, F.lit(False)), "_flag": F.coalesce(flag, F.lit(False))}).where("_down OR _up OR _flag")
    open_ = F.last(F.when(c("_down"), c("bar_idx")).when(c("_up"), F.lit(-1)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    end = rows.withColumn("_open", open_)
    start = F.when(c("_down") & (F.coalesce(c("_open"), F.lit(-1)) < 0), c("bar_idx")).when(c("_open") >= 0, F.lit(None))
    begun = F.last(start, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = end.withColumn("start_idx", F.when((c("_open") >= 0) | c("_down"), begun)).where("start_idx IS NOT NULL")
    got = inside.groupBy(*keys, "start_idx").agg(F.min(F.when(c("_up") & (c("bar_idx") > c("start_idx")), c("bar_idx"))).alias("end_idx"), F.max("_flag").alias("has_flag"))
    return got.where("end_idx IS NOT NULL")


def held_since_reset(reset: Column, condition: Column, w: WindowSpec) -> tuple[Column, Column]:
    """A segment number that grows with each reset, and 1 where the condition holds: a sum of the second over the first counts since the last reset."""
    return F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.when(condition & ~reset, 1).otherwise(0)


def emit(df: DataFrame, family: str, found: dict[str, tuple[Column, str]], price: str = "c", keys: list[str] = KEY) -> DataFrame:
    """Rows of the event schema for conditions by type, each with its side. Events of a bar are known when it has closed."""
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind).alias("type"), F.lit(side).alias("side"))) for kind, (cond, side) in found.items()]))
    rows = df.select(*keys, "bar_idx", "t", closes().alias("known_at"), c(price).alias("price"), F.explode(kinds).alias("_e"))
    return rows.select(*keys, F.lit(family).alias("family"), "_e.type", "_e.side", "bar_idx", "t", "known_at", "price")


def flips(df: DataFrame, direction: str, keys: list[str] = KEY) -> DataFrame:
    """Bars at which a direction differs from the last one there was."""
    w = Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.last(direction, True).over(w)).where(c(direction).isNotNull() & (c("_before") != c(direction))).drop("_before")


def last_flip(df: DataFrame, flipped: DataFrame, direction: str, keys: list[str] = KEY) -> DataFrame:
    """Per key the last flip and how many bars ago it was."""
    end = df.groupBy(*keys).agg(F.max("bar_idx").alias("_end"))
    got = flipped.groupBy(*keys).agg(F.max("bar_idx").alias("flip_idx"), F.max_by(direction, "bar_idx").alias("direction"), F.max_by("c", "bar_idx").alias("flip_price"))
    return end.join(got, keys, "left").withColumn("bars_since", c("_end") - c("flip_idx")).drop("_end")


def recently(condition: Column, n: int, w: WindowSpec) -> Column:
    """Whether the condition held at this bar or one of the n before."""
    return F.coalesce(F.max(F.when(condition, 1).otherwise(0)).over(w.rowsBetween(-n, 0)) == 1, F.lit(False))


def oscillator_marks(w: WindowSpec, q: str = "q", trigger: str = "trigger", fast: str = "fast", slow: str = "slow") -> dict[str, Column]:
    """What the tiers look back on, as columns of a first stage: crossings of the oscillator with its trigger, and of quotients with their bounds."""
    down = crossunder(q, trigger, w)
    return {
        "up": crossover(q, trigger, w), "down": down, "fast_rose": crossover(fast, -0.9, w), "fast_fell": crossunder(fast, 0.9, w), "slow_rose": crossover(slow, -0.9, w),
        "q_rose20": crossover(q, 20, w), "q_rose80": crossover(q, 80, w), "down_at0": down & (c(q) <= 0), "down_at20": down & (c(q) <= 20), "up_below10": crossover(q, trigger, w) & (c(q) < 10),
    }


def oscillator_tiers(w: WindowSpec, q: str = "q", fast: str = "fast", slow: str = "slow", line: str = "line") -> dict[str, Column]:
    """Long tiers and the break down, from ``oscillator_marks``: an upward crossing of the trigger after what each tier asks for lately."""
    up = c("up")
    tiers = {
        "long_lime": (c(slow) <= -0.9) & up & recently(c("fast_rose"), 7, w) & (c(q) <= 20) & recently(c("q_rose20"), 21, w),
        "long_blue": recently(c("down_at0"), 5, w) & up,
        "long_gray": recently(c("down_at20"), 11, w) & up & (c(q) <= 60),
        "long_yellow": (c(slow) <= -0.9) & up,
        "break_short": (c(slow) >= -0.9) & c("down") & recently(c("fast_fell"), 7, w) & (c(q) >= 99) & recently(c("q_rose80"), 21, w),
        "boom": (c(fast) <= -0.9) & up & recently(c("slow_rose"), 7, w),
        "long_enter4": (c(q) <= 20) & recently(c("up_below10"), 5, w) & up,
        "long_enter": up & (c(q) < c(line)),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in tiers.items()}


def excursions(df: DataFrame, x: str, ceiling: float, floor: float, keys: list[str] = KEY) -> DataFrame:
    """Bars at which a series comes to a ceiling or a floor: (keys, bar_idx, type)."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    before = F.lag(x).over(w)
    kind = F.when((c(x) >= ceiling) & (before < ceiling), "ceiling").when((c(x) <= floor) & (before > floor), "floor")
    return df.withColumn("type", kind).where("type IS NOT NULL").select(*keys, "bar_idx", "type")


def round_trips(marks: DataFrame, most: int, keys: list[str] = KEY) -> DataFrame:
    """Each floor with the first ceiling after it, at most so many bars on."""
    ahead = marks.where("type = 'ceiling'").select(*keys, c("bar_idx").alias("_i"), c("bar_idx").alias("ceiling_idx"))
    got = asof(marks.where("type = 'floor'"), ahead, keys, "bar_idx", "_i", ["ceiling_idx"], "forward", strict=True, span=4096)
    return got.where(c("ceiling_idx_asof") - c("bar_idx") <= most).select(*keys, c("bar_idx").alias("floor_idx"), c("ceiling_idx_asof").alias("ceiling_idx"), (c("ceiling_idx_asof") - c("bar_idx")).alias("gap"))

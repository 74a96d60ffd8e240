"""Pivots, structure breaks, order blocks and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import KEY, surrogate
from ..sources.tables import kept
from .joins import first_hit

c = F.col


def pivot(x: str, left: int, right: int, w: WindowSpec, high: bool = True, left_strict: bool = True, right_strict: bool = True) -> Column:
    """The value ``right`` bars ago if it was the extreme of its neighbours; known now. Strict sides allow no tie. Both sides must be complete."""
    at = F.lag(x, right).over(w)
    before, after = w.rowsBetween(-right - left, -right - 1), w.rowsBetween(1 - right, 0)
    edge = F.max if high else F.min
    beats = lambda other, strict: (at > other if strict else at >= other) if high else (at < other if strict else at <= other)
    complete = (F.count(x).over(before) == left) & (F.count(x).over(after) == right)
    return F.when(complete & beats(edge(x).over(before), left_strict) & beats(edge(x).over(after), right_strict), at)


def swings(bars: DataFrame, size: int, tag: str, keys: list[str] = KEY) -> DataFrame:
    """Swing levels: a bar that beats the ``size`` bars after it starts a leg; where the leg turns, that bar is a swing high or low.

    Adds per bar ``{tag}_high``, ``{tag}_high_idx`` and the same for lows (last known ones).
    """
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1 - size, 0)
    old_h, old_l = F.lag("h", size).over(w), F.lag("l", size).over(w)
    leg = F.when(old_h > F.max("h").over(after), 0).when(old_l < F.min("l").over(after), 1)
    rows = bars.withColumns({"_leg": leg, "_oh": old_h, "_ol": old_l}).withColumn("_leg", F.coalesce(F.last("_leg", True).over(whole), F.lit(0)))
    turned = F.col("_leg") - F.coalesce(F.lag("_leg").over(w), F.lit(0))
    rows = rows.withColumn("_turn", turned)
    out = {}
    for name, turn, value in (("high", -1, "_oh"), ("low", 1, "_ol")):
        out[f"{tag}_{name}"] = F.last(F.when(c("_turn") == turn, c(value)), True).over(whole)
        out[f"{tag}_{name}_idx"] = F.last(F.when(c("_turn") == turn, c("bar_idx") - size), True).over(whole)
    return rows.withColumns(out).drop("_leg", "_oh", "_ol", "_turn")


def breaks(bars: DataFrame, tag: str, trigger_high: str = "c", trigger_low: str = "c", unlike: str | None = None, keys: list[str] = KEY) -> DataFrame:
    """Structure breaks over ``swings``: the first cross of each swing level, up or down.

    A break with the bias is a BOS, one against it a CHOCH; the bias is that before the bar, read once for both sides. With ``unlike``, crosses of a level equal to that swing's are left out
    and do not use the level up. Adds ``bias_after`` by bar in ``trend``.
    """
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    rows = bars
    for name, trig in (("high", trigger_high), ("low", trigger_low)):
        level = f"{tag}_{name}"
        up = name == "high"
        now, then = c(trig), F.lag(trig).over(w)
        past = F.lag(level).over(w)
        crossed = (now > c(level)) & (then <= past) if up else (now < c(level)) & (then >= past)
        if unlike:
            crossed &= ~c(level).eqNullSafe(c(f"{unlike}_{name}"))
        rows = rows.withColumn(f"_x{name}", F.coalesce(crossed, F.lit(False)))
        order = F.row_number().over(Window.partitionBy(*keys, f"{level}_idx", f"_x{name}").orderBy("bar_idx"))
        rows = rows.withColumn(f"_b{name}", c(f"_x{name}") & (order == 1))
    after = F.when(c("_blow"), -1).when(c("_bhigh"), 1)
    rows = rows.withColumn("_bias", F.last(after, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("_bias").over(w), F.lit(0))
    rows = rows.withColumn("_before", before)
    kinds = F.array_compact(F.array(
        F.when(c("_bhigh"), F.struct(F.lit("bullish").alias("side"), F.when(c("_before") == -1, "CHOCH").otherwise("BOS").alias("type"), c(f"{tag}_high").alias("level"), c(f"{tag}_high_idx").alias("pivot_idx"))),
        F.when(c("_blow"), F.struct(F.lit("bearish").alias("side"), F.when(c("_before") == 1, "CHOCH").otherwise("BOS").alias("type"), c(f"{tag}_low").alias("level"), c(f"{tag}_low_idx").alias("pivot_idx"))),
    ))
    return rows.select(*keys, "bar_idx", "t", F.lit(tag).alias("scope"), F.explode(kinds).alias("_e")).select(*keys, "bar_idx", "t", "scope", "_e.*")


def trend(bars: DataFrame, broken: DataFrame, name: str = "bias", keys: list[str] = KEY) -> DataFrame:
    """Each bar with the side of the last break up to it (a bar that breaks both ways ends bearish)."""
    sides = broken.groupBy(*keys, "bar_idx").agg(F.min(F.when(c("side") == "bullish", 1).otherwise(-1)).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    return bars.join(sides, [*keys, "bar_idx"], "left").withColumn(name, F.last("_s", True).over(w)).drop("_s")


def equal_levels(pivots: DataFrame, tolerance: str, share: float = 0.1, keys: list[str] = KEY) -> DataFrame:
    """Pivots (price, kind high or low) within a share of ``tolerance`` (a column) of the one before of their kind."""
    w = Window.partitionBy(*keys, "kind").orderBy("bar_idx")
    rows = pivots.withColumns({"before": F.lag("price").over(w), "before_idx": F.lag("bar_idx").over(w)})
    return rows.where(F.abs(c("price") - c("before")) < share * c(tolerance)).withColumn("side", F.when(c("kind") == "high", "EQH").otherwise("EQL"))


def order_blocks(broken: DataFrame, bars: DataFrame, high: str = "h", low: str = "l", keys: list[str] = KEY, block: int = 512) -> DataFrame:
    """For each break the bar between its pivot and itself with the lowest low (bullish) or highest high (bearish), the earliest on ties.

    Adds ``block_id``, ``origin_idx``, ``bar_low``, ``bar_high``, ``created_idx``. Bars and breaks meet in blocks of bars, and blocks are reduced before they are put together.
    """
    ev = broken.withColumn("block_id", surrogate(*keys, "scope", "side", "bar_idx")).withColumn("_blk", F.explode(F.sequence(F.floor(c("pivot_idx") / block), F.floor((c("bar_idx") - 1) / block))))
    own = bars.select(*keys, c("bar_idx").alias("_i"), F.floor(c("bar_idx") / block).alias("_blk"), c(high).alias("_h"), c(low).alias("_l"), c("h").alias("_bh"), c("l").alias("_bl"))
    inside = ev.join(own, [*keys, "_blk"]).where((c("_i") >= c("pivot_idx")) & (c("_i") < c("bar_idx")))
    rank = F.struct(F.when(c("side") == "bullish", c("_l")).otherwise(-c("_h")).alias("v"), c("_i").alias("i"))
    best = inside.groupBy("block_id").agg(F.min_by(F.struct("_i", "_bl", "_bh"), rank).alias("_o"))
    return broken.withColumn("block_id", surrogate(*keys, "scope", "side", "bar_idx")).join(best, "block_id").select("*", c("_o._i").alias("origin_idx"), c("_o._bl").alias("bar_low"), c("_o._bh").alias("bar_high"), c("bar_idx").alias("created_idx")).drop("_o")


def mitigated(blocks: DataFrame, bars: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """With ``mitigated_idx``: the first bar from creation on whose low (high) is beyond a bullish (bearish) block's far edge."""
    bull = first_hit(blocks.where("side = 'bullish'"), bars, keys, "created_idx", "bar_low", "l", False, "block_id")
    bear = first_hit(blocks.where("side = 'bearish'"), bars, keys, "created_idx", "bar_high", "h", True, "block_id")
    return blocks.join(bull.unionByName(bear).withColumnRenamed("hit_idx", "mitigated_idx"), "block_id", "left")


def fair_value_gaps(bars: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Runs of three-bar gaps of one side on consecutive bars, merged: bounds are those of the run, size and first bar those of its first gap.

    ``touch_idx``: the first later bar that enters the gap; ``break_idx``: the first one that closes it.
    """
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    h2, l2 = F.lag("h", 2).over(w), F.lag("l", 2).over(w)
    found = bars.withColumns({"_up": c("l") > h2, "_down": c("h") < l2, "_h2": h2, "_l2": l2})
    gaps = found.withColumn("side", F.when(c("_up"), "bullish").when(c("_down"), "bearish")).where("side IS NOT NULL")
    gaps = gaps.withColumns({"bottom": F.when(c("_up"), c("_h2")).otherwise(c("h")), "top": F.when(c("_up"), c("l")).otherwise(c("_l2"))})
    s = Window.partitionBy(*keys, "side").orderBy("bar_idx")
    gaps = gaps.withColumn("_new", F.when(F.lag("bar_idx").over(s) == c("bar_idx") - 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(s.rowsBetween(Window.unboundedPreceding, 0)))
    zones = gaps.groupBy(*keys, "side", "_run").agg(F.min("bottom").alias("bottom"), F.max("top").alias("top"), F.min("bar_idx").alias("created_idx"), F.max("bar_idx").alias("last_idx"), F.min_by(c("top") - c("bottom"), "bar_idx").alias("size"), F.count("*").alias("merged_bars")).drop("_run")
    zones = zones.withColumn("gap_id", surrogate(*keys, "side", "created_idx")).withColumn("_from", c("last_idx") + 1)
    bull, bear = zones.where("side = 'bullish'"), zones.where("side = 'bearish'")
    touch = first_hit(bull, bars, keys, "_from", "top", "l", False, "gap_id").unionByName(first_hit(bear, bars, keys, "_from", "bottom", "h", True, "gap_id")).withColumnRenamed("hit_idx", "touch_idx")
    broke = first_hit(bull, bars, keys, "_from", "bottom", "l", False, "gap_id").unionByName(first_hit(bear, bars, keys, "_from", "top", "h", True, "gap_id")).withColumnRenamed("hit_idx", "break_idx")
    return zones.join(touch, "gap_id", "left").join(broke, "gap_id", "left").drop("_from")


def threshold_gaps(bars: DataFrame, times: float = 2.0, keys: list[str] = KEY) -> DataFrame:
    """Three-bar gaps whose middle bar moved by more than ``times`` the mean absolute move so far."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    move = F.lag("c").over(w) - F.lag("o").over(w)
    rel = F.try_divide(move, F.nullif(F.lag("o").over(w), F.lit(0.0)))
    rows = bars.withColumns({"_m": rel, "_h2": F.lag("h", 2).over(w), "_l2": F.lag("l", 2).over(w), "_c1": F.lag("c").over(w)})
    mean = F.avg(F.abs("_m")).over(w.rowsBetween(Window.unboundedPreceding, 0)) * times
    rows = rows.withColumn("_mean", mean)
    up = (c("l") > c("_h2")) & (c("_c1") > c("_h2")) & (c("_m") > c("_mean"))
    down = (c("h") < c("_l2")) & (c("_c1") < c("_l2")) & (-c("_m") > c("_mean"))
    return rows.withColumn("side", F.when(up, "bullish").when(down, "bearish")).where("side IS NOT NULL").select(*keys, "bar_idx", "t", "side", F.when(up, c("_h2")).otherwise(c("h")).alias("bottom"), F.when(up, c("l")).otherwise(c("_l2")).alias("top"))


def balanced_ranges(gaps: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Where a gap overlaps the last gap of the other side: the overlap of both."""
    w = Window.partitionBy(*keys).orderBy("created_idx", "side").rowsBetween(Window.unboundedPreceding, -1)
    other = {s: F.last(F.when(c("side") == s, F.struct("bottom", "top", "created_idx")), True).over(w) for s in ("bullish", "bearish")}
    rows = gaps.withColumn("_o", F.when(c("side") == "bullish", other["bearish"]).otherwise(other["bullish"]))
    low, high = F.greatest(c("bottom"), c("_o.bottom")), F.least(c("top"), c("_o.top"))
    return rows.select(*keys, "side", "created_idx", c("_o.created_idx").alias("other_idx"), low.alias("low"), high.alias("high")).where("other_idx IS NOT NULL AND low < high")


def failed_breaks(broken: DataFrame, bars: DataFrame, within: int, keys: list[str] = KEY) -> DataFrame:
    """Breaks with the first close back through their level within so many bars, if there is one."""
    ev = broken.withColumns({"break_id": surrogate(*keys, "scope", "side", "bar_idx"), "_from": c("bar_idx") + 1})
    down = first_hit(ev.where("side = 'bullish'"), bars, keys, "_from", "level", "c", False, "break_id", within - 1)
    up = first_hit(ev.where("side = 'bearish'"), bars, keys, "_from", "level", "c", True, "break_id", within - 1)
    return ev.join(down.unionByName(up).withColumnRenamed("hit_idx", "reclaim_idx"), "break_id", "left").drop("_from")


def race(events: DataFrame, bars: DataFrame, id_col: str, start: str, up_level: str, down_level: str, keys: list[str] = KEY, most: int | None = None) -> DataFrame:
    """Which of two levels is passed first: up, down, both (in one bar) or neither."""
    up = first_hit(events, bars, keys, start, up_level, "h", True, id_col, most).withColumnRenamed("hit_idx", "up_idx")
    down = first_hit(events, bars, keys, start, down_level, "l", False, id_col, most).withColumnRenamed("hit_idx", "down_idx")
    out = events.join(up, id_col, "left").join(down, id_col, "left")
    first = F.when(c("up_idx").isNull() & c("down_idx").isNull(), "neither").when(c("down_idx").isNull() | (c("up_idx") < c("down_idx")), "up").when(c("up_idx").isNull() | (c("down_idx") < c("up_idx")), "down").otherwise("both")
    return out.withColumn("first", first)


def near_earlier(pivots: DataFrame, band: str, keys: list[str] = KEY, most: int = 200) -> DataFrame:
    """How many earlier pivots of the same kind, up to ``most`` bars back, lie within a pivot's ``band`` of its price; bars meet in blocks."""
    a = pivots.withColumn("_cell", F.explode(F.array(F.floor(c("bar_idx") / most), F.floor(c("bar_idx") / most) - 1)))
    b = pivots.select(*keys, "kind", F.floor(c("bar_idx") / most).alias("_cell"), c("bar_idx").alias("_i"), c("price").alias("_p"))
    pair = a.join(b, [*keys, "kind", "_cell"], "left").withColumn("_near", (c("_i") < c("bar_idx")) & (c("_i") >= c("bar_idx") - most) & (F.abs(c("_p") - c("price")) <= c(band)))
    return pair.groupBy(*pivots.columns).agg(F.sum(F.when(c("_near"), 1).otherwise(0)).alias("near")).withColumn("label", F.when(c("near") > 0, "clustered").otherwise("isolated"))


#: Retracements.
FIBONACCI = [0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]


def retracements(points: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Levels between each pair of successive marked points."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    rows = points.select(*keys, "bar_idx", "price", F.lag("price").over(w).alias("before")).where("before IS NOT NULL")
    return rows.withColumn("share", F.explode(F.array(*[F.lit(x) for x in FIBONACCI]))).withColumn("level", c("price") + (c("before") - c("price")) * c("share"))


def divergences(df: DataFrame, osc: str, high: float, low: float, keys: list[str] = KEY) -> DataFrame:
    """Regular and hidden divergences between the price and an oscillator at its five-bar fractals; the fractal before is the last one known two bars ago."""
    from .events import fractal

    w = Window.partitionBy(*keys).orderBy("bar_idx")
    rows = df.withColumns(fractal(osc, w, high, low)).withColumns({"_ph": F.lag("h", 2).over(w), "_pl": F.lag("l", 2).over(w)})
    held = w.rowsBetween(Window.unboundedPreceding, -3)
    for name, price in (("top", "_ph"), ("bottom", "_pl")):
        rows = rows.withColumns({f"_{name}_v": F.last(name, True).over(held), f"_{name}_p": F.last(F.when(c(name).isNotNull(), c(price)), True).over(held)})
    found = F.array_compact(F.array(
        F.when((c("top") < c("_top_v")) & (c("_ph") > c("_top_p")), F.struct(F.lit("regular").alias("kind"), F.lit("bearish").alias("side"))),
        F.when((c("bottom") > c("_bottom_v")) & (c("_pl") < c("_bottom_p")), F.struct(F.lit("regular").alias("kind"), F.lit("bullish").alias("side"))),
        F.when((c("top") > c("_top_v")) & (c("_ph") < c("_top_p")), F.struct(F.lit("hidden").alias("kind"), F.lit("bearish").alias("side"))),
        F.when((c("bottom") < c("_bottom_v")) & (c("_pl") > c("_bottom_p")), F.struct(F.lit("hidden").alias("kind"), F.lit("bullish").alias("side"))),
    ))
    return rows.select(*keys, c("bar_idx").alias("confirm_idx"), (c("bar_idx") - 2).alias("bar_idx"), F.explode(found).alias("_d")).select(*keys, "confirm_idx", "bar_idx", "_d.*")


def pair_divergences(pivots: DataFrame, most: int = 60, keys: list[str] = KEY) -> DataFrame:
    """Successive pivots (kind, bar_idx, price, osc) at most so far apart between which price and oscillator moved apart, with the line's slope."""
    w = Window.partitionBy(*keys, "kind").orderBy("bar_idx")
    rows = pivots.withColumns({"_i": F.lag("bar_idx").over(w), "_p": F.lag("price").over(w), "_o": F.lag("osc").over(w)}).where(c("bar_idx") - c("_i") <= most)
    bear = (c("kind") == "high") & (c("price") > c("_p")) & (c("osc") < c("_o"))
    bull = (c("kind") == "low") & (c("price") < c("_p")) & (c("osc") > c("_o"))
    return rows.withColumn("side", F.when(bear, "bearish").when(bull, "bullish")).where("side IS NOT NULL").select(*keys, "side", c("_i").alias("from_idx"), "bar_idx", ((c("osc") - c("_o")) / (c("bar_idx") - c("_i"))).alias("slope"))


def sight_divergences(df: DataFrame, oscillators: list[str], left: int = 5, reach: int = 100, most: int = 10, hidden: bool = False, keys: list[str] = KEY) -> DataFrame:
    """Divergences of several oscillators at each bar against up to ``most`` recorded pivots within ``reach`` bars, one row per bar, side and oscillator.

    A pivot counts if neither the oscillator nor the close crosses the straight line from it to the bar, and the next bar, which is the one given, moves the divergence's way in either. The nearest
    pivot that qualifies is kept. A line from a pivot is clear if it is no steeper than those to all bars between, so each pivot looks forward once, with the least slope so far, for all
    oscillators together; bars and pivots meet in cells of ``reach`` bars.
    """
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    values = ["c", *oscillators]
    bars = df.select(*keys, "bar_idx", *values, *[(F.lead(v).over(w) - c(v)).alias(f"_ahead_{v}") for v in values], pivot("c", left, left, w).alias("_top"), pivot("c", left, left, w, False).alias("_bot"))
    bars = kept(bars.withColumns({f"_n{p}": F.count(p).over(upto) for p in ("_top", "_bot")}))
    cell = lambda i: F.floor(i / reach)
    out = None
    for side, mark, sign in (("bullish", "_bot", 1), ("bearish", "_top", -1)):
        at = bars.where(c(mark).isNotNull()).select(*keys, (c("bar_idx") - left).alias("_p"), c(f"_n{mark}").alias("_q"))
        start = bars.select(*keys, c("bar_idx").alias("_p"), *[c(v).alias(f"_p_{v}") for v in values])
        points = at.join(start, [*keys, "_p"]).withColumn("_cell", F.explode(F.array(cell(c("_p")), cell(c("_p")) + 1)))
        seen = bars.select(*keys, "bar_idx", *values, *[f"_ahead_{v}" for v in values], c(f"_n{mark}").alias("_known"), cell(c("bar_idx")).alias("_cell"))
        pairs = points.join(seen, [*keys, "_cell"]).where((c("bar_idx") > c("_p")) & (c("bar_idx") <= c("_p") + reach))
        before = Window.partitionBy(*keys, "_p").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, -1)
        slope = {v: sign * (c(v) - c(f"_p_{v}")) / (c("bar_idx") - c("_p")) for v in values}
        pairs = pairs.withColumns({f"_least_{v}": F.min(slope[v]).over(before) for v in values})
        pairs = pairs.where((c("bar_idx") - c("_p") > left) & (c("_known") - c("_q") < most) & (c("_least_c") >= slope["c"]))

        def diverges(osc: str, sign: int = sign, slope: dict[str, Column] = slope) -> Column:
            rises, falls = sign * c(osc) > sign * c(f"_p_{osc}"), sign * c("c") < sign * c("_p_c")
            if hidden:
                rises, falls = sign * c(osc) < sign * c(f"_p_{osc}"), sign * c("c") > sign * c("_p_c")
            moves = (sign * c("_ahead_c") > 0) | (sign * c(f"_ahead_{osc}") > 0)
            return moves & rises & falls & (c(f"_least_{osc}") >= slope[osc])

        kinds = F.array_compact(F.array(*[F.when(F.coalesce(diverges(o), F.lit(False)), o) for o in oscillators]))
        got = pairs.select(*keys, "bar_idx", "_p", F.explode(kinds).alias("oscillator")).groupBy(*keys, "bar_idx", "oscillator").agg(F.max("_p").alias("pivot_idx"))
        got = got.select(*keys, (c("bar_idx") + 1).alias("bar_idx"), F.lit(side).alias("side"), "oscillator", "pivot_idx")
        out = got if out is None else out.unionByName(got)
    return out


def badges(found: DataFrame, least: int = 3, keys: list[str] = KEY) -> DataFrame:
    """Bars and sides on which at least so many oscillators diverge."""
    return found.groupBy(*keys, "bar_idx", "side").agg(F.countDistinct("oscillator").alias("n")).where(c("n") >= least)


def level_breaks(bars: DataFrame, level: str, level_id: str, below: bool, trigger: str = "c", keys: list[str] = KEY) -> DataFrame:
    """The first bar at which the trigger passes each level that stands (columns ``level`` and ``level_id``, carried forward): (keys, bar_idx, level, level_id)."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    now, before = c(trigger), F.lag(trigger).over(w)
    crossed = (now < c(level)) & (before >= c(level)) if below else (now > c(level)) & (before <= c(level))
    rows = bars.withColumn("_x", crossed).where("_x")
    first = F.row_number().over(Window.partitionBy(*keys, level_id).orderBy("bar_idx"))
    return rows.withColumn("_k", first).where("_k = 1").select(*keys, "bar_idx", c(level).alias("level"), c(level_id).alias("level_id"))


def pivot_low_breaks(bars: DataFrame, left: int, right: int, keys: list[str] = KEY) -> DataFrame:
    """Closes below the last confirmed pivot low, one for each pivot."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("_p", pivot("l", left, right, w, False))
    rows = rows.withColumns({"_level": F.last("_p", True).over(whole), "_id": F.last(F.when(c("_p").isNotNull(), c("bar_idx")), True).over(whole)})
    return level_breaks(rows, "_level", "_id", True, keys=keys)


def zigzag(pivots: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Pivots (bar_idx, kind, price) by runs of one kind, each with the extreme of its run so far: (keys, bar_idx, kind, run, level). Of equal bars the low comes first."""
    w = Window.partitionBy(*keys).orderBy("bar_idx", F.col("kind") == "high")
    rows = pivots.withColumn("_new", F.when(F.lag("kind").over(w) == c("kind"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sofar = Window.partitionBy(*keys, "run").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(c("kind") == "high", F.max("price").over(sofar)).otherwise(F.min("price").over(sofar))
    return rows.select(*keys, "bar_idx", "kind", "run", level.alias("level"))


def structure_shifts(bars: DataFrame, points: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Closes beyond the last zigzag level of a side that turn the direction: the last such close was of the other side."""
    at = points.groupBy(*keys, "bar_idx").agg(*[F.max(F.when(c("kind") == k, c("level"))).alias(f"_{k}") for k in ("high", "low")])
    rows = bars.join(at, [*keys, "bar_idx"], "left")
    whole = Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    found = None
    for k, side in (("high", "bullish"), ("low", "bearish")):
        carried = rows.withColumns({"_level": F.last(f"_{k}", True).over(whole), "_id": F.last(F.when(c(f"_{k}").isNotNull(), c("bar_idx")), True).over(whole)})
        one = level_breaks(carried, "_level", "_id", k == "low", keys=keys).select(*keys, "bar_idx", "level", F.lit(side).alias("side"))
        found = one if found is None else found.unionByName(one)
    before = F.lag("side").over(Window.partitionBy(*keys).orderBy("bar_idx", "side"))
    return found.withColumn("_before", before).where("_before IS NULL OR _before <> side").drop("_before")


def breaker_blocks(broken: DataFrame, bars: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Order blocks of bodies: the opposite extreme since the swing; ``breaker_idx``, the first close beyond its far edge, and ``removed_idx``, the first close back through the other one."""
    bodies = bars.withColumns({"h": F.greatest("o", "c"), "l": F.least("o", "c")})
    blocks = kept(order_blocks(broken, bodies, keys=keys).withColumn("_from", c("created_idx") + 1))
    bull, bear = blocks.where("side = 'bullish'"), blocks.where("side = 'bearish'")
    broke = first_hit(bull, bars, keys, "_from", "bar_low", "c", False, "block_id").unionByName(first_hit(bear, bars, keys, "_from", "bar_high", "c", True, "block_id")).withColumnRenamed("hit_idx", "breaker_idx")
    turned = kept(blocks.join(broke, "block_id", "left"))
    bull, bear = turned.where("side = 'bullish' AND breaker_idx IS NOT NULL"), turned.where("side = 'bearish' AND breaker_idx IS NOT NULL")
    back = first_hit(bull, bars, keys, "breaker_idx", "bar_high", "c", True, "block_id").unionByName(first_hit(bear, bars, keys, "breaker_idx", "bar_low", "c", False, "block_id")).withColumnRenamed("hit_idx", "removed_idx")
    return turned.join(back, "block_id", "left").drop("_from")

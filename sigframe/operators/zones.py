"""Zones, rectangles of price and time, and what bars do to them.

A zone has ``zone_id``, keys, ``side``, ``lo``, ``hi`` (equal for a line), ``from_idx`` and ``to_idx`` (NULL while it is open).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY
from ..sources.tables import kept
from .joins import first_hit, in_intervals

c = F.col
WIDTH = 256


def _beside(zones: DataFrame, bars: DataFrame, keys: list[str], near: Column) -> DataFrame:
    """Bars of each zone's life for which the condition holds, with the close before."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    own = bars.select(*keys, c("bar_idx").alias("i"), "h", "l", "c", F.lag("c").over(w).alias("before"), F.max("bar_idx").over(Window.partitionBy(*keys)).alias("end"))
    return in_intervals(own, zones, keys, "i", "_from", "to_idx", WIDTH, near)


def _runs(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Numbers runs of consecutive bars in each zone."""
    by = ["zone_id", *(extra or [])]
    w = Window.partitionBy(*by).orderBy("i")
    return rows.withColumn("_run", c("i") - F.row_number().over(w))


def interactions(zones: DataFrame, bars: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Runs of bars that touch a zone: (zone_id, start_idx, end_idx, bars_count, max_penetration, approach, outcome, ongoing).

    Penetration is in price for a line, as a share of the height for a box. A line is broken when the run's last close lies on the far side of the approach, a box when the run holds its last bar.
    """
    touch = (c("l") <= c("hi")) & (c("h") >= c("lo"))
    rows = _runs(_beside(zones.withColumn("_from", c("from_idx") + 1), bars, keys, touch))
    got = rows.groupBy("zone_id", *keys, "side", "lo", "hi", "to_idx", "end", "_run").agg(F.min("i").alias("start_idx"), F.max("i").alias("end_idx"), F.count("*").alias("bars_count"), F.min("l").alias("_l"), F.max("h").alias("_h"), F.min_by("before", "i").alias("_before"), F.max_by("c", "i").alias("_close"))
    above = F.when(c("_before") > c("hi"), "above").when(c("_before") < c("lo"), "below").otherwise("inside")
    line, height = c("lo") == c("hi"), F.nullif(c("hi") - c("lo"), F.lit(0.0))
    depth = F.when(c("approach") == "below", c("_h") - c("lo")).otherwise(c("hi") - c("_l"))
    through = F.when(c("approach") == "below", c("_close") > c("hi")).otherwise(c("_close") < c("lo"))
    inside = c("to_idx").isNotNull() & (c("end_idx") >= c("to_idx"))
    out = got.withColumn("approach", above).withColumn("max_penetration", F.when(line, F.greatest(depth, F.lit(0.0))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(depth, height)))))
    out = out.withColumn("outcome", F.when(F.when(line, through).otherwise(inside), "broken").otherwise("held")).withColumn("ongoing", c("end_idx") == c("end"))
    return out.select("zone_id", *keys, "side", "start_idx", "end_idx", "bars_count", "max_penetration", "approach", "outcome", "ongoing")


def near_misses(zones: DataFrame, bars: DataFrame, share: float = 0.005, keys: list[str] = KEY) -> DataFrame:
    """Runs of bars that come within a share of the price of a zone on one side without touching it."""
    above, below = c("l") - c("hi"), c("lo") - c("h")
    gap = F.greatest(above, below)
    rows = _beside(zones.withColumn("_from", c("from_idx") + 1), bars, keys, (gap > 0) & (gap <= share * F.when(above > 0, c("hi")).otherwise(c("lo"))))
    rows = rows.withColumns({"where": F.when(above > 0, "above").otherwise("below"), "_gap": F.try_divide(gap, F.when(above > 0, c("hi")).otherwise(c("lo")))})
    got = _runs(rows, ["where"]).groupBy("zone_id", *keys, "where", "end", "_run").agg(F.min("i").alias("start_idx"), F.max("i").alias("end_idx"), F.count("*").alias("bars_count"), F.min("_gap").alias("closest"))
    return got.withColumn("ongoing", c("end_idx") == c("end")).drop("_run", "end")


def lives(touches: DataFrame, zones: DataFrame, life: int = 200) -> DataFrame:
    """How long each zone lasts if every touch gives it ``life`` more bars: up to the first gap that is longer."""
    times = zones.select("zone_id", c("from_idx").alias("i")).unionByName(touches.select("zone_id", c("end_idx").alias("i"))).distinct()
    w = Window.partitionBy("zone_id").orderBy("i")
    cut = times.withColumn("_gap", F.lead("i").over(w) - c("i"))
    return cut.groupBy("zone_id").agg(F.min(F.when((c("_gap") > life) | c("_gap").isNull(), c("i"))).alias("_last")).select("zone_id", (c("_last") + life).alias("expires_idx"))


def sweeps(levels: DataFrame, bars: DataFrame, within: int = 10, keys: list[str] = KEY) -> DataFrame:
    """Levels (level_id, side EQH or EQL, level, from_idx) with the bar that takes them and the close that comes back within so many bars."""
    high, low = levels.where("side = 'EQH'"), levels.where("side = 'EQL'")
    taken = first_hit(high, bars, keys, "from_idx", "level", "h", True, "level_id").unionByName(first_hit(low, bars, keys, "from_idx", "level", "l", False, "level_id")).withColumnRenamed("hit_idx", "sweep_idx")
    swept = kept(levels.join(taken, "level_id", "left"))  # the joins below read it several times
    back = first_hit(swept.where("side = 'EQH'"), bars, keys, "sweep_idx", "level", "c", False, "level_id", within).unionByName(first_hit(swept.where("side = 'EQL'"), bars, keys, "sweep_idx", "level", "c", True, "level_id", within)).withColumnRenamed("hit_idx", "reversal_idx")
    out = swept.join(back, "level_id", "left")
    status = F.when(c("sweep_idx").isNull(), "untouched").when(c("reversal_idx").isNull(), "swept").otherwise("swept_reversed")
    return out.withColumns({"status": status, "bars_to_sweep": c("sweep_idx") - c("from_idx"), "bars_to_reversal": c("reversal_idx") - c("sweep_idx")})


def _standing(zones: DataFrame, bars: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    own = bars.select(*keys, "bar_idx", *columns)
    return in_intervals(own, zones.withColumn("_from", c("from_idx") + 1).select(*keys, "zone_id", "side", "lo", "hi", "_from", "to_idx"), keys, "bar_idx", "_from", "to_idx", WIDTH)


def nearby(zones: DataFrame, bars: DataFrame, atr: str, share: float = 0.5, keys: list[str] = KEY) -> DataFrame:
    """Bars with whether a standing zone lies within a share of the ATR above or below the close, and whether one holds it."""
    pairs = _standing(zones, bars, keys, "c", atr)
    got = pairs.groupBy(*keys, "bar_idx").agg(F.max((c("lo") > c("c")) & (c("lo") - c("c") <= share * c(atr))).alias("zone_above"), F.max((c("hi") < c("c")) & (c("c") - c("hi") <= share * c(atr))).alias("zone_below"), F.max((c("lo") <= c("c")) & (c("c") <= c("hi"))).alias("in_zone"))
    flags = ["zone_above", "zone_below", "in_zone"]
    return bars.join(got, [*keys, "bar_idx"], "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def nearest_state(zones: DataFrame, bars: DataFrame, atr: str, near: float = 1.0, keys: list[str] = KEY) -> DataFrame:
    """Bars with the state of the nearest standing zone: inside, on top (within a tenth of the ATR), near, far or none."""
    pairs = _standing(zones, bars, keys, "c", atr)
    distance = F.greatest(c("lo") - c("c"), c("c") - c("hi"), F.lit(0.0))
    got = pairs.groupBy(*keys, "bar_idx").agg(F.min(distance).alias("_d"))
    rows = bars.join(got, [*keys, "bar_idx"], "left")
    state = F.when(c("_d").isNull(), "none").when(c("_d") == 0, "inside").when(c("_d") <= 0.1 * c(atr), "on_top").when(c("_d") <= near * c(atr), "near").otherwise("far")
    return rows.withColumn("gap_state", state).drop("_d")


def standing_counts(zones: DataFrame, bars: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Bars with the number of standing zones by side and by place."""
    got = _standing(zones, bars, keys, "c").groupBy(*keys, "bar_idx").agg(F.count(F.when(c("side") == "bullish", 1)).alias("bull_zones"), F.count(F.when(c("side") == "bearish", 1)).alias("bear_zones"), F.count(F.when(c("lo") > c("c"), 1)).alias("zones_above"), F.count(F.when(c("hi") < c("c"), 1)).alias("zones_below"))
    return bars.join(got, [*keys, "bar_idx"], "left").fillna(0, ["bull_zones", "bear_zones", "zones_above", "zones_below"])


def returns_after(zones: DataFrame, bars: DataFrame, ahead: int = 12, keys: list[str] = KEY) -> DataFrame:
    """Zones that ended: the first bar after that comes back to them, and the signed move of the close over the next bars."""
    ended = zones.where("to_idx IS NOT NULL").withColumn("_from", c("to_idx") + 1)
    up = first_hit(ended.where("side = 'bullish'"), bars, keys, "_from", "lo", "h", True, "zone_id")
    down = first_hit(ended.where("side = 'bearish'"), bars, keys, "_from", "hi", "l", False, "zone_id")
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    moves = bars.select(*keys, c("bar_idx").alias("hit_idx"), (F.lead("c", ahead).over(w) - c("c")).alias("_move"))
    out = ended.join(up.unionByName(down), "zone_id").join(moves, [*keys, "hit_idx"])
    return out.withColumn("reaction", F.when(c("side") == "bullish", -c("_move")).otherwise(c("_move"))).drop("_from", "_move")


def level_set(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Horizontal levels and boxes, rounded and each once."""
    return drawn.select(*keys, F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi")).distinct()


def cells_to_lines(cells: DataFrame, table: str) -> DataFrame:
    """Rows of a table of cells (row, col, text) as lines of text."""
    return cells.groupBy(table, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " | ").alias("line"))


def levels_near(levels: DataFrame, at: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """Levels (lo, hi, side, known_at, ended_at) known at each instant and within a share of its price, with signed distance; the side of ended ones is turned.

    Prices are positive. Both sides meet in logarithmic cells of price as wide as the share, each pair in the first cell that both have.
    """
    width = -math.log(1 - share)
    cell = lambda x: F.floor(F.ln(x) / width)
    boxes = levels.where("lo > 0").withColumn("_first", cell(c("lo"))).withColumn("_cell", F.explode(F.sequence(c("_first"), F.greatest(c("_first"), cell(c("hi"))))))
    marks = at.where("price > 0").withColumn("_low", cell(c("price")) - 1).withColumn("_cell", F.explode(F.sequence(c("_low"), c("_low") + 2)))
    pairs = marks.join(boxes, [*keys, "_cell"]).where(c("_cell") == F.greatest("_low", "_first")).where(c("known_at") <= c("at")).drop("_cell", "_low", "_first")
    distance = F.when(c("lo") > c("price"), c("lo") - c("price")).when(c("hi") < c("price"), c("hi") - c("price")).otherwise(0.0)
    rows = pairs.withColumn("distance", distance / c("price")).where(F.abs("distance") <= share)
    over = c("ended_at") <= c("at")
    return rows.withColumn("polarity", F.when(over, F.when(c("side") == "bullish", "bearish").otherwise("bullish")).otherwise(c("side")))


def projected_crossings(lines: DataFrame, bars: DataFrame, value: str, reach: int, keys: list[str] = KEY) -> DataFrame:
    """Crossings of a series with lines (line_id, x0, y0, slope) drawn on for ``reach`` bars, numbered."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    own = bars.select(*keys, "bar_idx", c(value).alias("_v"), F.lag(value).over(w).alias("_u"))
    pairs = in_intervals(own, lines.withColumns({"_from": c("x0") + 1, "_end": c("x0") + reach}), keys, "bar_idx", "_from", "_end", WIDTH)
    y = lambda i: c("y0") + c("slope") * (i - c("x0"))
    crossed = (F.signum(c("_v") - y(c("bar_idx"))) * F.signum(c("_u") - y(c("bar_idx") - 1))) < 0
    return pairs.where(crossed).withColumn("n", F.row_number().over(Window.partitionBy("line_id").orderBy("bar_idx"))).select(*keys, "line_id", "bar_idx", "n")


def rejections(zones: DataFrame, bars: DataFrame, strict: bool = True, keys: list[str] = KEY) -> DataFrame:
    """Bars whose high goes through the top of a zone that stands (lo, hi, from_idx, to_idx) and whose close is back below its bottom (strict) or its top: (zone_id, keys, bar_idx)."""
    inside = in_intervals(bars.select(*keys, "bar_idx", "h", "c"), zones.select("zone_id", *keys, "lo", "hi", "from_idx", "to_idx"), keys, "bar_idx", "from_idx", "to_idx", 256)
    back = c("c") < (c("lo") if strict else c("hi"))
    return inside.where((c("h") > c("hi")) & back).select("zone_id", *keys, "bar_idx")


#: Bounds of the buckets of a distance in ATR.
DISTANCES = [1.0, 3.0]


def nearest_pool(events: DataFrame, pools: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Events (event_id, side, bar_idx, price, atr) with the distance, in ATR, to the nearest pool (level, from_idx, to_idx) that stands in the event's direction, and its bucket."""
    pair = in_intervals(events, pools.select(*keys, "level", "from_idx", "to_idx"), keys, "bar_idx", "from_idx", "to_idx", 256)
    ahead = F.when(c("side") == "bullish", c("level") - c("price")).otherwise(c("price") - c("level"))
    near = pair.withColumn("_d", ahead).where("_d > 0").groupBy("event_id").agg(F.min("_d").alias("_d"))
    out = events.join(near, "event_id", "left").withColumn("distance", F.try_divide(c("_d"), c("atr"))).drop("_d")
    bucket = F.when(c("distance").isNull(), "none").when(c("distance") < DISTANCES[0], "near").when(c("distance") < DISTANCES[1], "middle").otherwise("far")
    return out.withColumn("bucket", bucket)

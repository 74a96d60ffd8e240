"""What happened after an event: forward returns, barriers, exits and costs.

Events have ``event_id``, keys, ``bar_idx`` (the signal's bar), ``side``. The entry is the open of the next bar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY
from ..sources.tables import kept
from .joins import first_hit

c = F.col
HORIZON = 200


def sign(side: str = "side") -> Column:
    return F.when(c(side).isin("bullish", "long"), 1).otherwise(-1)


def forward_return(bars: DataFrame, n: int, clamp: bool = False, keys: list[str] = KEY) -> DataFrame:
    """Bars with ``fwd``, the move of the close over the next n bars; ``clamp`` takes the last bar where fewer follow."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    later = F.lead("c", n).over(w)
    return bars.withColumn("fwd", (F.coalesce(later, F.last("c").over(w.rowsBetween(0, n))) if clamp else later) - c("c"))


def excursion(bars: DataFrame, n: int, keys: list[str] = KEY) -> DataFrame:
    """Bars with the greatest rise and fall within the next n bars, and how soon."""
    w = Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(1, n)
    return bars.withColumns({
        "rise": F.max("h").over(w) - c("c"), "rise_bars": -F.max(F.struct(c("h"), -c("bar_idx"))).over(w)["col2"] - c("bar_idx"),
        "fall": c("c") - F.min("l").over(w), "fall_bars": F.min(F.struct(c("l"), c("bar_idx"))).over(w)["bar_idx"] - c("bar_idx"),
    })


def entries(events: DataFrame, bars: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Events with the next bar's open; those without a next bar go."""
    nxt = bars.select(*keys, (c("bar_idx") - 1).alias("bar_idx"), c("bar_idx").alias("entry_idx"), c("o").alias("entry"))
    return events.join(nxt, [*keys, "bar_idx"])


def barriers(trades: DataFrame, bars: DataFrame, target_r: float = 1.0, horizon: int = HORIZON, on_timeout: str = "drop", keys: list[str] = KEY) -> DataFrame:
    """Trades (event_id, side, entry_idx, entry, stop) with the first of stop, target and time-out.

    Risk is the distance of the stop, and must be above 0. A bar that reaches both counts as stopped. on_timeout: "drop", "close" (the last close of the horizon), "open".
    """
    s = sign()
    rows = trades.withColumn("risk", s * (c("entry") - c("stop"))).where("risk > 0").withColumn("target", c("entry") + s * c("risk") * target_r)
    # A level is reached by touching it: first_hit is strict, so it is asked for the values negated and the order kept by a hair's breadth of none.
    reach = bars.select(*keys, "bar_idx", "h", "l", "c")
    long_, short = rows.where(s == 1), rows.where(s == -1)
    touch = lambda df, level, value, above: _touched(df, reach, keys, level, value, above, horizon)
    stop = touch(long_, "stop", "l", False).unionByName(touch(short, "stop", "h", True)).withColumnRenamed("hit_idx", "stop_idx")
    goal = touch(long_, "target", "h", True).unionByName(touch(short, "target", "l", False)).withColumnRenamed("hit_idx", "target_idx")
    out = rows.join(stop, "event_id", "left").join(goal, "event_id", "left")
    stopped = c("stop_idx").isNotNull() & (c("target_idx").isNull() | (c("stop_idx") <= c("target_idx")))
    out = out.withColumn("exit_reason", F.when(stopped, "stop").when(c("target_idx").isNotNull(), "target").otherwise("timeout")).withColumn("exit_idx", F.when(stopped, c("stop_idx")).otherwise(c("target_idx"))).withColumn("exit", F.when(stopped, c("stop")).when(c("target_idx").isNotNull(), c("target")))
    if on_timeout == "drop":
        out = out.where("exit_reason <> 'timeout'")
    elif on_timeout == "close":
        ends = bars.groupBy(*keys).agg(F.max("bar_idx").alias("_end"))
        out = out.join(ends, keys).withColumn("exit_idx", F.coalesce("exit_idx", F.least(c("entry_idx") + horizon, c("_end")))).drop("_end")
        out = out.join(bars.select(*keys, c("bar_idx").alias("exit_idx"), c("c").alias("_c")), [*keys, "exit_idx"], "left").withColumn("exit", F.coalesce("exit", "_c")).drop("_c")
    return out.withColumns({"r": s * (c("exit") - c("entry")) / c("risk"), "pnl_pct": s * (c("exit") - c("entry")) / c("entry") * 100, "bars_held": c("exit_idx") - c("entry_idx")})


def _touched(trades: DataFrame, bars: DataFrame, keys: list[str], level: str, value: str, above: bool, horizon: int) -> DataFrame:
    """First bar that reaches a level, equality included."""
    tie = 1e-12
    moved = trades.withColumn("_level", c(level) * (1 - tie if above else 1 + tie))
    return first_hit(moved, bars, keys, "entry_idx", "_level", value, above, "event_id", horizon)


def risk_stop(kind: str, k: float = 1.0, atr: str = "atr", edge: str = "edge", swing: str = "swing") -> Column:
    """A stop ``k`` ATR away, at a zone's far edge, or at the last swing."""
    return {"atr": c("entry") - sign() * k * c(atr), "edge": c(edge), "swing": c(swing)}[kind]


def slipped(trades: DataFrame, slip: float, taker_pct: float, maker_pct: float, atr: str = "atr") -> DataFrame:
    """Net result with slippage in ATR at the entry and at stops, and a maker's fee where a target fills."""
    s = sign()
    entry = c("entry") + s * slip * c(atr)
    out = c("exit") - F.when(c("exit_reason") == "target", 0.0).otherwise(slip) * s * c(atr)
    fee = taker_pct + F.when(c("exit_reason") == "target", maker_pct).otherwise(taker_pct)
    return trades.withColumn("net_pct", s * (out - entry) / entry * 100 - fee)


def costed(pnl: str, hours: str, taker_pct: float, funding_pct_8h: float, mode: str = "pro_rata") -> Column:
    """Fees on both sides and funding, by the hour or by whole periods of eight hours."""
    periods = c(hours) / 8 if mode == "pro_rata" else F.floor(c(hours) / 8)
    return c(pnl) - 2 * taker_pct - funding_pct_8h * periods


def flip_trades(flips: DataFrame, bars: DataFrame, side: str = "side", long_only: bool = False, entry_filter: Column | None = None, keys: list[str] = KEY) -> DataFrame:
    """From the open after each flip to the open after the next; the last one stays open at the last close."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    end = bars.groupBy(*keys).agg(F.max("bar_idx").alias("_end"), F.max_by("c", "bar_idx").alias("_close"))
    opens = lambda at, name: bars.select(*keys, (c("bar_idx") - 1).alias(at), c("o").alias(name))
    rows = flips.withColumn("next_idx", F.lead("bar_idx").over(w)).join(opens("bar_idx", "entry"), [*keys, "bar_idx"]).join(opens("next_idx", "_next"), [*keys, "next_idx"], "left").join(end, keys)
    rows = rows.withColumns({"open_at_end": c("_next").isNull(), "exit": F.coalesce("_next", "_close"), "bars_held": F.coalesce(c("next_idx"), c("_end")) - c("bar_idx")})
    rows = rows.where(entry_filter) if entry_filter is not None else rows
    rows = rows.where(sign(side) == 1) if long_only else rows
    return rows.withColumn("pnl_pct", sign(side) * (c("exit") - c("entry")) / c("entry") * 100).drop("_next", "_end", "_close")


def trailing_stop(trades: DataFrame, bars: DataFrame, distance: str, horizon: int = HORIZON, keys: list[str] = KEY) -> DataFrame:
    """Trades with the first bar that falls ``distance`` behind the best price before it."""
    own = bars.select(*keys, c("bar_idx").alias("i"), "h", "l")
    cells = trades.withColumn("_cell", F.explode(F.sequence(F.floor(c("entry_idx") / horizon), F.floor((c("entry_idx") + horizon) / horizon))))
    pairs = cells.join(own.withColumn("_cell", F.floor(c("i") / horizon)), [*keys, "_cell"]).where((c("i") >= c("entry_idx")) & (c("i") <= c("entry_idx") + horizon))
    w = Window.partitionBy("event_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.max(sign() * F.when(sign() == 1, c("h")).otherwise(c("l"))).over(w), sign() * c("entry"))
    stop = F.coalesce(best, sign() * c("entry")) - c(distance)
    worst = sign() * F.when(sign() == 1, c("l")).otherwise(c("h"))
    hit = pairs.withColumns({"_stop": stop, "_worst": worst}).where("_worst <= _stop").groupBy("event_id").agg(F.min("i").alias("exit_idx"), F.min_by(sign() * c("_stop"), "i").alias("exit"))
    return trades.join(hit, "event_id", "left")


def structural_exits(
    trades: DataFrame, bars: DataFrame, marks: DataFrame, target_r: float, rules: dict[str, tuple[bool, bool]], horizon: int = HORIZON, keys: list[str] = KEY
) -> DataFrame:
    """Each trade once for each rule (whether it has a target, whether it ends at an opposite mark): (.., rule, exit_reason, exit_idx, exit).

    In one bar the stop comes first, then the target, then the mark, which exits at the bar's close; so does a time-out.
    """
    s = sign()
    rows = kept(opposite_exit(trades.withColumn("_goal", c("entry") + s * c("risk") * target_r), marks, keys, horizon))
    long_, short = rows.where(s == 1), rows.where(s == -1)
    reach = bars.select(*keys, "bar_idx", "h", "l")
    first = lambda level, low, high: _touched(long_, reach, keys, level, low[0], low[1], horizon).unionByName(_touched(short, reach, keys, level, high[0], high[1], horizon))
    stops = first("stop", ("l", False), ("h", True)).withColumnRenamed("hit_idx", "_stop_idx")
    goals = first("_goal", ("h", True), ("l", False)).withColumnRenamed("hit_idx", "_goal_idx")
    ends = bars.groupBy(*keys).agg(F.max("bar_idx").alias("_end"))
    met = rows.join(stops, "event_id", "left").join(goals, "event_id", "left").join(ends, keys)
    none = F.lit(None).cast("long")
    each = F.array(*[F.struct(F.lit(k).alias("rule"), (c("_goal_idx") if goal else none).alias("g"), (c("opposite_idx") if mark else none).alias("m")) for k, (goal, mark) in rules.items()])
    met = met.withColumn("_r", F.explode(each))
    early = lambda a, *others: a.isNotNull() & reduce(Column.__and__, [o.isNull() | (a <= o) for o in others])
    stop, goal, mark = c("_stop_idx"), c("_r.g"), c("_r.m")
    why = F.when(early(stop, goal, mark), "stop").when(early(goal, mark), "target").when(mark.isNotNull(), "opposing").otherwise("timeout")
    met = met.withColumns({"rule": c("_r.rule"), "exit_reason": why})
    at = F.when(c("exit_reason") == "stop", stop).when(c("exit_reason") == "target", goal).when(c("exit_reason") == "opposing", mark)
    met = met.withColumn("exit_idx", F.coalesce(at, F.least(c("entry_idx") + horizon, c("_end"))))
    met = met.join(bars.select(*keys, c("bar_idx").alias("exit_idx"), c("c").alias("_close")), [*keys, "exit_idx"])
    price = F.when(c("exit_reason") == "stop", c("stop")).when(c("exit_reason") == "target", c("_goal")).otherwise(c("_close"))
    return met.withColumn("exit", price).drop("_goal", "_stop_idx", "_goal_idx", "_end", "_r", "_close", "opposite_idx")


def zone_origin_exits(trades: DataFrame, bars: DataFrame, zones: DataFrame, horizon: int = HORIZON, keys: list[str] = KEY) -> DataFrame:
    """Trades (bar_idx, entry_idx, entry, stop) out at the close of the bar where the first zone of the other side after the signal has its origin, at the stop before that, or after
    ``horizon`` bars. Trades whose exit would not lie after the entry are left out."""
    s = sign()
    marks = zones.select(*keys, c("side"), c("origin_idx").alias("bar_idx"))
    own = trades.withColumns({"_entry": c("entry_idx"), "entry_idx": c("bar_idx")})  # looked for from the signal's bar on
    rows = opposite_exit(own, marks, keys, horizon + 1).withColumn("entry_idx", c("_entry")).drop("_entry")
    ends = bars.groupBy(*keys).agg(F.max("bar_idx").alias("_end"))
    latest = F.least(c("entry_idx") + horizon, c("_end"))
    rows = kept(rows.join(ends, keys).withColumn("_natural", F.least(F.coalesce("opposite_idx", latest), latest)).where("_natural > entry_idx").drop("_end", "opposite_idx"))
    reach = bars.select(*keys, "bar_idx", "h", "l")
    stops = _touched(rows.where(s == 1), reach, keys, "stop", "l", False, horizon).unionByName(_touched(rows.where(s == -1), reach, keys, "stop", "h", True, horizon))
    out = rows.join(stops, "event_id", "left").withColumn("_hit", c("hit_idx") <= c("_natural"))
    out = out.join(bars.select(*keys, c("bar_idx").alias("_natural"), c("c").alias("_close")), [*keys, "_natural"])
    hit = F.coalesce("_hit", F.lit(False))
    return out.withColumns({"exit_idx": F.when(hit, c("hit_idx")).otherwise(c("_natural")), "exit": F.when(hit, c("stop")).otherwise(c("_close"))}).drop("_natural", "_hit", "_close", "hit_idx")


def decline_first(events: DataFrame, bars: DataFrame, k: float, within: int, atr: str = "atr", keys: list[str] = KEY) -> DataFrame:
    """Events (event_id, bar_idx, c, atr) with ``decline_first``: 1 if the price falls ``k`` ATR below the close before it rises as far above it, 0 if it rises first, null if neither
    comes within so many bars. A bar that does both counts as a fall."""
    rows = events.withColumns({"entry_idx": c("bar_idx") + 1, "_down": c("c") - k * c(atr), "_up": c("c") + k * c(atr)})
    reach = bars.select(*keys, "bar_idx", "h", "l")
    down = _touched(rows, reach, keys, "_down", "l", False, within - 1).withColumnRenamed("hit_idx", "_d")
    up = _touched(rows, reach, keys, "_up", "h", True, within - 1).withColumnRenamed("hit_idx", "_u")
    out = events.join(down, "event_id", "left").join(up, "event_id", "left")
    first = F.when(c("_d").isNull() & c("_u").isNull(), F.lit(None)).when(c("_u").isNull() | (c("_d") <= c("_u")), 1).otherwise(0)
    return out.withColumn("decline_first", first).drop("_d", "_u")


def opposite_exit(trades: DataFrame, marks: DataFrame, keys: list[str] = KEY, horizon: int = HORIZON) -> DataFrame:
    """Trades with the first mark (side, bar_idx) of the other side after the entry, within the horizon."""
    m = marks.select(*keys, c("side").alias("_side"), c("bar_idx").alias("_i"), F.floor(c("bar_idx") / horizon).alias("_cell"))
    cells = trades.withColumn("_cell", F.explode(F.sequence(F.floor(c("entry_idx") / horizon), F.floor((c("entry_idx") + horizon) / horizon))))
    hit = cells.join(m, [*keys, "_cell"]).where((c("_side") != c("side")) & (c("_i") > c("entry_idx")) & (c("_i") <= c("entry_idx") + horizon)).groupBy("event_id").agg(F.min("_i").alias("opposite_idx"))
    return trades.join(hit, "event_id", "left")


def reclaim_entries(zones: DataFrame, bars: DataFrame, within: int = 12, keys: list[str] = KEY) -> DataFrame:
    """A zone's first touch, then the first close back outside it on its own side within so many bars: the entry is the bar after."""
    z = zones.withColumn("_from", c("from_idx") + 1)
    bull, bear = z.where("side = 'bullish'"), z.where("side = 'bearish'")
    touch = first_hit(bull, bars, keys, "_from", "hi", "l", False, "zone_id").unionByName(first_hit(bear, bars, keys, "_from", "lo", "h", True, "zone_id")).withColumnRenamed("hit_idx", "touch_idx")
    touched = kept(z.join(touch, "zone_id"))  # the joins below read it several times
    back = first_hit(touched.where("side = 'bullish'"), bars, keys, "touch_idx", "hi", "c", True, "zone_id", within).unionByName(first_hit(touched.where("side = 'bearish'"), bars, keys, "touch_idx", "lo", "c", False, "zone_id", within)).withColumnRenamed("hit_idx", "reclaim_idx")
    return touched.join(back, "zone_id").withColumn("entry_idx", c("reclaim_idx") + 1).drop("_from")


def resting_limits(signals: DataFrame, bars: DataFrame, k: float, wait: int = 24, atr: str = "atr", keys: list[str] = KEY) -> DataFrame:
    """Limits ``k`` ATR beyond the signal's close, armed for so many bars, and the bar that fills each."""
    rows = signals.withColumns({"limit": c("c") - sign() * k * c(atr), "_from": c("bar_idx") + 1})
    fill = first_hit(rows.where(sign() == 1), bars, keys, "_from", "limit", "l", False, "event_id", wait - 1).unionByName(first_hit(rows.where(sign() == -1), bars, keys, "_from", "limit", "h", True, "event_id", wait - 1))
    return rows.join(fill.withColumnRenamed("hit_idx", "fill_idx"), "event_id", "left").drop("_from")


def settled(trades: DataFrame, bars: DataFrame, margin: int = 2, keys: list[str] = KEY) -> DataFrame:
    """Resolved if the exit lies at least ``margin`` bars before the last bar, else open."""
    end = bars.groupBy(*keys).agg(F.max("bar_idx").alias("_end"))
    return trades.join(end, keys).withColumn("status", F.when(c("exit_idx") <= c("_end") - margin, "resolved").otherwise("open")).drop("_end")


def scaled_return(bars: DataFrame, n: int, atr: str = "atr", keys: list[str] = KEY) -> DataFrame:
    """Bars with ``fwd_atr``, the move over the next n bars in ATR."""
    return forward_return(bars, n, keys=keys).withColumn("fwd_atr", F.try_divide(c("fwd"), c(atr))).drop("fwd")


def regime_holds(broken: DataFrame, bars: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Trades from a break that turns the bias (type CHOCH) to the next one of the other side, or to the stop at its ``stop``, whichever comes first.

    The entry is the next bar's open, the exit the open after the opposite break or the stop's price; a trade with neither is open.
    """
    w = Window.partitionBy(*keys).orderBy("bar_idx", "side")
    turns = broken.where("type = 'CHOCH'").withColumn("next_idx", F.lead("bar_idx").over(w))
    rows = entries(turns, bars, keys).where((c("entry") - c("stop")) * sign() > 0)
    long_, short = rows.where(sign() == 1), rows.where(sign() == -1)
    hit = first_hit(long_, bars, keys, "entry_idx", "stop", "l", False, "event_id").unionByName(first_hit(short, bars, keys, "entry_idx", "stop", "h", True, "event_id")).withColumnRenamed("hit_idx", "stop_idx")
    out = rows.join(hit, "event_id", "left").join(bars.select(*keys, (c("bar_idx") - 1).alias("next_idx"), c("o").alias("_next")), [*keys, "next_idx"], "left")
    stopped = c("stop_idx").isNotNull() & (c("_next").isNull() | (c("stop_idx") <= c("next_idx")))
    why = F.when(stopped, "stop").when(c("_next").isNotNull(), "opposite").otherwise("open")
    out = out.withColumns({"exit_reason": why, "exit": F.when(stopped, c("stop")).otherwise(c("_next")), "exit_idx": F.when(stopped, c("stop_idx")).when(c("_next").isNotNull(), c("next_idx") + 1)})
    return out.withColumn("pnl_pct", sign() * (c("exit") - c("entry")) / c("entry") * 100).drop("_next", "next_idx", "stop_idx")


def retest_entries(zones: DataFrame, bars: DataFrame, away: int = 3, within: int = 200, keys: list[str] = KEY) -> DataFrame:
    """The first touch of a zone at least ``away`` bars after its start and at most ``within``: the entry is at the zone's near edge, in that bar."""
    z = zones.withColumn("_from", c("from_idx") + away)
    bull, bear = z.where("side = 'bullish'"), z.where("side = 'bearish'")
    hit = first_hit(bull, bars, keys, "_from", "hi", "l", False, "zone_id", within - away).unionByName(first_hit(bear, bars, keys, "_from", "lo", "h", True, "zone_id", within - away))
    return z.join(hit.withColumnRenamed("hit_idx", "entry_idx"), "zone_id").withColumn("entry", F.when(c("side") == "bullish", c("hi")).otherwise(c("lo"))).drop("_from")


def level_reactions(levels: DataFrame, bars: DataFrame, band: str, most: int = 200, keys: list[str] = KEY) -> DataFrame:
    """Levels (level_id, level, from_idx) met from below: at the first high above each, whether the price then goes a ``band`` beyond it or back below it first."""
    met = kept(levels.join(first_hit(levels, bars, keys, "from_idx", "level", "h", True, "level_id"), "level_id"))
    met = met.withColumns({"_from": c("hit_idx") + 1, "_up": c("level") + c(band), "_down": c("level") - c(band)})
    up = first_hit(met, bars, keys, "_from", "_up", "h", True, "level_id", most).withColumnRenamed("hit_idx", "up_idx")
    down = first_hit(met, bars, keys, "_from", "_down", "l", False, "level_id", most).withColumnRenamed("hit_idx", "down_idx")
    out = met.join(up, "level_id", "left").join(down, "level_id", "left")
    kind = F.when(c("up_idx").isNull() & c("down_idx").isNull(), "neither").when(c("down_idx").isNull() | (c("up_idx") < c("down_idx")), "continuation").when(c("up_idx").isNull() | (c("down_idx") < c("up_idx")), "reversal").otherwise("both")
    return out.withColumn("reaction", kind).drop("_from", "_up", "_down")

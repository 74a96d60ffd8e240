"""Putting series, events and zones of several timeframes together. Nothing is seen before it is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LADDER, SECONDS
from .joins import asof, nearest

c = F.col
#: Seconds by which as-of joins cut a key's rows among tasks.
SPAN = 4_000_000


def snapshot(base: DataFrame, rungs: dict[str, DataFrame], values: list[str], at: str = "at", keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Rows with the last closed bar's values of every rung as ``{rung}_{value}``, and ``missing``, the rungs that have none yet.

    Each rung is a table with keys, ``t`` and the values; a bar that opened at t is seen from t plus its seconds on.
    """
    rows = base
    for name, rung in rungs.items():
        seen = rung.select(*keys, (c("t") + SECONDS[name]).alias("known_at"), *values)
        rows = asof(rows, seen, keys, at, "known_at", values, span=SPAN)
        rows = rows.withColumnsRenamed({f"{v}_asof": f"{name}_{v}" for v in values} | {"known_at_asof": f"{name}_known_at"})
    gone = F.array_compact(F.array(*[F.when(c(f"{n}_known_at").isNull(), F.lit(n)) for n in rungs]))
    return rows.withColumn("missing", F.array_join(gone, ","))


def confluence(zones: DataFrame, pairs: DataFrame) -> DataFrame:
    """(zone_id, timeframes, zones, same_timeframe) from pairs (a, b) of zones that meet."""
    t = zones.select(c("zone_id").alias("b"), c("timeframe").alias("_tb"))
    own = zones.select(c("zone_id").alias("a"), c("timeframe").alias("_ta"))
    got = pairs.select("a", "b").join(t, "b").join(own, "a").groupBy(c("a").alias("zone_id")).agg(F.countDistinct(F.when(c("_ta") != c("_tb"), c("_tb"))).alias("timeframes"), F.count("*").alias("zones"), F.count(F.when(c("_ta") == c("_tb"), 1)).alias("same_timeframe"))
    return zones.select("zone_id").join(got, "zone_id", "left").fillna(0)


def recurrence(zones: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many zones of its own timeframe and side a zone meets, itself included."""
    n = pairs.groupBy(c("a").alias("zone_id")).agg(F.count("*").alias("_n"))
    return zones.select("zone_id").join(n, "zone_id", "left").select("zone_id", (F.coalesce("_n", F.lit(0)) + 1).alias("recurrence"))


def best_before(blocks: DataFrame, tiers: DataFrame, within: int, share: float, priority: dict[str, int], keys: list[str]) -> DataFrame:
    """Blocks (block_id, bar_idx, price) with the tier of highest priority in the bars before and near their price; bars meet in cells."""
    cell = F.floor(c("bar_idx") / within)
    a = blocks.withColumn("_cell", F.explode(F.array(cell, cell - 1)))
    rank = F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])
    b = tiers.select(*keys, cell.alias("_cell"), c("bar_idx").alias("_i"), c("price").alias("_p"), "type")
    pair = a.join(b, [*keys, "_cell"]).where((c("_i") <= c("bar_idx")) & (c("_i") >= c("bar_idx") - within) & (F.abs(c("_p") / c("price") - 1) <= share))
    best = pair.groupBy("block_id").agg(F.min_by("type", F.struct(rank[c("type")], "type")).alias("tier"))
    return blocks.join(best, "block_id", "left")


def nested_depth(events: DataFrame, others: DataFrame, bars_back: int = 10, share: float = 0.01, key: str = "instrument") -> DataFrame:
    """For each event the number of slower rungs with an event at most so many of that rung's bars before it and near its price.

    Events of one instrument meet in cells as long as the look-back of the rung they are on.
    """
    seconds = F.create_map(*[x for n, s in SECONDS.items() for x in (F.lit(n), F.lit(s))])
    slower = F.array(*[F.struct(F.lit(n).alias("rung"), F.lit(s * bars_back).cast("long").alias("reach")) for n, s in SECONDS.items()])
    a = events.withColumn("_s", F.explode(F.filter(slower, lambda x: x["reach"] > seconds[c("timeframe")] * bars_back))).withColumn("_cell", F.explode(F.array(F.floor(c("t") / c("_s.reach")), F.floor(c("t") / c("_s.reach")) - 1))).withColumn("_rung", c("_s.rung"))
    reach = seconds[c("timeframe")] * bars_back
    b = others.select(key, c("timeframe").alias("_rung"), c("t").alias("_t"), c("price").alias("_p"), "side", F.floor(c("t") / reach).alias("_cell"))
    pair = a.join(b, [key, "_rung", "_cell", "side"]).where((c("_t") <= c("t")) & (c("_t") >= c("t") - c("_s.reach")) & (F.abs(c("_p") / c("price") - 1) <= share))
    n = pair.groupBy("event_id").agg(F.countDistinct("_rung").alias("depth"))
    return events.join(n, "event_id", "left").fillna(0, ["depth"])


def confirmations(events: DataFrame, others: DataFrame, rungs: list[str], within_bars: int, key: str = "instrument") -> DataFrame:
    """On how many of the rungs named an event of the same side lies within so many of that rung's bars."""
    rows = events
    for r in rungs:
        seen = others.where(c("timeframe") == r).select(key, "side", c("known_at").alias("_w"), F.lit(1).alias("_on"))
        rows = nearest(rows, seen, [key, "side"], "known_at", "_w", SECONDS[r] * within_bars, ["_on"])
        rows = rows.withColumn(f"_on_{r}", F.coalesce("_on_near", F.lit(0))).drop("_w_near", "_on_near")
    return rows.withColumn("confirmations", sum((c(f"_on_{r}") for r in rungs), F.lit(0))).drop(*[f"_on_{r}" for r in rungs])


def cascades(flips: DataFrame, rungs: list[str], window: float = 1.0, key: str = "instrument") -> DataFrame:
    """From each flip of the first rung the first flip of its direction on each next rung, within ``window`` bars of the slower of both rungs.

    (key, direction, start_t, steps, depth, known_at, stalled_at). A flip is known at its bar's close.
    """
    known = lambda r: flips.where(c("timeframe") == r).select(key, "direction", (c("t") + SECONDS[r]).alias("known"), c("t").alias("flip_t"))
    step = lambda r, t, k: F.struct(F.lit(r).alias("rung"), t.alias("t"), k.alias("known_at"))
    rows = known(rungs[0]).select(key, "direction", c("flip_t").alias("start_t"), c("known").alias("at"), F.array(step(rungs[0], c("flip_t"), c("known"))).alias("steps"), F.lit(None).cast("string").alias("stalled_at"))
    for before, r in zip(rungs, rungs[1:], strict=False):
        reach = int(max(SECONDS[before], SECONDS[r]) * window)
        rows = asof(rows, known(r), [key, "direction"], "at", "known", ["flip_t"], "forward", strict=True, span=SPAN)
        hit = c("stalled_at").isNull() & (c("known_asof") <= c("at") + reach)
        hit = F.coalesce(hit, F.lit(False))
        rows = rows.withColumns({"_hit": hit, "steps": F.when(hit, F.concat("steps", F.array(step(r, c("flip_t_asof"), c("known_asof"))))).otherwise(c("steps"))})
        rows = rows.withColumns({"stalled_at": F.coalesce("stalled_at", F.when(~c("_hit"), F.lit(r))), "at": F.when(c("_hit"), c("known_asof")).otherwise(c("at"))}).drop("_hit", "known_asof", "flip_t_asof")
    return rows.withColumn("depth", F.size("steps")).withColumnRenamed("at", "known_at").where("depth >= 2")


def maximal(found: DataFrame, key: str = "instrument") -> DataFrame:
    """Of the cascades that end in the same step the longest, the earliest of equals."""
    by = [key, "direction", "_end", "known_at"]
    rows = found.withColumn("_end", F.element_at("steps", -1)["rung"])
    best = rows.groupBy(*by).agg(F.max_by(F.struct("start_t", "steps", "depth", "stalled_at"), F.struct(c("depth"), -c("start_t"))).alias("_b"))
    return best.select(key, "direction", "known_at", "_b.*")


def agreement_depth(states: DataFrame, rungs: list[str]) -> DataFrame:
    """How many rungs from the slowest on share its state without a break (columns ``{rung}_state``)."""
    values = F.array(*[c(f"{r}_state") for r in rungs])
    run = F.aggregate(values, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & (x == values[0]), 1).otherwise(0)).alias("n"), (a["on"] & F.coalesce(x == values[0], F.lit(False))).alias("on")), lambda a: a["n"])
    return states.withColumn("depth", F.coalesce(run, F.lit(0)))


def latest_matrix(df: DataFrame, value: Column, rows: str = "instrument") -> DataFrame:
    """The last value of each row on every rung, a column for each."""
    return df.groupBy(rows).pivot("timeframe", [n for n, _, _ in LADDER]).agg(F.max_by(value, "t"))


def watchlist(latest: DataFrame, rules: DataFrame) -> DataFrame:
    """Latest values with the first rule (rule, metric, low, high, call, rank) of their metric that holds, in the order of ranks. Rules are a short configuration."""
    pairs = latest.join(F.broadcast(rules), "metric", "left").withColumn("_ok", (c("value") >= c("low")) & (c("value") < c("high")))
    got = pairs.groupBy("instrument", "metric").agg(F.first("value").alias("value"), F.min(F.when(c("_ok"), F.struct("rank", "rule", "call"))).alias("_r"))
    return got.select("instrument", "metric", "value", c("_r.rule").alias("rule"), F.coalesce("_r.call", F.lit("neutral")).alias("call"))


def dedupe_entries(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each entry, the first in order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(c("_k") == 1).drop("_k")


def state_gate(events: DataFrame, states: DataFrame, t: str, state: str, wanted: Column, keys: list[str], span: int = SPAN) -> DataFrame:
    """Events for which the last state known at their time (column ``state``) is as ``wanted`` says of ``{state}_asof``."""
    seen = states.select(*keys, c(t).alias("_st"), c(state))
    return asof(events, seen, keys, t, "_st", [state], span=span).where(wanted).drop("_st_asof")


def structure_position(zones: DataFrame, lines: DataFrame, broken: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """Zones (from_idx, lo, hi) with their place against the swing low that stands at their start (``lines``: bar_idx, line), and the type of the last break up to then."""
    line = lines.select(*keys, c("bar_idx").alias("_i"), c("line"))
    rows = asof(zones, line, keys, "from_idx", "_i", ["line"], span=4096).drop("_i_asof")
    last = broken.groupBy(*keys, c("bar_idx").alias("_b")).agg(F.max("type").alias("type"))
    rows = asof(rows, last, keys, "from_idx", "_b", ["type"], span=4096).drop("_b_asof")
    band = tolerance * c("line_asof")
    place = F.when(c("line_asof").isNull(), "none").when(F.abs((c("lo") + c("hi")) / 2 - c("line_asof")) <= band, "at").when((c("lo") + c("hi")) / 2 < c("line_asof"), "below").otherwise("above")
    return rows.withColumn("position", place).withColumnRenamed("type_asof", "structure").drop("line_asof")


def candle_flags(bars: DataFrame, rungs: dict[str, DataFrame], sign: str, at: str = "at") -> DataFrame:
    """Bars with ``flag``: up where the oscillator's sign (a column) is up and the last closed candle of every rung is too, down likewise."""
    seen = snapshot(bars, {n: r.withColumn("way", F.signum(c("c") - c("o"))) for n, r in rungs.items()}, ["way"], at)
    ways = F.array(c(sign), *[c(f"{n}_way") for n in rungs])
    up = F.forall(ways, lambda x: F.coalesce(x == 1, F.lit(False)))
    down = F.forall(ways, lambda x: F.coalesce(x == -1, F.lit(False)))
    return seen.withColumn("flag", F.when(up, "up").when(down, "down"))

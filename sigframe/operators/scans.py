"""Scans of long series whose state depends on all rows before, shared among tasks.

A series is cut into blocks. All blocks are run side by side from a guessed state; then each block whose guess differs from the state that the block before it
ended in is run again from that state, until no guess differs. The first block's guess is right, so when guesses and ends agree all are right. Most states forget what
was long ago (a band is passed, a zone expires), so a few rounds are enough; a state that never forgets takes a round for each block, and is still right.

In a task the blocks are rows of matrices: a step is made for all of them at once, with arrays, and not row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursive import atr
from ..functions.windows import bounded, three_means
from ..schema import KEY
from ..sources.tables import kept

#: (state, inputs of one step) to (state, outputs); arrays of a row for each block, NaN where there is nothing.
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
BLOCK = 512
#: Blocks that are stepped together.
TOGETHER = 2048


def _columns(batch: pa.RecordBatch, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of n columns as (block, step, column), NaN beyond a block's end, and the blocks' lengths."""
    lists = [batch.column(first + k) for k in range(n)]
    length = np.diff(lists[0].offsets.to_numpy()) if len(lists[0]) else np.zeros(0, int)
    out = np.full((len(length), int(length.max(initial=0)), n), np.nan)
    inside = np.arange(out.shape[1])[None, :] < length[:, None]
    for k, x in enumerate(lists):
        out[inside, k] = x.flatten().to_numpy(zero_copy_only=False)
    return out, length


def _run(batch: pa.RecordBatch, width: int, n: int, step: Step, outputs: int, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """The states at the blocks' ends and, if kept, the outputs of every step."""
    x, length = _columns(batch, 2, n)
    state = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).copy()
    out = np.full((*x.shape[:2], outputs), np.nan) if keep else None
    for j in range(x.shape[1]):
        on = np.flatnonzero(j < length)
        state[on], made = step(state[on], x[on, j])
        if keep:
            out[on, j] = made
    return state, out, length


def block_scan(rows: DataFrame, inputs: list[str], width: int, step: Step, outputs: list[str], keys: list[str] = KEY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(keys, bar_idx, outputs) for each row, and (keys, state) after the last row of each series. The state has ``width`` numbers, all NaN before a series' first row."""
    n = len(inputs)
    own = [F.col(k) for k in keys]
    packed = rows.groupBy(*own, F.floor(F.col("bar_idx") / block).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("bar_idx", *inputs))).alias("r"))
    field = lambda k: F.transform("r", lambda x: F.coalesce(x[k].cast("double"), F.lit(float("nan"))))
    lists = [field(k).alias(f"x{i}") for i, k in enumerate(inputs)]
    packed = kept(packed.select(*keys, "blk", F.xxhash64(*keys, "blk").alias("id"), F.col("r.bar_idx").alias("places"), *lists))
    names = [f"x{i}" for i in range(n)]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                state, _, _ = _run(part, width, n, step, len(outputs), False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(state), pa.list_(pa.float64()))], ["id", "end"])

    def ended(entries: DataFrame) -> DataFrame:
        return entries.join(packed, "id").select("id", "entry", *names).mapInArrow(ends, "id long, end array<double>")

    none = F.array_repeat(F.lit(float("nan")), width)
    entries = packed.select("id", none.alias("entry"))
    found = kept(entries.join(ended(entries), "id"))
    order = Window.partitionBy(*keys).orderBy("blk")  # a row for each block
    while True:
        after = packed.select(*keys, "blk", "id").join(found, "id").withColumn("next", F.coalesce(F.lag("end").over(order), none))
        after = kept(after.select("id", "entry", "end", "next"))
        open_ = after.where("entry <> next").select("id", F.col("next").alias("entry"))
        if open_.isEmpty():
            break
        again = open_.join(ended(open_), "id")
        found = kept(after.where("entry = next").select("id", "entry", "end").unionByName(again))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                _, out, length = _run(part, width, n, step, len(outputs), True)
                inside = np.arange(out.shape[1])[None, :] < length[:, None]
                places = part.column(2 + n).flatten()
                ids = pa.array(np.repeat(part.column(0).to_numpy(), length))
                cols = [pa.array(out[inside, k], from_pandas=True) for k in range(len(outputs))]
                yield pa.RecordBatch.from_arrays([ids, places, *cols], ["id", "bar_idx", *outputs])

    whole = found.select("id", "entry").join(packed, "id").select("id", "entry", *names, "places")
    out = whole.mapInArrow(made, f"id long, bar_idx long, {', '.join(f'{c} double' for c in outputs)}")
    out = out.join(packed.select("id", *keys), "id").select(*keys, "bar_idx", *outputs)
    last = packed.select(*keys, "blk", "id").join(found, "id").groupBy(*keys).agg(F.max_by("end", "blk").alias("state"))
    return out, last


def ratchet(state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands that only tighten while the close stays inside them, and the direction (-1 is bullish): state (upper, lower, direction, close), inputs (middle, width, close)."""
    (up0, low0, side0, c0), (middle, width, close) = state.T, x.T
    fresh, live = np.isnan(up0), ~np.isnan(width)
    up, low = middle + width, middle - width
    low = np.where(fresh | (low > low0) | (c0 < low0), low, low0)
    up = np.where(fresh | (up < up0) | (c0 > up0), up, up0)
    side = np.where(side0 == 1, np.where(close > up, -1, 1), np.where(close < low, 1, -1))
    side = np.where(fresh, 1, side)
    new = np.where(live[:, None], np.stack([up, low, side, close], 1), state)
    out = np.stack([side, np.where(side == -1, low, up)], 1)
    return new, np.where(live[:, None], out, np.nan)


def band_inputs(bars: DataFrame, length: int = 10, train: int = 100, factor: float = 3.0, keys: list[str] = KEY) -> DataFrame:
    """What the ratchet needs of each bar: the middle, the width of the bands from the volatility cluster nearest to the ATR, and that cluster's name."""
    rows = bounded(atr(bars, length, "atr", keys), train, lambda w: {"centres": three_means("atr", w, train)}, keys=keys)
    near = [F.abs(F.col("atr") - F.col("centres")[i]) for i in range(3)]
    i = F.when(near[0] <= F.least(near[1], near[2]), 0).when(near[1] <= near[2], 1).otherwise(2)
    name = F.when(i == 0, "HIGH").when(i == 1, "MEDIUM").otherwise("LOW")
    width = F.when(F.col("bar_idx") >= length + train, F.element_at("centres", i + 1) * factor)
    middle = ((F.col("h") + F.col("l")) / 2).alias("hl2")
    return rows.select(*keys, "bar_idx", "t", "c", middle, width.alias("width"), F.when(width.isNotNull(), name).alias("regime"))


def supertrend(bars: DataFrame, length: int = 10, train: int = 100, factor: float = 3.0, keys: list[str] = KEY, block: int = BLOCK) -> DataFrame:
    """Bars with ``direction``, ``line`` and ``regime`` of the adaptive bands."""
    inputs = kept(band_inputs(bars, length, train, factor, keys))
    out, _ = block_scan(inputs, ["hl2", "width", "c"], 4, ratchet, ["direction", "line"], keys, block)
    got = out.join(inputs.select(*keys, "bar_idx", "regime"), [*keys, "bar_idx"]).withColumn("direction", F.col("direction").cast("int"))
    return bars.join(got, [*keys, "bar_idx"], "left")


def pool_step(most: int, life: int, spread: float) -> Step:
    """Line zones in order of age. State: (price, created, expires) of each; inputs: bar_idx, candidate's price, ATR, low, high; outputs: three numbers for each zone that goes.

    A zone expires; a candidate opens one unless an active one is near, and the oldest goes when there are too many; bars that touch a zone prolong it.
    """

    def closed_up(z: np.ndarray, stays: np.ndarray) -> np.ndarray:
        """The zones that stay, moved up."""
        order = np.argsort(~stays, axis=1, kind="stable")
        z = np.take_along_axis(np.where(stays[:, :, None], z, np.nan), order[:, :, None], axis=1)
        return z

    def step(state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, price, atr_, low, high = x.T
        z = state.reshape(len(state), most, 3)
        out = np.full((len(z), most + 1, 3), np.nan)
        there = ~np.isnan(z[:, :, 0])
        gone = there & (z[:, :, 2] < i[:, None])
        out[:, :most] = np.where(gone[:, :, None], z, np.nan)
        z = closed_up(z, there & ~gone)
        there = ~np.isnan(z[:, :, 0])
        near = there & ~(np.abs(z[:, :, 0] - price[:, None]) > spread * atr_[:, None])
        opens = ~np.isnan(price) & ~near.any(1)
        full = opens & there.all(1)
        out[:, most] = np.where(full[:, None], np.stack([z[:, 0, 0], z[:, 0, 1], i], 1), np.nan)
        stays = there.copy()
        stays[full, 0] = False
        z = closed_up(z, stays)
        at = np.flatnonzero(opens)
        z[at, (~np.isnan(z[at, :, 0])).sum(1)] = np.stack([price, i, i + life], 1)[at]
        touched = (z[:, :, 0] >= low[:, None]) & (z[:, :, 0] <= high[:, None])
        z[:, :, 2] = np.where(touched, i[:, None] + life, z[:, :, 2])
        return z.reshape(len(z), -1), out.reshape(len(out), -1)

    return step


def zone_pool(bars: DataFrame, candidates: DataFrame, most: int = 3, life: int = 200, spread: float = 0.6, keys: list[str] = KEY, block: int = BLOCK) -> DataFrame:
    """(keys, price, created_idx, expires_idx, status) of line zones from ``candidates`` (keys, bar_idx, price, atr) over ``bars``: active, expired or evicted_by_capacity."""
    rows = bars.select(*keys, "bar_idx", "l", "h").join(candidates.select(*keys, "bar_idx", "price", "atr"), [*keys, "bar_idx"], "left")
    rows = rows.withColumn("place", F.col("bar_idx"))
    parts = [f"{c}{k}" for k in range(most + 1) for c in ("price", "created", "expires")]
    out, last = block_scan(rows, ["place", "price", "atr", "l", "h"], 3 * most, pool_step(most, life, spread), parts, keys, block)
    zone = lambda get, k, status: F.struct(get(3 * k).alias("price"), get(3 * k + 1).cast("long").alias("created_idx"), get(3 * k + 2).cast("long").alias("expires_idx"), F.lit(status).alias("status"))
    ended = F.array(*[zone(lambda j: F.col(parts[j]), k, "evicted_by_capacity" if k == most else "expired") for k in range(most + 1)])
    active = F.array(*[zone(lambda j: F.nanvl(F.col("state")[j], F.lit(None).cast("double")), k, "active") for k in range(most)])
    some = out.where(F.greatest(*parts).isNotNull())
    zones = some.select(*keys, F.explode(ended).alias("z")).unionByName(last.select(*keys, F.explode(active).alias("z")))
    return zones.where("z.price IS NOT NULL").select(*keys, "z.*")


def liquidity_pools(pivots: DataFrame, bars: DataFrame, least: int = 3, share: float = 0.4, keep: int = 50, keys: list[str] = KEY) -> DataFrame:
    """Pools of at least ``least`` pivot highs (bar_idx, price, atr) within a share of the ATR of the newest one, in an unbroken run of the newest ``keep``.

    A pivot's run is a window over the pivots before it. A pool is the row of pivots whose runs begin at one pivot; it ends at the first high above its upper edge
    as that edge was then, and what comes later begins a new pool. No state is carried, so nothing is folded.
    """
    from .joins import first_hit

    w = Window.partitionBy(*keys).orderBy("bar_idx")
    back = F.reverse(F.collect_list(F.struct("bar_idx", "price")).over(w.rowsBetween(1 - keep, 0)))
    rows = pivots.withColumns({"_back": back, "_place": F.row_number().over(w)})
    far = F.transform("_back", lambda p: (F.abs(p["price"] - F.col("price")) > share * F.col("atr")).cast("int"))
    stop = F.array_position(far, 1)
    run = F.slice("_back", 1, F.when(stop > 0, stop - 1).otherwise(F.size("_back")).cast("int"))
    rows = rows.select(*keys, "bar_idx", run.alias("run")).where(F.size("run") >= least)
    prices = F.transform("run", lambda p: p["price"])
    rows = rows.select(*keys, "bar_idx", F.element_at("run", -1)["bar_idx"].alias("start_idx"), F.array_min(prices).alias("lo"), F.array_max(prices).alias("hi"), F.size("run").cast("long").alias("n"))
    rows = kept(rows.withColumns({"_id": F.xxhash64(*keys, "bar_idx"), "_from": F.col("bar_idx") + 1}))
    rows = rows.join(first_hit(rows, bars, keys, "_from", "hi", "h", True, "_id"), "_id", "left")
    of_start = Window.partitionBy(*keys, "start_idx").orderBy("bar_idx")
    # A pivot's own bar is looked at before the pivot, so a pool that ends there is not joined any more.
    fresh = F.when(F.lag("hit_idx").over(of_start) > F.col("bar_idx"), 0).when(F.row_number().over(of_start) == 1, 1).otherwise(F.lag("hit_idx").over(of_start).isNotNull().cast("int"))
    rows = rows.withColumn("_pool", F.sum(fresh).over(of_start.rowsBetween(Window.unboundedPreceding, 0)))
    newest = F.max_by(F.struct("lo", "hi", "n", "hit_idx"), "bar_idx").alias("z")
    pools = rows.groupBy(*keys, "start_idx", "_pool").agg(F.min("bar_idx").alias("known_idx"), newest)
    return pools.select(*keys, "start_idx", "known_idx", "z.lo", "z.hi", "z.n", F.col("z.hit_idx").alias("broken_idx"))

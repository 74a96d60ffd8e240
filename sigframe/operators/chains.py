"""Ordered chains of conditions: each stage is the first event after the one before, within a time, that stands as it should to what was met so far.

A stage is a join over cells of time as wide as the stage may last, so it forms only pairs that lie near each other, and a key with very many events is shared by cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from ..sources.tables import kept

c = F.col
HOUR = 3600


def first_after(rows: DataFrame, events: DataFrame, keys: list[str], id_col: str, since: Column, within: int, at: str, take: dict[str, str], condition: Column, inclusive: bool = False) -> DataFrame:
    """``rows`` that have an event with ``since`` < its time ``at`` <= ``since`` + ``within`` (or from ``since`` on, if inclusive) under a condition, with the columns ``take`` of the first one.

    ``take`` maps columns of the events to their new names; the condition may use the rows' columns and the events' own.
    """
    cell = lambda t: F.floor(t / within)
    asked = rows.withColumns({"_since": since, "_cell": F.explode(F.array(cell(since), cell(since) + 1))})
    met = asked.join(events.withColumn("_cell", cell(c(at))), [*keys, "_cell"])
    low = c(at) >= c("_since") if inclusive else c(at) > c("_since")
    met = met.where(low & (c(at) <= c("_since") + within) & condition)
    first = met.groupBy(id_col).agg(F.min_by(F.struct(*[c(k).alias(v) for k, v in take.items()]), F.struct(at, *take)).alias("_first"))
    return kept(rows.join(first, id_col).select(*rows.columns, "_first.*"))


#: How long a stage may last, in hours: from the break to the opposing block, to the opposite break, to the recovery, and to the block that this makes.
WAITS = (72, 720, 48, 48)


def trapped_breaks(broken: DataFrame, blocks: DataFrame, bars: DataFrame, direction: int, waits: tuple[int, int, int, int] = WAITS, keys: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Breaks that are trapped and taken back: the chains, and how many rows reach each stage.

    For direction 1: a bullish break (A), a bearish block above it (B), a bearish break below it (C), a bar that goes below that level and then a close back above it (D), and a
    bullish block at or under the level (E). For -1 all is mirrored. ``broken`` has (t, side, type, level), ``blocks`` (made_t, side, lo, hi). A chain is entered at the bar after its last part; of
    chains with the same entry the earliest one stays.
    """
    up = direction > 0
    own, other = ("bullish", "bearish") if up else ("bearish", "bullish")
    beyond = lambda a, b: a > b if up else a < b
    bos = broken.where("type = 'BOS'")
    near, far = ("blo", "bhi") if up else ("bhi", "blo")
    box = blocks.select(*keys, c("side").alias("bside"), c("lo").alias("blo"), c("hi").alias("bhi"), "made_t")
    line = bos.where(c("side") == other).select(*keys, c("t").alias("et"), c("level").alias("elevel"))
    path = bars.select(*keys, c("t").alias("bt"), c("l" if up else "h").alias("reach"), c("c").alias("close"))

    a = bos.where(c("side") == own).select(*keys, F.xxhash64(*keys, "t", "side").alias("chain_id"), c("t").alias("a_t"), c("level").alias("a_level"))
    b = first_after(a, box.where(c("bside") == other), keys, "chain_id", c("a_t"), waits[0] * HOUR, "made_t", {"made_t": "b_t"}, beyond(c(near), c("a_level")))
    third = first_after(b, line, keys, "chain_id", c("b_t"), waits[1] * HOUR, "et", {"et": "c_t", "elevel": "c_level"}, beyond(c("a_level"), c("elevel")))
    pierced = first_after(third, path, keys, "chain_id", c("c_t"), waits[1] * HOUR, "bt", {"bt": "pierce_t"}, beyond(c("c_level"), c("reach")), True)
    d = first_after(pierced, path, keys, "chain_id", c("pierce_t"), waits[2] * HOUR, "bt", {"bt": "d_t"}, beyond(c("close"), c("c_level")), True)
    e = first_after(d, box.where(c("bside") == own), keys, "chain_id", c("d_t"), waits[3] * HOUR, "made_t", {"made_t": "e_t"}, ~beyond(c(near), c("c_level")), True)
    counts = [x.groupBy("instrument").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name)) for name, x in zip("ABCDE", (a, b, third, d, e), strict=True)]
    funnel = reduce(DataFrame.unionByName, counts).withColumn("direction", F.lit(direction))
    # The entry is the first bar after the last part; bars are met by the last bar that is not after it.
    from .joins import asof

    nxt = asof(e, bars.select(*keys, c("t").alias("after_t"), c("bar_idx").alias("entry_idx")), keys, "e_t", "after_t", ["entry_idx"], "forward", True, waits[1] * HOUR)
    nxt = nxt.where("entry_idx_asof IS NOT NULL").withColumnRenamed("entry_idx_asof", "entry_idx")
    stages = ["a_t", "b_t", "c_t", "d_t", "e_t"]
    chains = nxt.groupBy(*keys, "entry_idx").agg(F.min(F.struct(*stages)).alias("s")).select(*keys, "s.*", "entry_idx")
    return chains.withColumn("direction", F.lit(direction)), funnel

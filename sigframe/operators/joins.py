"""Joins on time and price: as-of, nearest, interval, first hit, overlap and tolerance.

As-of joins are a union of both sides and a window over it. Range joins put both sides into buckets, join these by equality and
then apply the exact condition, so no pair is formed that shares no bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT_BLOCK = 256


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str, values: Sequence[str], direction: str = "backward", strict: bool = False, span: int | None = None) -> DataFrame:
    """Every left row with the ``values`` of the right row of its keys that is the last at or before it, or the first at or after it ("forward"); ``strict``: not at it.

    Right rows of equal times count as the one with the greatest values. ``span`` (in units of time) shares a key's rows among tasks: both sides are cut into spans and each span also
    gets the last row before it (the first after it), found from one row per span.
    """
    keys = list(keys)
    back = direction == "backward"
    right = right.groupBy(*keys, F.col(right_t).alias("_t")).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_v", F.struct("_t", "_v"))
    left = left.withColumn("_t", F.col(left_t))
    # At equal times a right row comes before left rows, or after them: ``_side`` orders it.
    right_first = back != strict
    l_side, r_side = (1, 0) if right_first else (0, 1)
    span_of = F.floor(F.col("_t") / span) if span else F.lit(0)
    cols = [c for c in left.columns if c != "_t"]
    packed = left.select(*keys, "_t", span_of.alias("_span"), F.lit(l_side).alias("_side"), F.struct(*cols).alias("_l"), F.lit(None).cast(right.schema["_v"].dataType).alias("_v"))
    other = right.select(*keys, "_t", span_of.alias("_span"), F.lit(r_side).alias("_side"), F.lit(None).cast(packed.schema["_l"].dataType).alias("_l"), "_v")
    both = packed.unionByName(other)
    w = Window.partitionBy(*keys, "_span").orderBy("_t", "_side")
    frame = w.rowsBetween(Window.unboundedPreceding, 0) if back else w.rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_own", (F.last if back else F.first)("_v", True).over(frame))
    if span:
        edge = both.groupBy(*keys, "_span").agg((F.max if back else F.min)("_v").alias("_e"))
        e = Window.partitionBy(*keys).orderBy("_span")
        beyond = F.last("_e", True).over(e.rowsBetween(Window.unboundedPreceding, -1)) if back else F.first("_e", True).over(e.rowsBetween(1, Window.unboundedFollowing))
        both = both.join(edge.select(*keys, "_span", beyond.alias("_beyond")), [*keys, "_span"]).withColumn("_own", F.coalesce("_own", "_beyond"))
    out = both.where(F.col("_side") == l_side).where("_l IS NOT NULL")
    return out.select("_l.*", F.col("_own._t").alias(f"{right_t}_asof"), *[F.col(f"_own._v.{v}").alias(f"{v}_asof") for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str, within: int, values: Sequence[str]) -> DataFrame:
    """Left rows with the right row nearest in time, at most ``within`` away; the earlier one if two are as near."""
    keys = list(keys)
    marked = left.withColumn("_row", F.struct(*left.columns))
    cells = marked.select("_row", *keys, F.col(left_t).alias("_a"), F.explode(F.sequence(F.floor((F.col(left_t) - within) / within), F.floor((F.col(left_t) + within) / within))).alias("_cell"))
    other = right.select(*keys, F.col(right_t).alias("_b"), F.floor(F.col(right_t) / within).alias("_cell"), F.struct(*values).alias("_v"))
    pairs = cells.join(other, [*keys, "_cell"]).where(F.abs(F.col("_a") - F.col("_b")) <= within)
    best = pairs.groupBy("_row").agg(F.min(F.struct(F.abs(F.col("_a") - F.col("_b")).alias("d"), F.col("_b").alias("b"), F.col("_v").alias("v"))).alias("_n"))
    out = marked.dropDuplicates(["_row"]).join(best, "_row", "left")
    return out.select("_row.*", F.col("_n.b").alias(f"{right_t}_near"), *[F.col(f"_n.v.{v}").alias(f"{v}_near") for v in values])


def in_intervals(points: DataFrame, zones: DataFrame, keys: Sequence[str], at: str, begin: str, end: str, width: int, condition: Column | None = None) -> DataFrame:
    """Pairs of points and zones with begin <= at <= end (an open end is NULL), and ``condition`` over both sides' columns.

    Zones without an end reach to the last point of their keys. ``width`` should be near the length of most zones.
    """
    keys = list(keys)
    span = points.groupBy(*keys).agg(F.max(at).alias("_last"))
    cells = zones.join(span, keys).withColumn("_stop", F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last"))).where(F.col(begin) <= F.col("_stop"))
    cells = cells.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col("_stop") / width))))
    own = points.withColumn("_cell", F.floor(F.col(at) / width))
    out = own.join(cells, [*keys, "_cell"]).where((F.col(at) >= F.col(begin)) & (F.col(at) <= F.col("_stop")))
    out = out if condition is None else out.where(condition)
    return out.drop("_cell", "_stop", "_last")


def first_hit(events: DataFrame, bars: DataFrame, keys: Sequence[str], start: str, level: str, value: str, above: bool, id_col: str, most: int | None = None, block: int = HIT_BLOCK) -> DataFrame:
    """(id, hit_idx): the first bar from ``start`` on whose ``value`` is above (below) the event's level, within ``most`` bars if given.

    Bars are summed up by blocks, and blocks by blocks of blocks. Of each an event can only have its first hit in the one that it starts in or in the first later one
    whose extreme is beyond the level, so two are looked into at each step. With ``most`` the blocks in reach are joined by equality at once.
    """
    keys = list(keys)
    beyond = lambda v: F.col(v) > F.col("_level") if above else F.col(v) < F.col("_level")
    own = bars.select(*keys, F.col("bar_idx").alias("_i"), F.floor(F.col("bar_idx") / block).alias("_b"), F.col(value).alias("_v"))
    rows = events.select(F.col(id_col).alias("_id"), *keys, F.col(start).alias("_from"), F.col(level).alias("_level")).where("_from IS NOT NULL AND _level IS NOT NULL")
    rows = rows.withColumn("_to", F.col("_from") + most if most is not None else F.lit(1 << 62))
    ev = ["_id", *keys, "_from", "_level", "_to"]
    extreme = (F.max if above else F.min)("_v").alias("_x")

    def two(df: DataFrame, size: int) -> DataFrame:
        first = F.floor(F.col("_from") / size)
        found = df.where((F.col("_b") >= first) & (F.col("_b") <= F.floor(F.col("_to") / size)) & beyond("_x")).groupBy(*ev).agg(F.min(F.when(F.col("_b") == first, F.col("_b"))).alias("_own"), F.min(F.when(F.col("_b") > first, F.col("_b"))).alias("_next"))
        return found.select(*ev, F.explode(F.array_compact(F.array("_own", "_next"))).alias("_b"))

    if most is None:
        wide = F.floor(F.col("_i") / (block * block))
        rows = two(rows.join(own.groupBy(*keys, wide.alias("_b")).agg(extreme), keys), block * block).withColumnRenamed("_b", "_wide")
        rows = rows.join(own.groupBy(*keys, wide.alias("_wide"), "_b").agg(extreme), [*keys, "_wide"])
    else:
        rows = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor(F.col("_to") / block))))
        rows = rows.join(own.groupBy(*keys, "_b").agg(extreme), [*keys, "_b"])
    hits = two(rows, block).join(own, [*keys, "_b"]).where((F.col("_i") >= F.col("_from")) & (F.col("_i") <= F.col("_to")) & beyond("_v"))
    return hits.groupBy(F.col("_id").alias(id_col)).agg(F.min("_i").alias("hit_idx"))


def overlaps(boxes: DataFrame, keys: Sequence[str], id_col: str, low: str, high: str, begin: str, end: str, width: int, other: DataFrame | None = None) -> DataFrame:
    """(a, b) of boxes that share keys, a price and a time; a box does not pair with itself. Each pair comes once for each order.

    Boxes meet in cells of time; the cell in which the later one begins decides, so no pair is found twice.
    """
    keys = list(keys)

    def cells(df: DataFrame, tag: str) -> DataFrame:
        stop = F.coalesce(F.col(end), F.col("_last"))
        named = df.select(*keys, F.col(id_col).alias(tag), F.col(low).alias(f"{tag}_lo"), F.col(high).alias(f"{tag}_hi"), F.col(begin).alias(f"{tag}_t0"), stop.alias(f"{tag}_t1"))
        return named.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f"{tag}_t0") / width), F.floor(F.greatest(f"{tag}_t0", f"{tag}_t1") / width))))

    second = boxes if other is None else other
    last = boxes.unionByName(second, allowMissingColumns=True).agg(F.max(F.greatest(F.col(begin), F.coalesce(F.col(end), F.col(begin)))).alias("_last"))
    a, b = cells(boxes.crossJoin(F.broadcast(last)), "a"), cells(second.crossJoin(F.broadcast(last)), "b")  # one row: the last time of all
    meet = a.join(b, [*keys, "_cell"]).where("a_lo <= b_hi AND b_lo <= a_hi AND a_t0 <= b_t1 AND b_t0 <= a_t1").where(F.floor(F.greatest("a_t0", "b_t0") / width) == F.col("_cell"))
    return (meet if other is not None else meet.where("a <> b")).select(*keys, "a", "b")


def price_band(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, price: str, tolerance: float) -> DataFrame:
    """Pairs whose prices differ by at most the share ``tolerance`` of the greater one. Prices are positive; they meet in logarithmic cells."""
    import math

    keys, width = list(keys), -math.log(1 - tolerance)
    cell = lambda k: F.floor(F.ln(F.col(price)) / width) + k
    a = left.where(F.col(price) > 0).select(*keys, F.col(left_id).alias("a"), F.col(price).alias("a_price"), F.explode(F.array(*[cell(k) for k in (-1, 0, 1)])).alias("_cell"))
    b = right.where(F.col(price) > 0).select(*keys, F.col(right_id).alias("b"), F.col(price).alias("b_price"), cell(0).alias("_cell"))
    return a.join(b, [*keys, "_cell"]).where(F.abs(F.col("a_price") - F.col("b_price")) <= tolerance * F.greatest("a_price", "b_price")).drop("_cell")


def grid(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Every row with every value of a short list in code."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def containment(boxes: DataFrame, pairs: DataFrame, id_col: str, low: str, high: str) -> DataFrame:
    """(id, relation): engulfed by, engulfing, or partly over an overlapping box, in that order of precedence; isolated boxes have no partner."""
    ends = lambda tag: boxes.select(F.col(id_col).alias(tag), F.col(low).alias(f"{tag}_lo"), F.col(high).alias(f"{tag}_hi"))
    both = pairs.select("a", "b").join(ends("a"), "a").join(ends("b"), "b")
    inside, outside = (F.col("a_lo") >= F.col("b_lo")) & (F.col("a_hi") <= F.col("b_hi")), (F.col("a_lo") <= F.col("b_lo")) & (F.col("a_hi") >= F.col("b_hi"))
    found = both.groupBy(F.col("a").alias(id_col)).agg(F.max(inside).alias("_in"), F.max(outside).alias("_out"))
    relation = F.when(F.col("_in"), "engulfed").when(F.col("_out"), "engulfing").when(F.col("_in").isNotNull(), "partial").otherwise("isolated")
    return boxes.select(id_col).join(found, id_col, "left").select(id_col, relation.alias("relation"))


def originator(boxes: DataFrame, pairs: DataFrame, id_col: str, begin: str) -> DataFrame:
    """(id, origin): the earliest of a box and those that overlap it."""
    t = boxes.select(F.col(id_col).alias("b"), F.col(begin).alias("_t"))
    stack = pairs.select("a", "b").unionByName(boxes.select(F.col(id_col).alias("a"), F.col(id_col).alias("b")))
    return stack.join(t, "b").groupBy(F.col("a").alias(id_col)).agg(F.min_by("b", F.struct("_t", "b")).alias("origin"))

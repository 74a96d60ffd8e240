"""Tests against resampled nulls. Replicates are rows, so any number of them is shared among tasks.

Draws come from a generator whose kth value depends on seed and k alone, so no order is needed and every run agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import normal_cdf, ratio

c = F.col
_MASK = (1 << 32) - 1
#: The generator's increment.
_STEP = 0x6D2B79F5


def _times(a: Column, b: Column) -> Column:
    """Product modulo 2 ** 32, by 16-bit halves."""
    low, high = b.bitwiseAND(F.lit(65535)), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(_MASK))


def draw(k: Column, seed: int | Column = 42) -> Column:
    """The kth value in [0, 1) of the seeded 32-bit generator, k from 1."""
    seed = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    a = (seed + _times(k.cast("long").bitwiseAND(F.lit(_MASK)), F.lit(_STEP))).bitwiseAND(F.lit(_MASK))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    u = (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK))
    t = t.bitwiseXOR(u)
    return t.bitwiseXOR(F.shiftright(t, 14)) / float(1 << 32)


def replicated(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each replicate 0 .. n-1."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def random_entries(trades: DataFrame, bars: DataFrame, reps: int, by: list[str], order: list[str], seed: int = 42, cost_pct: float = 0.0, random_sides: bool = False) -> DataFrame:
    """Final equity of each replicate, in which each trade keeps its side and length (bars_held) and enters anywhere it fits.

    With ``random_sides`` the sides are dealt anew, as many of each as there are: the trades of the least draws are bullish. These draws come after all of the entries.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    sizes = bars.groupBy(*by).agg(F.count("*").alias("_n"))
    rows = trades.withColumns({"_j": place, "_m": F.count("*").over(Window.partitionBy(*by))}).join(sizes, by).where(c("bars_held") < c("_n"))
    rows = replicated(rows.select(*by, "side", "bars_held", "_j", "_m", "_n"), reps)
    rows = rows.withColumn("_at", F.floor(draw(c("rep") * c("_m") + c("_j") + 1, seed) * (c("_n") - c("bars_held"))))
    if random_sides:
        longs = Window.partitionBy(*by, "rep")
        bulls = F.sum(F.when(c("side") == "bullish", 1).otherwise(0)).over(longs)
        rows = rows.withColumn("_u", draw((c("rep") + reps) * c("_m") + c("_j") + 1, seed)).withColumn("_bulls", bulls)
        rows = rows.withColumn("side", F.when(F.row_number().over(longs.orderBy("_u", "_j")) <= c("_bulls"), "bullish").otherwise("bearish"))
    o = bars.select(*by, c("bar_idx").alias("_at"), c("o").alias("_in"))
    x = bars.select(*by, c("bar_idx").alias("_to"), c("o").alias("_out"))
    got = rows.join(o, [*by, "_at"]).withColumn("_to", c("_at") + c("bars_held")).join(x, [*by, "_to"])
    step = 1 + F.when(c("side") == "bullish", 1).otherwise(-1) * (c("_out") - c("_in")) / c("_in") - cost_pct / 100
    return got.groupBy(*by, "rep").agg(F.when(F.min(step) <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.greatest(step, F.lit(1e-12)))))).alias("equity"))


def null_summary(null: DataFrame, value: str, real: DataFrame, real_value: str, by: list[str], level: float = 0.05) -> DataFrame:
    """Mean, middle, extremes of a null and the share of it at or above the real value."""
    order = Window.partitionBy(*by).orderBy(value)
    rows = null.join(real.select(*by, c(real_value).alias("_real")), by).withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(F.when(c("_k") == F.floor(c("_n") * 0.5), c(value))).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.when(c(value) < c("_real"), 1)).alias("below"), F.avg(F.when(c(value) >= c("_real"), 1.0).otherwise(0.0)).alias("p"), F.first("_real").alias("real"))
    return out.withColumn("significant", c("p") < level)


def corrected(tests: DataFrame, p: str = "p", name: str = "test", alpha: float = 0.05) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg verdicts. The table of tests is one row each, however much data they came from."""
    order = Window.orderBy(p, name)
    rows = tests.withColumns({"rank": F.row_number().over(order), "m": F.count("*").over(Window.partitionBy(F.lit(1)))})
    holm_ok = c(p) <= alpha / (c("m") - c("rank") + 1)
    rows = rows.withColumns({"bonferroni": c(p) <= alpha / c("m"), "_h": F.when(holm_ok, 1).otherwise(0), "_b": F.when(c(p) <= alpha * c("rank") / c("m"), c("rank"))})
    return rows.withColumns({"holm": F.min("_h").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1, "benjamini_hochberg": F.coalesce(c("rank") <= F.max("_b").over(Window.partitionBy(F.lit(1))), F.lit(False))}).drop("_h", "_b")


def permuted_gap(units: DataFrame, label: str, n: str, wins: str, reps: int, stratum: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(rep, gap): the win-rate gap of labels 1 and 0; replicate 0 is the real one, in the others labels are dealt anew among units (within strata).

    Units are summed up before (size and wins), so a replicate moves numbers of units, not rows. Unit i of a stratum of m takes the label of the unit whose draw, of number rep * m + i, has its
    rank. Of labels 0 and 1 only the number of ones counts: the units of the least draws are the ones.
    """
    strata = stratum or []
    own = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(1))
    rows = units.select("unit", label, n, wins, *strata)
    rows = rows.withColumns({"_i": F.row_number().over(own.orderBy("unit")), "_m": F.count("*").over(own), "_ones": F.sum(label).over(own)})
    rows = replicated(rows, reps + 1).withColumn("_u", draw(c("rep") * c("_m") + c("_i"), seed))
    rank = F.row_number().over(Window.partitionBy("rep", *strata).orderBy("_u", "_i"))
    dealt = F.when(c("rep") == 0, c(label)).otherwise((rank <= c("_ones")).cast("int"))
    got = rows.withColumn("_dealt", dealt)
    rate = lambda v: ratio(F.sum(F.when(c("_dealt") == v, c(wins))).cast("double"), F.sum(F.when(c("_dealt") == v, c(n))).cast("double"))
    return got.groupBy("rep", *strata).agg((rate(1) - rate(0)).alias("gap"))


def one_sided(gaps: DataFrame, by: list[str]) -> DataFrame:
    """(by, gap, n, p): the real gap (replicate 0), and the share of replicates at or above it."""
    keys = [*by, "_all"]
    rows = gaps.withColumn("_all", F.lit(1))
    real = rows.where("rep = 0").select(*keys, c("gap").alias("_real"))
    return rows.where("rep > 0").join(real, keys).groupBy(*by).agg(F.first("_real").alias("gap"), F.count("*").alias("n"), F.avg(F.when(c("gap") >= c("_real") - 1e-12, 1.0).otherwise(0.0)).alias("p"))


def shift_offsets(df: DataFrame, by: list[str], shifts: int, seed: int = 42) -> DataFrame:
    """(by, rep, shift): for each replicate from 1 on a shift of at least one place round a series, from the generator's draw of its number."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(shifts).cast("long"))))
    return rows.select(*by, "rep", (1 + F.floor(draw(c("rep"), seed) * (c("_n") - 1))).alias("shift"))


def shifted_means(df: DataFrame, mark: str, value: str, offsets: DataFrame, by: list[str]) -> DataFrame:
    """(by, rep, diff): mean value on marked rows less that on all others, with the marks moved round the series by each offset; replicate 0 is the real one.

    ``df`` has a row for each place 0 .. n-1 of a series in ``place``. Marks are taken as runs: what a moved run covers is the difference of two running sums, so a replicate takes two rows for
    each run and not one for each mark.
    """
    w = Window.partitionBy(*by).orderBy("place")
    rows = df.withColumns({"_before": F.sum(value).over(w) - c(value), "_k": F.sum(F.when(c(mark), 0).otherwise(1)).over(w)})
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.count(F.when(c(mark), 1)).alias("_marks"))
    ends = rows.select(*by, c("place").alias("at"), c("_before").alias("_p")).unionByName(sizes.select(*by, c("_n").alias("at"), c("_s").alias("_p")))
    runs = rows.where(c(mark)).groupBy(*by, "_k").agg(F.min("place").alias("a"), F.max("place").alias("b")).drop("_k").join(sizes, by)
    moves = offsets.select(*by, "rep", "shift").unionByName(sizes.select(*by, F.lit(0).cast("long").alias("rep"), F.lit(0).cast("long").alias("shift")))
    moved = runs.join(moves, by).withColumns({"_x": (c("a") + c("shift")) % c("_n"), "_y": (c("b") + c("shift")) % c("_n") + 1})
    # A run that goes round the end covers what is before its end and after its start: the whole sum once more.
    edge = F.array(F.struct(c("_x").alias("at"), F.lit(-1.0).alias("f")), F.struct(c("_y").alias("at"), F.lit(1.0).alias("f")))
    wraps = F.when(c("_y") <= c("_x"), c("_s")).otherwise(0.0) / 2
    halves = moved.select(*by, "rep", "_n", "_s", "_marks", wraps.alias("_w"), F.explode(edge).alias("e")).select("*", c("e.at").alias("at"), c("e.f").alias("f")).drop("e")
    sums = halves.join(ends, [*by, "at"]).groupBy(*by, "rep", "_n", "_s", "_marks").agg(F.sum(c("f") * c("_p") + c("_w")).alias("_m"))
    return sums.select(*by, "rep", (c("_m") / c("_marks") - ratio(c("_s") - c("_m"), (c("_n") - c("_marks")).cast("double"))).alias("diff"))


def point_biserial(units: DataFrame, x: str, n: str, wins: str, by: list[str]) -> DataFrame:
    """Correlation of a number with single wins and losses, from counts of units."""
    w = c(n).cast("double")
    out = units.groupBy(*by).agg(F.sum(w).alias("_n"), F.sum(c(x) * w).alias("_x"), F.sum(c(x) * c(x) * w).alias("_xx"), F.sum(c(wins).cast("double")).alias("_y"), F.sum(c(x) * c(wins)).alias("_xy"))
    top = c("_n") * c("_xy") - c("_x") * c("_y")
    low = F.sqrt(F.greatest(F.lit(0.0), (c("_n") * c("_xx") - c("_x") * c("_x")) * (c("_n") * c("_y") - c("_y") * c("_y"))))
    return out.select(*by, ratio(top, low).alias("r"), c("_n").cast("long").alias("n"))


def bucket_gap(df: DataFrame, bucket: str, good: Column, low: Column, high: Column, by: list[str]) -> DataFrame:
    value = F.when(good, 1.0).otherwise(0.0)
    return df.groupBy(*by).agg((F.avg(F.when(high, value)) - F.avg(F.when(low, value))).alias("gap"))


def circular_shift(df: DataFrame, mark: Column, value: str, shifts: list[int], by: list[str]) -> DataFrame:
    """(by, shift, diff): mean value on marked rows less the mean on all others, with the marks moved round the series; shift 0 is the real one. Only marked rows move."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    marked = df.where(mark).select(*by, "bar_idx").withColumn("shift", F.explode(F.array(*[F.lit(s).cast("long") for s in shifts]))).join(sizes, by)
    moved = marked.withColumn("bar_idx", F.pmod(c("bar_idx") + c("shift"), c("_n"))).join(df.select(*by, "bar_idx", value), [*by, "bar_idx"])
    out = moved.groupBy(*by, "shift").agg(F.sum(value).alias("_m"), F.count("*").alias("_k"), F.first("_n").alias("_n"), F.first("_s").alias("_s"))
    return out.select(*by, "shift", (c("_m") / c("_k") - ratio(c("_s") - c("_m"), (c("_n") - c("_k")).cast("double"))).alias("diff"))


def random_subsets(df: DataFrame, value: str, size: int, reps: int, by: list[str], seed: int = 42) -> DataFrame:
    """Mean of a random subset of ``size`` rows of each key in each replicate: the rows with the least draws. Rows are numbered by ``unit`` from 0."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    rows = replicated(df.select(*by, "unit", value).join(sizes, by), reps).withColumn("_u", draw(c("rep") * c("_n") + c("unit") + 1, seed))
    order = Window.partitionBy(*by, "rep").orderBy("_u", "unit")
    return rows.withColumn("_k", F.row_number().over(order)).where(c("_k") <= size).groupBy(*by, "rep").agg(F.avg(value).alias("mean"))


def matched_draws(outcomes: DataFrame, pool: Column, size: int, reps: int, by: list[str], value: str, seed: int = 42) -> DataFrame:
    """Mean outcome of ``size`` random bars of a pool in each replicate; outcomes of all bars are computed before and only looked up."""
    members = outcomes.where(pool & c(value).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("bar_idx")) - 1).select(*by, "_k", value)
    n = members.groupBy(*by).agg(F.count("*").alias("_n"))
    draws = replicated(n, reps).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("_k", F.floor(draw(c("rep") * size + c("_j") + 1, seed) * c("_n")))
    return draws.join(members, [*by, "_k"]).groupBy(*by, "rep").agg(F.avg(value).alias("mean"))


def displaced(levels: DataFrame, atr: str, copies: int = 3, seed: int = 42) -> DataFrame:
    """Placebo levels one to three ATR away on either side; ``n`` numbers the levels from 0."""
    rows = levels.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    k = (c("n") * copies + c("copy")) * 2 + 1
    return rows.withColumn("level", c("level") + F.when(draw(k, seed) < 0.5, -1).otherwise(1) * (1 + 2 * draw(k + 1, seed)) * c(atr))


def welch(df: DataFrame, value: str, group: Column, by: list[str]) -> DataFrame:
    """t and two-sided p (normal) of the difference of means."""
    g = lambda f, k: f(F.when(group == k, c(value)))
    out = df.groupBy(*by).agg(*[g(f, k).alias(f"_{s}{k}") for k in (True, False) for f, s in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    t = ratio(c("_mtrue") - c("_mfalse"), F.sqrt(c("_vtrue") / F.nullif(c("_ntrue"), F.lit(0)) + c("_vfalse") / F.nullif(c("_nfalse"), F.lit(0))))
    return out.select(*by, t.alias("t")).withColumn("p", 2 * (1 - normal_cdf(F.abs("t"))))


def one_sample(df: DataFrame, value: str, by: list[str], mean: float = 0.0) -> DataFrame:
    out = df.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    return out.withColumn("t", ratio(c("m") - mean, c("s") / F.sqrt("n"))).withColumn("p", 2 * (1 - normal_cdf(F.abs("t"))))


def two_proportions(wins_a: Column, n_a: Column, wins_b: Column, n_b: Column) -> Column:
    pooled = ratio((wins_a + wins_b).cast("double"), (n_a + n_b).cast("double"))
    return ratio(wins_a / n_a - wins_b / n_b, F.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b)))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X >= k) for n trials; each term follows from the one before."""
    terms = F.aggregate(
        F.sequence(F.lit(0), n.cast("int")), F.struct(F.lit(0.0).alias("s"), (n * F.ln(F.lit(1 - p))).alias("l")),
        lambda a, i: F.struct((a["s"] + F.when(i >= k, F.exp(a["l"])).otherwise(0.0)).alias("s"), (a["l"] + F.when(i < n, F.ln((n - i) / (i + 1.0) * F.lit(p / (1 - p)))).otherwise(0.0)).alias("l")),
        lambda a: a["s"],
    )
    return F.least(F.lit(1.0), terms)


def verdict(n: Column, p: Column, least: int = 60, level: float = 0.05) -> Column:
    return F.when(n < least, "inconclusive").when(p < level, "significant").otherwise("not significant")


def conditional_information(cells: DataFrame, x: str, y: str, given: list[str], n: str = "n") -> DataFrame:
    """Mutual information of x and y within cells of the given codes, weighted by their size."""
    from .aggregates import information

    inside = information(cells, given, x, y, n).join(cells.groupBy(*given).agg(F.sum(n).alias("_w")), given)
    return inside.agg((F.sum(c("mi") * c("_w")) / F.sum("_w")).alias("cmi"))


def within_strata(df: DataFrame, count: str, stratum: str, good: Column, by: list[str]) -> DataFrame:
    """Rates above and not above the middle of a count, within strata of another number."""
    from ..functions.windows import quantile_cuts

    cut = quantile_cuts(df, count, [0.5], by)
    rows = df.join(cut, by).withColumn("high", c(count) > c("cuts")[0])
    return rows.groupBy(*by, stratum, "high").agg(F.count("*").alias("n"), F.avg(F.when(good, 1.0).otherwise(0.0)).alias("rate"))


def random_level_sweeps(bars: DataFrame, draws: int, horizon: int, offset: float, by: list[str], seed: int = 42) -> DataFrame:
    """The null of sweeps: levels above random bars, and within how many bars the highs pass each: (by, draw, bar_idx, level, hit_idx).

    Draw j takes its bar from the generator's value 2 j + 1 and its height above that bar's close, up to ``offset`` ATR, from 2 j + 2.
    """
    from ..sources.tables import kept
    from .joins import first_hit

    sizes = bars.groupBy(*by).agg(F.count("*").alias("_n"))
    values = sizes.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2 * draws).cast("long")))).withColumn("_u", draw(c("_k"), seed))
    values = values.groupBy(*by, "_n", F.floor((c("_k") - 1) / 2).alias("draw"))
    rows = kept(values.agg(F.max(F.when(c("_k") % 2 == 1, c("_u"))).alias("_at"), F.max(F.when(c("_k") % 2 == 0, c("_u"))).alias("_up")))
    rows = rows.withColumn("bar_idx", F.floor(c("_at") * c("_n"))).join(bars.select(*by, "bar_idx", "c", "atr"), [*by, "bar_idx"]).where("atr IS NOT NULL")
    rows = kept(rows.withColumns({"level": c("c") + c("_up") * offset * c("atr"), "level_id": F.xxhash64(*by, "draw"), "_from": c("bar_idx") + 1}))
    hit = first_hit(rows.select("level_id", *by, "_from", "level"), bars, by, "_from", "level", "h", True, "level_id", horizon - 1)
    return rows.join(hit, "level_id", "left").select(*by, "draw", "bar_idx", "level", "hit_idx")


def cluster_t(clusters: DataFrame, mean: str, null: DataFrame, value: str, by: list[str]) -> DataFrame:
    """t of the clusters' means against zero, and the share of a null's values below the mean of them all."""
    own = one_sample(clusters, mean, by).select(*by, "m", "t", "n")
    below = null.join(own.select(*by, c("m").alias("_m")), by).groupBy(*by).agg((F.avg(F.when(c(value) < c("_m"), 1.0).otherwise(0.0)) * 100).alias("percentile"))
    return own.join(below, by, "left")

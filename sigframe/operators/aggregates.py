"""Metrics of trades and signals, distributions, overlaps and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import ratio
from ..functions.windows import binned, quantile_cuts

c = F.col


def metrics(trades: DataFrame, by: list[str], pnl: str = "pnl_pct") -> DataFrame:
    """Counts, win rate, mean win and loss, profit factor, expectancy. A win is above 0."""
    win, p = c(pnl) > 0, c(pnl)
    out = trades.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(c("side") == "bullish", 1)).alias("longs"), F.count(F.when(win, 1)).alias("wins"), F.avg(F.when(win, p)).alias("avg_win"), F.avg(F.when(~win, p)).alias("avg_loss"), F.coalesce(F.sum(F.when(win, p)), F.lit(0.0)).alias("_gain"), F.coalesce(-F.sum(F.when(~win, p)), F.lit(0.0)).alias("_loss"), F.avg(p).alias("expectancy"), F.avg("bars_held").alias("avg_bars"))
    return out.withColumns({"win_rate": c("wins") / c("n") * 100, "profit_factor": F.when(c("_loss") > 0, c("_gain") / F.nullif(c("_loss"), F.lit(0.0)))}).drop("_gain", "_loss")


def equity(trades: DataFrame, by: list[str], order: list[str], pnl: str = "pnl_pct") -> DataFrame:
    """Compounded equity after each trade, its peak and the fall from it. A loss of all or more ends at 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = 1 + c(pnl) / 100
    log = F.sum(F.when(step > 0, F.ln(step)).otherwise(0.0)).over(w)
    dead = F.max(F.when(step <= 0, 1).otherwise(0)).over(w) == 1
    rows = trades.withColumn("equity", F.when(dead, 0.0).otherwise(F.exp(log)))
    rows = rows.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return rows.withColumn("drawdown", 1 - c("equity") / c("peak"))


def equity_by_blocks(trades: DataFrame, by: list[str], order: list[str], pnl: str = "pnl_pct", block: int = 4096) -> DataFrame:
    """As ``equity``, with a key's trades shared among tasks by blocks of their order.

    What a block does to an equity is a pair: the factor of its whole product, and the highest product within it. Pairs are put together in the order of the blocks, a row for each; then each
    block goes on from the equity and the peak before it. Trades get their place from ranks of the order's first column, counted by value, so equal values lie in one block.
    """
    from ..sources.tables import kept

    first = order[0]
    counts = trades.groupBy(*by, first).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select(*by, first, F.floor(F.coalesce(upto, F.lit(0)) / block).alias("_blk"))
    rows = kept(trades.join(places, [*by, first]).withColumn("_step", F.greatest(1 + c(pnl) / 100, F.lit(0.0))))
    inside = Window.partitionBy(*by, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    log = F.sum(F.when(c("_step") > 0, F.ln("_step")).otherwise(0.0)).over(inside)
    own = rows.withColumn("_f", F.when(F.min("_step").over(inside) <= 0, 0.0).otherwise(F.exp(log)))
    own = kept(own.withColumn("_p", F.max("_f").over(inside)))
    whole = own.groupBy(*by, "_blk").agg(F.max_by("_f", F.struct(*order)).alias("_factor"), F.max("_p").alias("_top"))
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.min("_factor").over(before) <= 0, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.ln(F.greatest("_factor", F.lit(1e-300)))).over(before), F.lit(0.0))))
    starts = whole.withColumn("_start", start)
    peak = F.greatest(F.lit(1.0), F.coalesce(F.max(c("_start") * c("_top")).over(before), F.lit(1.0)))
    starts = starts.select(*by, "_blk", "_start", peak.alias("_peak"))
    out = own.join(starts, [*by, "_blk"]).withColumns({"equity": c("_start") * c("_f"), "peak": F.greatest("_peak", c("_start") * c("_p"))})
    return out.withColumn("drawdown", 1 - c("equity") / c("peak")).drop("_blk", "_step", "_f", "_p", "_start", "_peak")


def growth_inputs(trades: DataFrame, by: list[str], entry_t: str, exit_t: str, pnl: str = "pnl_pct") -> DataFrame:
    """Trades, years from the first entry to the last exit, trades a year, mean result, and the compounded multiple: (multiple) ** (1 / years) is the yearly growth."""
    years = (F.max(exit_t) - F.min(entry_t)) / 31_557_600.0
    out = trades.groupBy(*by).agg(F.count("*").alias("n"), years.alias("years"), F.avg(pnl).alias("expectancy"), F.exp(F.sum(F.ln(F.greatest(1 + c(pnl) / 100, F.lit(1e-12))))).alias("multiple"))
    return out.withColumn("per_year", c("n") / F.nullif(c("years"), F.lit(0.0)))


def equity_summary(curve: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return curve.groupBy(*by).agg(F.max_by("equity", F.struct(*order)).alias("final_equity"), F.max("peak").alias("peak"), F.max("drawdown").alias("max_drawdown"))


def split_by_rank(trades: DataFrame, by: list[str], at: str, share: float = 0.7) -> DataFrame:
    """In sample before the value at place floor(n * share) of the sorted times, out of sample from it on."""
    cut = quantile_cuts(trades, at, [share], by)
    return trades.join(cut, by).withColumn("sample", F.when(c(at) < c("cuts")[0], "in").otherwise("out")).drop("cuts")


def buy_and_hold(bars: DataFrame, by: list[str]) -> DataFrame:
    return bars.groupBy(*by).agg((F.max_by("c", "bar_idx") / F.nullif(F.min_by("o", "bar_idx"), F.lit(0.0))).alias("hold_multiple"))


def edges(trades: DataFrame, strategy: str, bucket: str, pnl: str, least: int = 30) -> DataFrame:
    """Mean result by (strategy, bucket), or the strategy's where the bucket has fewer rows than ``least``."""
    whole = trades.groupBy(strategy).agg(F.avg(pnl).alias("_all"))
    cell = trades.groupBy(strategy, bucket).agg(F.count("*").alias("n"), F.avg(pnl).alias("_own"))
    return cell.join(whole, strategy).withColumn("edge", F.when(c("n") >= least, c("_own")).otherwise(c("_all"))).drop("_own", "_all")


def walk_forward(trades: DataFrame, by: list[str], at: str, pnl: str, first: int, every: int) -> DataFrame:
    """At each refit the mean result of all trades that ended before it: (by, refit, n, edge)."""
    steps = trades.groupBy(*by).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi")).where(c("_hi") >= c("_lo") + first)
    refits = steps.select(*by, F.explode(F.sequence(c("_lo") + first, c("_hi"), F.lit(every).cast("long"))).alias("refit"))
    # Each trade counts from the first refit after it: sums by refit, then running sums, not a pair for each trade and refit.
    born = trades.join(steps, by).withColumn("refit", c("_lo") + first + F.greatest(F.lit(0), F.floor((c(at) - c("_lo") - first) / every) + 1) * every).groupBy(*by, "refit").agg(F.count("*").alias("_n"), F.sum(pnl).alias("_s"))
    w = Window.partitionBy(*by).orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    rows = refits.join(born, [*by, "refit"], "left")
    return rows.select(*by, "refit", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("n"), ratio(F.sum("_s").over(w), F.sum("_n").over(w).cast("double")).alias("edge"))


def concurrent(trades: DataFrame, by: list[str], entry: str, exit_: str) -> DataFrame:
    """Trades with the number of others that are open at their entry (entries at the same time count, exits at it do not)."""
    marks = trades.select(*by, c(entry).alias("_t"), F.lit(1).alias("_o"), F.lit(0).alias("_x")).unionByName(trades.select(*by, c(exit_).alias("_t"), F.lit(0).alias("_o"), F.lit(1).alias("_x")))
    sums = marks.groupBy(*by, "_t").agg(F.sum("_o").alias("_o"), F.sum("_x").alias("_x"))
    w = Window.partitionBy(*by).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    level = sums.select(*by, c("_t").alias(entry), (F.sum("_o").over(w) - F.sum("_x").over(w)).alias("_level"))
    return trades.join(level, [*by, entry]).withColumn("others", c("_level") - F.when(c(exit_) > c(entry), 1).otherwise(0)).drop("_level")


def concurrency_profile(trades: DataFrame, by: list[str], entry: str, exit_: str) -> DataFrame:
    """The most trades open at once, and at how many times each number was reached; at equal times exits come first."""
    marks = trades.select(*by, c(entry).alias("t"), F.lit(1).alias("d")).unionByName(trades.select(*by, c(exit_).alias("t"), F.lit(-1).alias("d")))
    steps = marks.groupBy(*by, "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("open", F.sum("d").over(w)).groupBy(*by, "open").agg(F.count("*").alias("times"))


def overlap_clusters(trades: DataFrame, by: list[str], entry: str, exit_: str, pnl: str) -> DataFrame:
    """Chains of trades that overlap one before them, with the mean result of each."""
    w = Window.partitionBy(*by).orderBy(entry, exit_)
    reach = F.max(exit_).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = trades.withColumn("_new", F.when(c(entry) < reach, 0).otherwise(1)).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.avg(pnl).alias("mean_pnl"), F.min(entry).alias("start"), F.max(exit_).alias("end"))


def rate_by_count(df: DataFrame, count: str, good: Column, most: int = 4) -> DataFrame:
    return df.groupBy(F.least(c(count), F.lit(most)).alias("bucket")).agg(F.count("*").alias("n"), (F.avg(F.when(good, 1.0).otherwise(0.0)) * 100).alias("rate"))


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """How many rows pass each condition and all before it."""
    passed, out = F.lit(True), []
    for name, cond in stages.items():
        passed = passed & F.coalesce(cond, F.lit(False))
        out.append(F.count(F.when(passed, 1)).alias(name))
    return df.agg(*out)


def contingency(df: DataFrame, *codes: str) -> DataFrame:
    return df.groupBy(*codes).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, columns: list[str], by: list[str], bins: int = 4) -> DataFrame:
    """For each pair of columns their correlation and their mutual information over equal-count bins, as a share of the lesser entropy."""
    rows = df
    for x in columns:
        rows = binned(rows, x, bins, by)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(a).alias("x"), c(b).alias("y"), c(f"{a}_bin").alias("i"), c(f"{b}_bin").alias("j")) for k, a in enumerate(columns) for b in columns[k + 1 :]])
    long = rows.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    key = [*by, "a", "b"]
    r = long.groupBy(*key).agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    cells = long.groupBy(*key, "i", "j").agg(F.count("*").alias("_k"))
    return r.join(information(cells, key, "i", "j", "_k"), key)


def information(cells: DataFrame, by: list[str], x: str, y: str, n: str) -> DataFrame:
    """Mutual information (bits), both entropies, and its share of the lesser one, from counts by cell."""
    total = F.sum(n).over(Window.partitionBy(*by)) if by else F.sum(n).over(Window.partitionBy(F.lit(1)))
    px, py = F.sum(n).over(Window.partitionBy(*by, x)), F.sum(n).over(Window.partitionBy(*by, y))
    rows = cells.withColumns({"_t": total, "_x": px, "_y": py})
    p = c(n) / c("_t")
    got = rows.groupBy(*by).agg(F.sum(p * F.log2(c(n) * c("_t") / (c("_x") * c("_y")))).alias("mi"), (-F.sum(p * F.log2(c("_x") / c("_t")))).alias("h_x"), (-F.sum(p * F.log2(c("_y") / c("_t")))).alias("h_y"))
    return got.withColumn("nmi", ratio(c("mi"), F.least("h_x", "h_y")))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of ranks; ties share their mean rank. Values are counted before they are ranked."""
    rows = df.where(c(x).isNotNull() & c(y).isNotNull())
    for v in (x, y):
        counts = rows.groupBy(*by, v).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(v).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.join(counts.select(*by, v, (upto - (c("_n") - 1) / 2).alias(f"_r_{v}")), [*by, v])
    return rows.groupBy(*by).agg(F.corr(f"_r_{x}", f"_r_{y}").alias("rho"), F.count("*").alias("n"))


def share_in_state(df: DataFrame, state: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when(state, 1.0).otherwise(0.0)).alias("share"), F.count(F.when(state, 1)).alias("bars"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(c("_k") <= k).drop("_k")

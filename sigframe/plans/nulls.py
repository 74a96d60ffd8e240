"""Registered queries over resampled nulls, with two thousand replicates each. Draws are functions of their number, so SQL gives the same replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import outcomes as O
from ..operators import resampling as R
from ..sources import tables as S
from .relations import _TRADES, trades
from .series import BARS, W, hourly, register

c = F.col
REPLICATES = 2000


def _draws(table: str, out: str) -> str:
    """CTEs from a table with a number ``k`` in each row to ``out``, the same with its draw ``u``."""
    big = "CAST(({})::HUGEINT * ({})::HUGEINT % 4294967296 AS BIGINT)"
    return f"""{out}_a AS (SELECT *, CAST((42 + k::HUGEINT * 1831565813) % 4294967296 AS BIGINT) AS a_ FROM {table}),
{out}_b AS (SELECT *, {big.format("xor(a_, a_ // 32768)", "a_ | 1")} AS b_ FROM {out}_a),
{out}_c AS (SELECT *, xor(b_, (b_ + {big.format("xor(b_, b_ // 128)", "b_ | 61")}) % 4294967296) AS c_ FROM {out}_b),
{out} AS (SELECT * EXCLUDE (a_, b_, c_), xor(c_, c_ // 16384) / 4294967296.0::DOUBLE AS u FROM {out}_c)"""


_REPS = f"rp AS (SELECT CAST(rep AS BIGINT) AS rep FROM range({REPLICATES}) AS t(rep))"
_ENTRIES = f"""{_TRADES}, sz AS (SELECT instrument, count(*) AS n FROM bars GROUP BY 1),
jt AS (SELECT instrument, side, held, row_number() OVER (PARTITION BY instrument ORDER BY bar_idx, ei, side) - 1 AS j, count(*) OVER (PARTITION BY instrument) AS m FROM trades), {_REPS},
kt AS (SELECT jt.*, sz.n, rep, rep * m + j + 1 AS k FROM jt JOIN sz USING (instrument), rp WHERE held < n), {_draws("kt", "et")}"""


def _equities(rows: str) -> str:
    return f"""st AS (SELECT e.instrument, e.rep, 1 + CASE WHEN e.side = 'bullish' THEN 1 ELSE -1 END * (y.o - x.o) / x.o AS step FROM {rows} e JOIN bars x ON x.instrument = e.instrument AND x.bar_idx = CAST(floor(e.u * (e.n - e.held)) AS BIGINT)
  JOIN bars y ON y.instrument = e.instrument AND y.bar_idx = CAST(floor(e.u * (e.n - e.held)) AS BIGINT) + e.held),
nl AS (SELECT instrument, rep, CASE WHEN min(step) <= 0 THEN 0 ELSE exp(sum(ln(greatest(step, 1e-12)))) END AS equity FROM st GROUP BY 1, 2),
re AS (SELECT instrument, CASE WHEN min(1 + pnl / 100) <= 0 THEN 0 ELSE exp(sum(ln(greatest(1 + pnl / 100, 1e-300)))) END AS real FROM trades GROUP BY 1),
su AS (SELECT instrument, real, equity, row_number() OVER (PARTITION BY instrument ORDER BY equity) - 1 AS k, count(*) OVER (PARTITION BY instrument) AS n FROM nl JOIN re USING (instrument))
SELECT instrument, count(*) AS n, round(ln(max(CASE WHEN k = floor(n * 0.5) THEN equity END) + 1e-9), 4) AS log_median, count(*) FILTER (equity = 0) AS ruined, count(*) FILTER (equity < real) AS below,
round(avg(CASE WHEN equity >= real THEN 1.0 ELSE 0.0 END), 6) AS p, CASE WHEN any_value(trades_n) < 60 THEN 'inconclusive' WHEN avg(CASE WHEN equity >= real THEN 1.0 ELSE 0.0 END) < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict
FROM su JOIN (SELECT instrument, count(*) AS trades_n FROM trades GROUP BY 1) USING (instrument) GROUP BY instrument"""


def _against_random(spark: SparkSession, sf_dir: str, random_sides: bool) -> DataFrame:
    t, b = trades(spark, sf_dir)
    real = A.equity_summary(A.equity(t, ["instrument"], ["exit_idx", "event_id"]), ["instrument"], ["exit_idx", "event_id"])
    null = S.kept(R.random_entries(t, b, REPLICATES, ["instrument"], ["bar_idx", "entry_idx", "side"], random_sides=random_sides))
    ruined = null.groupBy("instrument").agg(F.count(F.when(c("equity") == 0, 1)).alias("ruined"))
    sizes = t.groupBy("instrument").agg(F.count("*").alias("trades_n"))
    out = R.null_summary(null, "equity", real, "final_equity", ["instrument"]).join(ruined, "instrument").join(sizes, "instrument")
    verdict = R.verdict(c("trades_n"), c("p"))
    return out.select("instrument", "n", F.round(F.ln(c("median") + 1e-9), 4).alias("log_median"), "ruined", "below", F.round("p", 6).alias("p"), verdict.alias("verdict"))


@register(f"WITH {_ENTRIES}, {_equities('et')}")
def q_random_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q2, Q18: the trades' equity against that of as many trades of the same sides and lengths entered anywhere, and the verdict if there are enough."""
    return _against_random(spark, sf_dir, False)


@register(f"""WITH {_ENTRIES}, k2 AS (SELECT * EXCLUDE (k, u), u AS own_u, (rep + {REPLICATES}) * m + j + 1 AS k FROM et), {_draws("k2", "e2")},
sd AS (SELECT * EXCLUDE (side, u, own_u), own_u AS u, CASE WHEN row_number() OVER (PARTITION BY instrument, rep ORDER BY u, j) <= count(CASE WHEN side = 'bullish' THEN 1 END) OVER (PARTITION BY instrument, rep) THEN 'bullish' ELSE 'bearish' END AS side FROM e2), {_equities('sd')}""")
def q_random_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16: the same with the sides dealt anew, as many of each."""
    return _against_random(spark, sf_dir, True)


_UNITS = f"{BARS}, un AS (SELECT instrument, t // 86400 AS unit, count(*) AS n, count(CASE WHEN c > o THEN 1 END) AS w, CAST(t // 86400 % 2 AS INT) AS label FROM bars GROUP BY 1, 2, 5)"


def _gaps(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    first = f"{by}, " if by else ""
    return f"""ui AS (SELECT *, row_number() OVER ({part} ORDER BY unit) AS i, count(*) OVER ({part}) AS m, sum(label) OVER ({part}) AS ones FROM us), ur AS (SELECT ui.*, rep, rep * m + i AS k FROM ui, (SELECT CAST(rep AS BIGINT) AS rep FROM range({REPLICATES + 1}) AS t(rep))),
{_draws("ur", "ud")}, dl AS (SELECT *, CASE WHEN rep = 0 THEN label WHEN row_number() OVER (PARTITION BY {first}rep ORDER BY u, i) <= ones THEN 1 ELSE 0 END AS dealt FROM ud),
gp AS (SELECT {first}rep, sum(CASE WHEN dealt = 1 THEN w END)::DOUBLE / nullif(sum(CASE WHEN dealt = 1 THEN n END), 0) - sum(CASE WHEN dealt = 0 THEN w END)::DOUBLE / nullif(sum(CASE WHEN dealt = 0 THEN n END), 0) AS gap FROM dl GROUP BY {first}rep)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(c("t") / 86400).alias("unit")
    rows = hourly(spark, sf_dir).groupBy("instrument", day).agg(F.count("*").alias("n"), F.count(F.when(c("c") > c("o"), 1)).alias("w"))
    return rows.withColumn("label", (c("unit") % 2).cast("int"))


_P = "avg(CASE WHEN g.gap >= r.gap - 1e-12 THEN 1.0 ELSE 0.0 END)"


@register(f"""WITH {_UNITS}, us AS (SELECT unit, sum(n) AS n, sum(w) AS w, any_value(label) AS label FROM un GROUP BY unit), {_gaps("")}
SELECT round(any_value(r.gap), 6) AS gap, count(*) AS n, round({_P}, 6) AS p FROM gp g, gp r WHERE r.rep = 0 AND g.rep > 0""")
def q_label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: the gap of win rates between labels of days, with the labels dealt anew among the days."""
    units = _units(spark, sf_dir).groupBy("unit", "label").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    return R.one_sided(S.kept(R.permuted_gap(units, "label", "n", "w", REPLICATES)), []).select(F.round("gap", 6).alias("gap"), "n", F.round("p", 6).alias("p"))


@register(f"""WITH {_UNITS}, us AS (SELECT * FROM un), {_gaps("instrument")}
SELECT g.instrument, round(any_value(r.gap), 6) AS gap, count(*) AS n, round({_P}, 6) AS p FROM gp g JOIN gp r ON r.instrument = g.instrument AND r.rep = 0 WHERE g.rep > 0 GROUP BY 1""")
def q_permutation_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: the same within each instrument."""
    gaps = S.kept(R.permuted_gap(_units(spark, sf_dir), "label", "n", "w", REPLICATES, ["instrument"]))
    return R.one_sided(gaps, ["instrument"]).select("instrument", F.round("gap", 6).alias("gap"), "n", F.round("p", 6).alias("p"))


@register(f"""WITH {BARS}, fw AS (SELECT instrument, c > o AS mark, lead(c, 5) OVER {W} - c AS f, bar_idx FROM bars), fp AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bar_idx) - 1 AS place, count(*) OVER (PARTITION BY instrument) AS n FROM fw WHERE f IS NOT NULL),
sk AS (SELECT DISTINCT instrument, n, rep + 1 AS k FROM fp, (SELECT CAST(rep AS BIGINT) AS rep FROM range({REPLICATES}) AS t(rep)) WHERE n > 1), {_draws("sk", "so")}, sh AS (SELECT instrument, k AS rep, 1 + CAST(floor(u * (n - 1)) AS BIGINT) AS shift FROM so UNION ALL SELECT DISTINCT instrument, 0, 0 FROM fp),
mv AS (SELECT a.instrument, rep, sum(b.f) AS s, count(*) AS m FROM fp a JOIN sh ON sh.instrument = a.instrument JOIN fp b ON b.instrument = a.instrument AND b.place = (a.place + shift) % a.n WHERE a.mark GROUP BY 1, 2),
tt AS (SELECT instrument, sum(f) AS s, count(*) AS n FROM fp GROUP BY 1), df AS (SELECT mv.instrument, rep, mv.s / m - (tt.s - mv.s) / nullif(tt.n - m, 0) AS diff FROM mv JOIN tt USING (instrument))
SELECT g.instrument, round(any_value(r.diff), 6) AS diff, count(*) AS n, round(avg(CASE WHEN abs(g.diff) >= abs(r.diff) - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p FROM df g JOIN df r ON r.instrument = g.instrument AND r.rep = 0 WHERE g.rep > 0 GROUP BY 1""")
def q_circular_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: moves after up bars against all others, with the marks moved round each series; two-sided."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("instrument").orderBy("bar_idx")) - 1
    rows = O.forward_return(hourly(spark, sf_dir), 5).where("fwd IS NOT NULL").select("instrument", place.cast("long").alias("place"), (c("c") > c("o")).alias("mark"), "fwd")
    rows = S.kept(rows)
    got = S.kept(R.shifted_means(rows, "mark", "fwd", R.shift_offsets(rows, ["instrument"], REPLICATES), ["instrument"]))
    real = got.where("rep = 0").select("instrument", c("diff").alias("real"))
    out = got.where("rep > 0").join(real, "instrument").groupBy("instrument").agg(F.first("real").alias("real"), F.count("*").alias("n"), F.avg(F.when(F.abs("diff") >= F.abs("real") - 1e-9, 1.0).otherwise(0.0)).alias("p"))
    return out.select("instrument", F.round("real", 6).alias("diff"), "n", F.round("p", 6).alias("p"))

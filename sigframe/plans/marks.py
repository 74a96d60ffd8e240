"""Registered queries over near misses, lives and states of zones, fractals, turns, cascades and clusters, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows
from ..operators import bars as B
from ..operators import compose as C
from ..operators import events as E
from ..operators import folds
from ..operators import outcomes as O
from ..operators import resampling as R
from ..operators import structure as P
from ..operators import zones as Z
from ..schema import KEY, SECONDS
from ..sources import tables as S
from .relations import blocks
from .series import _BLOCKS, BARS, W, hourly, register, rounded
from .structures import _STOCH, _ZONES, oscillating, ranged
from .studies import _RANGED

c = F.col


@register(f"""WITH {BARS}, x AS (SELECT instrument, t, to_timestamp(t)::TIMESTAMPTZ AS u FROM bars), y AS (SELECT instrument, t, hour(timezone('America/New_York', u)) AS ny, hour(timezone('Europe/London', u)) AS ln, hour(timezone('Asia/Tokyo', u)) AS tk FROM x)
SELECT instrument, t, ny >= 7 AND ny < 9 AS new_york, ln >= 7 AND ln < 10 AS london, ln >= 15 AND ln < 17 AS london_close, tk >= 10 AND tk < 14 AS asian FROM y""")
def b_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars within trading sessions by local time."""
    return hourly(spark, sf_dir).select("instrument", "t", *[B.in_session(c("t"), s).alias(s) for s in B.SESSIONS])


@register(f"""WITH {_ZONES}, x AS (SELECT z.instrument, z.side, z.created_idx, b.bar_idx, CASE WHEN b.l > bar_high THEN 'above' ELSE 'below' END AS "where", CASE WHEN b.l > bar_high THEN (b.l - bar_high) / nullif(bar_high, 0) ELSE (bar_low - b.h) / nullif(bar_low, 0) END AS gap FROM z JOIN bars b ON b.instrument = z.instrument AND b.bar_idx > created_idx AND b.bar_idx <= coalesce(m, 1000000000)
 WHERE (b.l > bar_high AND b.l - bar_high <= 0.05 * bar_high) OR (b.l <= bar_high AND b.h < bar_low AND bar_low - b.h <= 0.05 * bar_low)), y AS (SELECT *, bar_idx - row_number() OVER (PARTITION BY instrument, side, created_idx, "where" ORDER BY bar_idx) AS run FROM x)
SELECT instrument, side, created_idx, "where", min(bar_idx) AS start_idx, max(bar_idx) AS end_idx, count(*) AS bars_count, round(min(gap), 6) AS closest FROM y GROUP BY instrument, side, created_idx, "where", run""")
def z_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of bars that come near a zone on one side without touching it."""
    z, b = blocks(spark, sf_dir)
    own = z.select("zone_id", "side", c("from_idx").alias("created_idx"))
    return rounded(Z.near_misses(z, b, 0.05).join(own, "zone_id").select("instrument", "side", "created_idx", "where", "start_idx", "end_idx", "bars_count", "closest"))


@register(f"""WITH {_ZONES}, x AS (SELECT z.instrument, z.side, z.created_idx, b.bar_idx, b.bar_idx - row_number() OVER (PARTITION BY z.instrument, z.side, z.created_idx ORDER BY b.bar_idx) AS run FROM z JOIN bars b ON b.instrument = z.instrument AND b.bar_idx > created_idx AND b.bar_idx <= coalesce(m, 1000000000) AND b.l <= bar_high AND b.h >= bar_low),
i AS (SELECT instrument, side, created_idx, max(bar_idx) AS i FROM x GROUP BY instrument, side, created_idx, run UNION SELECT instrument, side, created_idx, created_idx FROM z), g AS (SELECT *, lead(i) OVER (PARTITION BY instrument, side, created_idx ORDER BY i) - i AS gap FROM i)
SELECT instrument, side, created_idx, min(CASE WHEN gap > 20 OR gap IS NULL THEN i END) + 20 AS expires_idx FROM g GROUP BY 1, 2, 3""")
def z_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long zones live if every touch gives them twenty more bars."""
    z, b = blocks(spark, sf_dir)
    own = z.select("zone_id", "instrument", "side", c("from_idx").alias("created_idx"))
    return Z.lives(S.kept(Z.interactions(z, b)), z, 20).join(own, "zone_id").select("instrument", "side", "created_idx", "expires_idx")


@register(f"""WITH {_ZONES}, {_RANGED}, d AS (SELECT b.instrument, b.bar_idx, b.atr, min(greatest(bar_low - b.c, b.c - bar_high, 0.0)) AS d FROM rb b LEFT JOIN z ON z.instrument = b.instrument AND b.bar_idx > created_idx AND b.bar_idx <= coalesce(m, 1000000000) GROUP BY 1, 2, 3), e AS (SELECT DISTINCT b.instrument, b.bar_idx FROM rb b JOIN z ON z.instrument = b.instrument AND b.bar_idx > created_idx AND b.bar_idx <= coalesce(m, 1000000000))
SELECT d.instrument, d.bar_idx, CASE WHEN e.bar_idx IS NULL THEN 'none' WHEN d = 0 THEN 'inside' WHEN d <= 0.1 * atr THEN 'on_top' WHEN d <= atr THEN 'near' ELSE 'far' END AS gap_state FROM d LEFT JOIN e USING (instrument, bar_idx)""")
def z_nearest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's state against the nearest standing zone."""
    z, _ = blocks(spark, sf_dir)
    return Z.nearest_state(z, ranged(spark, sf_dir), "atr").select("instrument", "bar_idx", "gap_state")


@register(f"""WITH {_BLOCKS}, p AS (SELECT *, lag(c) OVER {W} AS pc FROM bars), x AS (SELECT ob.instrument, ob.side, ob.created_idx, p.bar_idx, p.c - (bar_low + 0.01::DOUBLE * (p.bar_idx - created_idx)) AS d, p.pc - (bar_low + 0.01::DOUBLE * (p.bar_idx - 1 - created_idx)) AS e FROM ob JOIN p ON p.instrument = ob.instrument AND p.bar_idx > created_idx AND p.bar_idx <= created_idx + 50)
SELECT instrument, side, created_idx, bar_idx, row_number() OVER (PARTITION BY instrument, side, created_idx ORDER BY bar_idx) AS n FROM x WHERE sign(d) * sign(e) < 0""")
def z_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of lines projected from zones."""
    z, b = blocks(spark, sf_dir)
    lines = z.select(*KEY, c("zone_id").alias("line_id"), c("from_idx").alias("x0"), c("lo").alias("y0"), F.lit(0.01).alias("slope"))
    own = z.select(c("zone_id").alias("line_id"), "side", c("from_idx").alias("created_idx"))
    return Z.projected_crossings(lines, b, "c", 50).join(own, "line_id").select("instrument", "side", "created_idx", "bar_idx", "n")


_FRACTAL = f"""{_STOCH}, f0 AS (SELECT *, lag(q, 1) OVER {W} AS q1, lag(q, 2) OVER {W} AS q2, lag(q, 3) OVER {W} AS q3, lag(q, 4) OVER {W} AS q4, lag(h, 2) OVER {W} AS ph, lag(l, 2) OVER {W} AS pl FROM st),
f1 AS (SELECT *, CASE WHEN q2 > q AND q2 > q1 AND q2 > q3 AND q2 > q4 AND q2 >= 60 THEN q2 END AS top, CASE WHEN q2 < q AND q2 < q1 AND q2 < q3 AND q2 < q4 AND q2 <= 40 THEN q2 END AS bottom FROM f0)"""
_HELD3 = "(PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)"


@register(f"""WITH {_FRACTAL}, t AS (SELECT instrument, bar_idx, unnest([CASE WHEN top IS NOT NULL THEN 'top' END, CASE WHEN bottom IS NOT NULL THEN 'bottom' END, CASE WHEN q1 > 25 AND q1 < 75 AND q1 < q2 AND q > q1 THEN 'turn_up' END, CASE WHEN q1 > 25 AND q1 < 75 AND q1 > q2 AND q < q1 THEN 'turn_down' END]) AS type FROM f1) SELECT instrument, bar_idx, type FROM t WHERE type IS NOT NULL""")
def e_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-bar fractals of an oscillator beyond bounds, and its turns inside a band."""
    b = windows.bounded(S.kept(oscillating(spark, sf_dir)), 5, lambda w: {**E.fractal("q", w, 60, 40), **E.turns("q", 25, 75, w)})
    kinds = [F.when(c(k).isNotNull(), F.lit(k)) for k in ("top", "bottom")] + [F.when(c(k), F.lit(k)) for k in ("turn_up", "turn_down")]
    return b.select("instrument", "bar_idx", F.explode(F.array_compact(F.array(*kinds))).alias("type"))


@register(f"""WITH {_FRACTAL}, g AS (SELECT *, last_value(top IGNORE NULLS) OVER {_HELD3} AS tv, last_value(CASE WHEN top IS NOT NULL THEN ph END IGNORE NULLS) OVER {_HELD3} AS tp, last_value(bottom IGNORE NULLS) OVER {_HELD3} AS bv, last_value(CASE WHEN bottom IS NOT NULL THEN pl END IGNORE NULLS) OVER {_HELD3} AS bp FROM f1),
u AS (SELECT instrument, bar_idx, unnest([CASE WHEN top < tv AND ph > tp THEN 'regular bearish' END, CASE WHEN bottom > bv AND pl < bp THEN 'regular bullish' END, CASE WHEN top > tv AND ph < tp THEN 'hidden bearish' END, CASE WHEN bottom < bv AND pl > bp THEN 'hidden bullish' END]) AS d FROM g)
SELECT instrument, bar_idx AS confirm_idx, bar_idx - 2 AS bar_idx, split_part(d, ' ', 1) AS kind, split_part(d, ' ', 2) AS side FROM u WHERE d IS NOT NULL""")
def d_fractal_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of the price and an oscillator at its fractals, regular and hidden, each once."""
    found = P.divergences(S.kept(oscillating(spark, sf_dir)), "q", 60, 40)
    return found.dropDuplicates([*KEY, "confirm_idx", "side", "kind"]).drop("timeframe")


_LADDER = f"""{BARS}, lr(timeframe, s) AS (VALUES ('1h', 3600), ('2h', 7200), ('4h', 14400), ('1d', 86400)), lx AS (SELECT b.instrument, lr.timeframe, s, b.t - b.t % s AS t, first(o ORDER BY b.t) AS o, last(c ORDER BY b.t) AS c FROM bars b, lr GROUP BY 1, 2, 3, 4), ly AS (SELECT *, sign(c - o) AS d FROM lx WHERE c <> o),
fl AS (SELECT instrument, timeframe, s, t, t + s AS known, CASE WHEN d > 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT *, lag(d) OVER (PARTITION BY instrument, timeframe ORDER BY t) AS p FROM ly) WHERE p <> d)"""


def ladder_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of direction on four rungs."""
    hours = S.kept(B.from_ticks(S.ticks(spark, sf_dir)).select("instrument", "timeframe", "t", *"ohlcv"))
    ladder = B.indexed(hours.unionByName(B.rollup(hours, ["2h", "4h", "1d"]).select(hours.columns)))
    flips = E.flips(ladder.withColumn("dir", F.signum(c("c") - c("o"))).where("dir <> 0"), "dir")
    return S.kept(flips.select("instrument", "timeframe", "t", F.when(c("dir") > 0, "up").otherwise("down").alias("direction")))


def _step(n: int, rung: str, seconds: int) -> str:
    return f"""k{n} AS (SELECT instrument, direction, start_t, CASE WHEN hit THEN nxt ELSE k_at END AS k_at, depth + CASE WHEN hit THEN 1 ELSE 0 END AS depth, CASE WHEN stalled IS NULL AND NOT hit THEN '{rung}' ELSE stalled END AS stalled
 FROM (SELECT *, stalled IS NULL AND coalesce(nxt <= k_at + {3 * seconds}, false) AS hit FROM (SELECT k.*, (SELECT min(known) FROM fl WHERE fl.instrument = k.instrument AND fl.direction = k.direction AND fl.timeframe = '{rung}' AND fl.known > k.k_at) AS nxt FROM k{n - 1} k)))"""


@register(f"""WITH {_LADDER}, k0 AS (SELECT instrument, direction, t AS start_t, known AS k_at, 1 AS depth, CAST(NULL AS VARCHAR) AS stalled FROM fl WHERE timeframe = '1h'), {_step(1, '2h', 7200)}, {_step(2, '4h', 14400)}, {_step(3, '1d', 86400)}
SELECT instrument, direction, min(start_t) AS start_t, k_at AS known_at, depth, any_value(stalled) AS stalled_at FROM k3 WHERE depth >= 2 GROUP BY instrument, direction, k_at, depth""")
def c_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flips on one rung followed by the same on slower ones, the longest of each end."""
    found = C.cascades(ladder_flips(spark, sf_dir), ["1h", "2h", "4h", "1d"], 3.0)
    return C.maximal(found).select("instrument", "direction", "start_t", "known_at", "depth", "stalled_at")


_CLUSTERS = f"""WITH RECURSIVE {_LADDER}, e AS (SELECT instrument, direction, timeframe AS rung, t, 2 * s AS w, row_number() OVER (PARTITION BY instrument, direction ORDER BY t, timeframe) AS i FROM fl),
r AS (SELECT instrument, direction, i, t, t AS start, w, [rung] AS rungs, 1 AS k FROM e WHERE i = 1 UNION ALL SELECT e.instrument, e.direction, e.i, e.t, CASE WHEN j THEN start ELSE e.t END, CASE WHEN j THEN greatest(p.w, e.w) ELSE e.w END, CASE WHEN j THEN list_append(rungs, e.rung) ELSE [e.rung] END, k + CASE WHEN j THEN 0 ELSE 1 END
 FROM (SELECT r.*, NOT list_contains(r.rungs, n.rung) AND n.t - r.start <= greatest(r.w, n.w) AS j FROM r JOIN e n ON n.instrument = r.instrument AND n.direction = r.direction AND n.i = r.i + 1) p JOIN e ON e.instrument = p.instrument AND e.direction = p.direction AND e.i = p.i + 1)"""


@register(f"""{_CLUSTERS}
SELECT instrument, direction, min(start) AS start_t, max(t) AS known_at, max(len(rungs)) AS k, array_to_string(arg_max(rungs, i), '>') AS rungs FROM r GROUP BY instrument, direction, k HAVING max(len(rungs)) >= 2""")
def f_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of flips of one direction over rungs."""
    flips, keys = ladder_flips(spark, sf_dir).withColumnRenamed("timeframe", "rung"), ["instrument", "direction"]
    return folds.fold(folds.last_marked(flips, keys, ["t", "rung"]), folds.clusters({n: 2 * s for n, s in SECONDS.items()}), folds.CLUSTER, keys, ("t", "rung"))


@register(f"""WITH {BARS}, x AS (SELECT *, lead(c, 5) OVER {W} - c AS f FROM bars), g AS (SELECT instrument, avg(CASE WHEN c > o THEN f END) AS ma, avg(CASE WHEN c <= o THEN f END) AS mb, var_samp(CASE WHEN c > o THEN f END) AS va, var_samp(CASE WHEN c <= o THEN f END) AS vb, count(CASE WHEN c > o THEN f END) AS na, count(CASE WHEN c <= o THEN f END) AS nb FROM x GROUP BY 1),
z AS (SELECT instrument AS test, abs((ma - mb) / sqrt(va / na + vb / nb)) AS z FROM g), y AS (SELECT *, 1 / (1 + z / sqrt(2.0) * 0.3275911) AS k FROM z), t AS (SELECT test, round(2 * (1 - (1 + (1 - (((((1.061405429 * k - 1.453152027) * k) + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-z * z / 2))) / 2), 8) AS p FROM y),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY p, test) AS INT) AS rank, count(*) OVER () AS m FROM t)
SELECT test, p, rank, p <= 0.05 / m AS bonferroni, min(CASE WHEN p <= 0.05 / (m - rank + 1) THEN 1 ELSE 0 END) OVER (ORDER BY rank) = 1 AS holm, coalesce(rank <= max(CASE WHEN p <= 0.05 * rank / m THEN rank END) OVER (), false) AS benjamini_hochberg FROM r""")
def q_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: verdicts on the differences of ``q_welch``, corrected for the number of tests."""
    t = R.welch(O.forward_return(hourly(spark, sf_dir), 5), "fwd", c("c") > c("o"), ["instrument"])
    return R.corrected(t.select(c("instrument").alias("test"), F.round("p", 8).alias("p"))).select("test", "p", "rank", "bonferroni", "holm", "benjamini_hochberg")

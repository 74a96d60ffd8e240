"""Registered queries over scans by blocks: adaptive bands, pools of zones and of pivots. Their SQL goes bar by bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recursive, windows
from ..operators import scans
from ..operators import structure as P
from ..schema import KEY
from ..sources import tables as S
from .series import BARS, W, hourly, last, register, rounded

c = F.col


def _atr(n: int) -> str:
    """CTEs that end in ``wa`` (instrument, bar_idx, atr): Wilder's mean of the true range."""
    before = f"lag(c) OVER {W}"
    return f"""tr0 AS (SELECT *, CASE WHEN {before} IS NULL THEN h - l ELSE greatest(h - l, abs(h - {before}), abs(l - {before})) END AS tr FROM bars),
tr1 AS (SELECT *, avg(tr) OVER {last(n)} AS m FROM tr0),
wa AS (SELECT instrument, bar_idx, m AS atr FROM tr1 WHERE bar_idx = {n - 1}
  UNION ALL SELECT q.instrument, q.bar_idx, wa.atr * {n - 1} / {n} + q.tr / {n} FROM wa JOIN tr1 q ON q.instrument = wa.instrument AND q.bar_idx = wa.bar_idx + 1)"""


def _mean(own: str, others: str) -> str:
    near = " AND ".join(f"abs(x - {own}) < abs(x - {o})" for o in others)
    return f"coalesce(list_avg(list_filter(vs, lambda x: {near})), {own})"


_CENTRES = f"""{BARS}, {_atr(10)},
vs AS (SELECT instrument, bar_idx, atr, list(atr) OVER {last(100)} AS vs FROM wa),
km AS (SELECT instrument, bar_idx, atr, 0 AS i, vs, list_min(vs) + (list_max(vs) - list_min(vs)) * 0.75 AS ka, list_min(vs) + (list_max(vs) - list_min(vs)) * 0.5 AS kb,
    list_min(vs) + (list_max(vs) - list_min(vs)) * 0.25 AS kc, false AS done FROM vs WHERE len(vs) = 100
  UNION ALL SELECT instrument, bar_idx, atr, i + 1, vs, na, nb, nc, na = ka AND nb = kb AND nc = kc
    FROM (SELECT *, {_mean("ka", ("kb", "kc"))} AS na, {_mean("kb", ("ka", "kc"))} AS nb, {_mean("kc", ("ka", "kb"))} AS nc FROM km WHERE NOT done AND i < 200)),
centres AS (SELECT instrument, bar_idx, atr, ka, kb, kc FROM km WHERE done OR i = 200)"""


@register(f"WITH RECURSIVE {_CENTRES} SELECT instrument, bar_idx, round(ka, 6) AS high, round(kb, 6) AS middle, round(kc, 6) AS low FROM centres")
def w_volatility_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three volatility clusters of the last 100 bars."""
    b = windows.bounded(recursive.atr(hourly(spark, sf_dir), 10), 100, lambda w: {"centres": windows.three_means("atr", w)})
    names = [F.round(c("centres")[i], 6).alias(n) for i, n in enumerate(("high", "middle", "low"))]
    return b.where("centres IS NOT NULL").select("instrument", "bar_idx", *names)


@register(f"""WITH RECURSIVE {_CENTRES},
wd AS (SELECT b.instrument, b.bar_idx, b.c, (h + l) / 2 AS mid, CASE WHEN abs(atr - ka) <= least(abs(atr - kb), abs(atr - kc)) THEN 0 WHEN abs(atr - kb) <= abs(atr - kc) THEN 1 ELSE 2 END AS i, ka, kb, kc
  FROM centres k JOIN bars b ON b.instrument = k.instrument AND b.bar_idx = k.bar_idx WHERE b.bar_idx >= 110),
bd AS (SELECT instrument, bar_idx, c, ['HIGH', 'MEDIUM', 'LOW'][i + 1] AS regime, mid + [ka, kb, kc][i + 1] * 3 AS up, mid - [ka, kb, kc][i + 1] * 3 AS low FROM wd),
rt AS (SELECT instrument, bar_idx, c, up, low, 1 AS side, regime FROM bd WHERE bar_idx = 110
  UNION ALL SELECT instrument, bar_idx, c, nu, nl, CASE WHEN side = 1 THEN CASE WHEN c > nu THEN -1 ELSE 1 END ELSE CASE WHEN c < nl THEN 1 ELSE -1 END END, regime
    FROM (SELECT bd.instrument, bd.bar_idx, bd.c, bd.regime, rt.side, CASE WHEN bd.up < rt.up OR rt.c > rt.up THEN bd.up ELSE rt.up END AS nu, CASE WHEN bd.low > rt.low OR rt.c < rt.low THEN bd.low ELSE rt.low END AS nl
      FROM rt JOIN bd ON bd.instrument = rt.instrument AND bd.bar_idx = rt.bar_idx + 1))
SELECT instrument, bar_idx, side AS direction, round(CASE WHEN side = -1 THEN low ELSE up END, 6) AS line, regime FROM rt""")
def f_supertrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive bands, scanned by blocks."""
    return rounded(scans.supertrend(hourly(spark, sf_dir), block=128).where("direction IS NOT NULL"), "instrument", "bar_idx", "direction", "line", "regime")


def _zone_pool_sql(most: int = 3, life: int = 200, spread: float = 0.6) -> str:
    zone = "STRUCT(price DOUBLE, created BIGINT, expires BIGINT)[]"
    return f"""WITH RECURSIVE {BARS}, {_atr(14)},
pb AS (SELECT bars.*, wa.atr FROM bars LEFT JOIN wa ON wa.instrument = bars.instrument AND wa.bar_idx = bars.bar_idx),
pv AS (SELECT pb.*, CASE WHEN count(h) OVER a = 5 AND count(h) OVER b = 5 AND lag(h, 5) OVER {W} > max(h) OVER a AND lag(h, 5) OVER {W} > max(h) OVER b THEN lag(h, 5) OVER {W} END AS p
  FROM pb
  WINDOW a AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING), b AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
cd AS (SELECT instrument, bar_idx, l, h, atr, CASE WHEN atr IS NOT NULL THEN p END AS p FROM pv),
zp AS (SELECT DISTINCT instrument, CAST(-1 AS BIGINT) AS bar_idx, CAST([] AS {zone}) AS pool, CAST([] AS {zone}) AS gone, CAST([] AS {zone}) AS evicted FROM bars
  UNION ALL SELECT instrument, bar_idx, list_transform(p2, lambda z: {{'price': z.price, 'created': z.created, 'expires': CASE WHEN l <= z.price AND h >= z.price THEN bar_idx + {life} ELSE z.expires END}}),
    gone, CASE WHEN opens AND len(p1) = {most} THEN [{{'price': p1[1].price, 'created': p1[1].created, 'expires': bar_idx}}] ELSE [] END
  FROM (SELECT *, CASE WHEN opens THEN list_append(CASE WHEN len(p1) = {most} THEN p1[2:] ELSE p1 END, {{'price': p, 'created': bar_idx, 'expires': bar_idx + {life}}}) ELSE p1 END AS p2
    FROM (SELECT *, p IS NOT NULL AND len(list_filter(p1, lambda z: abs(z.price - p) <= {spread} * atr)) = 0 AS opens
      FROM (SELECT cd.*, list_filter(zp.pool, lambda z: z.expires >= cd.bar_idx) AS p1, list_filter(zp.pool, lambda z: z.expires < cd.bar_idx) AS gone
        FROM zp JOIN cd ON cd.instrument = zp.instrument AND cd.bar_idx = zp.bar_idx + 1)))),
zs AS (SELECT instrument, unnest(gone) AS z, 'expired' AS status FROM zp UNION ALL SELECT instrument, unnest(evicted), 'evicted_by_capacity' FROM zp
  UNION ALL SELECT instrument, unnest(pool), 'active' FROM zp WHERE (instrument, bar_idx) IN (SELECT (instrument, max(bar_idx)) FROM bars GROUP BY instrument))
SELECT instrument, round(z.price, 6) AS price, z.created AS created_idx, z.expires AS expires_idx, status FROM zs"""


@register(_zone_pool_sql())
def f_zone_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line zones from pivots, refreshed by touches, at most three at a time, scanned by blocks."""
    b = S.kept(recursive.atr(hourly(spark, sf_dir), 14))
    pivots = b.withColumn("price", P.pivot("h", 5, 5, windows.series())).where("price IS NOT NULL AND atr IS NOT NULL")
    return rounded(scans.zone_pool(b, pivots, block=128).drop("timeframe"))


@register(f"""WITH RECURSIVE {BARS}, {_atr(14)},
pb AS (SELECT bars.*, wa.atr FROM bars LEFT JOIN wa ON wa.instrument = bars.instrument AND wa.bar_idx = bars.bar_idx),
pv AS (SELECT pb.*, CASE WHEN count(h) OVER a = 3 AND count(h) OVER b = 3 AND lag(h, 3) OVER {W} > max(h) OVER a AND lag(h, 3) OVER {W} >= max(h) OVER b THEN lag(h, 3) OVER {W} END AS p
  FROM pb
  WINDOW a AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING), b AS (PARTITION BY instrument ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
pw AS (SELECT instrument, bar_idx, p, atr, list_reverse(list({{'b': bar_idx, 'p': p}}) OVER {last(50)}) AS r FROM pv WHERE p IS NOT NULL AND atr IS NOT NULL),
pk AS (SELECT *, coalesce(nullif(list_position(list_transform(r, lambda z: abs(z.p - p) > 0.4 * atr), true), 0) - 1, len(r)) AS k FROM pw),
pe AS (SELECT instrument, bar_idx, r[k].b AS start_idx, list_min(list_transform(r[1:k], lambda z: z.p)) AS lo, list_max(list_transform(r[1:k], lambda z: z.p)) AS hi, k AS n FROM pk WHERE k >= 3),
ph AS (SELECT pe.instrument, pe.bar_idx, start_idx, lo, hi, n, min(b.bar_idx) AS hit FROM pe LEFT JOIN bars b ON b.instrument = pe.instrument AND b.bar_idx > pe.bar_idx AND b.h > hi GROUP BY ALL),
pf AS (SELECT *, CASE WHEN row_number() OVER s = 1 THEN 1 WHEN lag(hit) OVER s IS NOT NULL AND lag(hit) OVER s <= bar_idx THEN 1 ELSE 0 END AS f FROM ph WINDOW s AS (PARTITION BY instrument, start_idx ORDER BY bar_idx)),
pg AS (SELECT *, sum(f) OVER (PARTITION BY instrument, start_idx ORDER BY bar_idx) AS g FROM pf)
SELECT instrument, start_idx, min(bar_idx) AS known_idx, round(arg_max(lo, bar_idx), 6) AS lo, round(arg_max(hi, bar_idx), 6) AS hi, CAST(arg_max(n, bar_idx) AS BIGINT) AS n,
  last(hit ORDER BY bar_idx) AS broken_idx FROM pg GROUP BY instrument, start_idx, g""")
def f_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity pools of pivots and the bar that takes each."""
    b = S.kept(recursive.atr(hourly(spark, sf_dir), 14))
    pivots = b.withColumn("price", P.pivot("h", 3, 3, windows.series(), True, True, False)).where("price IS NOT NULL AND atr IS NOT NULL")
    return rounded(scans.liquidity_pools(pivots.select(*KEY, "bar_idx", "price", "atr"), b).drop("timeframe"))

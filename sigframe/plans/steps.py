"""Registered queries that step state machines over streams. Each is held against the same SQL as its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recursive, windows
from ..operators import folds, scans
from ..operators import structure as P
from ..schema import SECONDS
from ..sources import tables as S
from ..streaming import streams as M
from .marks import _CLUSTERS, ladder_flips
from .scanned import _zone_pool_sql
from .series import BARS, SQL, hourly, register, rounded

c = F.col
PARTS = 4


def fed(df: DataFrame, at: str) -> tuple[DataFrame, str]:
    """Rows as files that come one by one, in the order of ``at``, and the folder they are in."""
    spark, path = df.sparkSession, S.shared_dir(df.sparkSession)
    df = S.kept(df)
    last = df.agg(F.max(at)).first()[0] or 0
    for k in range(PARTS):
        part = df.where((c(at) * PARTS >= k * (last + 1)) & (c(at) * PARTS < (k + 1) * (last + 1)))
        part.coalesce(1).write.mode("append").parquet(f"{path}/rows")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/rows"), path


@register(f"""WITH RECURSIVE {BARS}, em AS (SELECT instrument, bar_idx, c AS y FROM bars WHERE bar_idx = 0 UNION ALL SELECT b.instrument, b.bar_idx, em.y + 0.2::DOUBLE * (b.c - em.y) FROM em JOIN bars b ON b.instrument = em.instrument AND b.bar_idx = em.bar_idx + 1)
SELECT instrument, bar_idx, round(y, 6) AS y FROM em""")
def m_affine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential mean, bar by bar over a stream."""
    stream, path = fed(hourly(spark, sf_dir).select("instrument", "bar_idx", "c"), "bar_idx")
    return rounded(M.replay(M.stepped(stream, folds.affine(0.2), folds.AFFINE, ["instrument"], "bar_idx"), path))


@register(SQL["f_supertrend"])
def m_band_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive bands, bar by bar over a stream."""
    stream, path = fed(scans.band_inputs(hourly(spark, sf_dir)).select("instrument", "bar_idx", "c", "hl2", "width", "regime"), "bar_idx")
    return rounded(M.replay(M.stepped(stream, folds.ratchet, folds.RATCHET, ["instrument"], "bar_idx"), path))


@register(f"SELECT * FROM ({_zone_pool_sql()}) WHERE status <> 'active'")
def m_pool_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of line zones over a stream of candidates and bars; zones that stand at the end have not gone yet."""
    b = S.kept(recursive.atr(hourly(spark, sf_dir), 14))
    none = F.lit(None).cast("double")
    pivots = b.withColumn("price", P.pivot("h", 5, 5, windows.series())).where("price IS NOT NULL AND atr IS NOT NULL")
    first = pivots.select("instrument", "bar_idx", (c("bar_idx") * 2).alias("place"), F.lit("candidate").alias("kind"), "price", "atr", none.alias("low"), none.alias("high"))
    bar = b.select("instrument", "bar_idx", (c("bar_idx") * 2 + 1).alias("place"), F.lit("touch").alias("kind"), none.alias("price"), "atr", c("l").alias("low"), c("h").alias("high"))
    stream, path = fed(first.unionByName(bar), "bar_idx")
    return rounded(M.replay(M.stepped(stream, folds.zone_pool(), folds.ZONE_POOL, ["instrument"], "place"), path))


@register(f"{_CLUSTERS} SELECT instrument, direction, min(start) AS start_t, max(t) AS known_at, max(len(rungs)) AS k, array_to_string(arg_max(rungs, i), '>') AS rungs FROM (SELECT *, max(k) OVER (PARTITION BY instrument, direction) AS last_k FROM r) WHERE k < last_k GROUP BY instrument, direction, k HAVING max(len(rungs)) >= 2")
def m_cluster_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of flips over a stream; the last one of each key is still open."""
    flips = ladder_flips(spark, sf_dir).select("instrument", c("direction").cast("string").alias("direction"), c("timeframe").alias("rung"), "t")
    flips = flips.withColumn("place", F.concat(F.lpad(c("t").cast("string"), 12, "0"), "rung"))
    lowest = S.kept(flips)
    begin = lowest.agg(F.min("t")).first()[0] or 0
    stream, path = fed(lowest.withColumn("since", c("t") - begin), "since")
    step = folds.clusters({n: 2 * s for n, s in SECONDS.items()})
    return M.replay(M.stepped(stream, step, folds.CLUSTER, ["instrument", "direction"], "place"), path)


"""Reading ticks and bars, putting sources together, and writing results by instrument and timeframe."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import epoch


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors all see; a temporary one only where nothing is set, on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        else:
            base = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sigframe-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its plan ends there, and what reads it several times does not build it again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the ``events`` table: (instrument, ts, seq, price, volume)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    volume = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_type").alias("instrument"), epoch(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), volume.alias("volume"))


def candle_csv(spark: SparkSession, path: str, instrument: str, timeframe: str) -> DataFrame:
    """Bars of a CSV with a header and ISO times, in UTC."""
    raw = spark.read.schema("timestamp string, open double, high double, low double, close double, volume double").csv(path, header=True)
    t = epoch(F.to_timestamp_ntz(F.regexp_replace("timestamp", r"(\.\d+)?(Z|\+00:00)?$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return raw.select(F.lit(instrument).alias("instrument"), F.lit(timeframe).alias("timeframe"), t.alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))


def binary_nanoseconds(column: str | Column) -> Column:
    """Seconds of an eight-byte little-endian count of nanoseconds."""
    c = F.hex(F.col(column) if isinstance(column, str) else column)
    swapped = F.concat(*[F.substring(c, k, 2) for k in range(15, 0, -2)])
    return F.floor(F.conv(swapped, 16, 10).cast("decimal(20,0)") / 1_000_000_000).cast("long")


def out_of_order(df: DataFrame, keys: list[str], t: str, ingest: str) -> DataFrame:
    """Rows of each key whose time is before that of the row ingested before it."""
    w = Window.partitionBy(*keys).orderBy(ingest)
    return df.withColumn("_before", F.lag(t).over(w)).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_before") > F.col(t), 1)), F.lit(0)).alias("out_of_order"))


def latest(df: DataFrame, keys: list[str], ingest: str) -> DataFrame:
    """One row for each key: the one ingested last. An aggregate, so a hot key is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ingest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(df.columns)


def splice(old: DataFrame, new: DataFrame, cut: int, keys: list[str], t: str = "t") -> DataFrame:
    """``old`` before the cut and ``new`` from it on."""
    return old.where(F.col(t) < cut).unionByName(new.where(F.col(t) >= cut))


def seam(old: DataFrame, new: DataFrame, cut: int, key: str, seconds: int) -> DataFrame:
    """Per key the step from the last close before a cut to the first open after it, and how complete either side is."""
    a = old.where(F.col("t") < cut).groupBy(key).agg(F.max_by("c", "t").alias("last_close"), F.max("t").alias("last_t"), F.min("t").alias("from_t"), F.count("*").alias("n_old"))
    b = new.where(F.col("t") >= cut).groupBy(key).agg(F.min_by("o", "t").alias("first_open"), F.min("t").alias("first_t"), F.max("t").alias("to_t"), F.count("*").alias("n_new"))
    share = lambda n, lo, hi: F.col(n) * 100.0 / ((F.col(hi) - F.col(lo)) / seconds + 1)
    return a.join(b, key, "full").withColumns({"gap": F.col("first_open") - F.col("last_close"), "old_coverage": share("n_old", "from_t", "last_t"), "new_coverage": share("n_new", "first_t", "to_t")})


def gap_fill(stored: DataFrame, fetched: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Fetched rows after each key's last stored one; all rows of keys that are not stored yet."""
    last = stored.groupBy(*keys).agg(F.max(t).alias("_last"))
    return fetched.join(last, keys, "left").where(F.col("_last").isNull() | (F.col(t) > F.col("_last"))).drop("_last")


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces whole (instrument, timeframe) partitions, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def runs(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count("*").alias("candle_count"), F.min("t").alias("range_start"), F.max("t").alias("range_end"))


def evolve(old: DataFrame, new: DataFrame, default_instrument: str) -> DataFrame:
    """Old rows that lack later columns, with new ones; the instrument of rows that have none is the default."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("instrument", F.coalesce("instrument", F.lit(default_instrument)))


def insert_new(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are not stored yet, each once."""
    return rows.dropDuplicates(keys).join(stored, keys, "left_anti")

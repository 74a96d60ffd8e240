"""The data model: bars, the ladder of timeframes, and how columns are named.

A bar is (instrument, timeframe, t, bar_idx, o, h, l, c, v); ``t`` is its opening in Unix seconds, and missing values are NULL, never NaN.
What a bar says is known when it has closed, at ``t`` plus the seconds of its timeframe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Timeframes from the slowest, with their seconds and where their buckets begin (weeks on Mondays).
LADDER = [("1w", 604800, 345600), ("1d", 86400, 0), ("4h", 14400, 0), ("3h", 10800, 0), ("2h", 7200, 0), ("1h", 3600, 0), ("15m", 900, 0), ("5m", 300, 0)]
SECONDS = {name: seconds for name, seconds, _ in LADDER}
OFFSET = {name: offset for name, _, offset in LADDER}
KEY = ["instrument", "timeframe"]

BAR = T.StructType([T.StructField(n, t) for n, t in [("instrument", T.StringType()), ("timeframe", T.StringType()), ("t", T.LongType()), ("bar_idx", T.LongType()), *[(x, T.DoubleType()) for x in "ohlcv"]]])
EVENT = T.StructType([T.StructField(n, t) for n, t in [("instrument", T.StringType()), ("timeframe", T.StringType()), ("family", T.StringType()), ("type", T.StringType()), ("side", T.StringType()), ("bar_idx", T.LongType()), ("t", T.LongType()), ("known_at", T.LongType()), ("price", T.DoubleType())]])


def ladder(spark: SparkSession) -> DataFrame:
    """The timeframes as a table of eight rows, slowest first."""
    rows = [(name, seconds, offset, i) for i, (name, seconds, offset) in enumerate(LADDER)]
    return spark.createDataFrame(rows, "timeframe string, seconds long, bucket_offset long, rung int")


def bucket(t: Column, seconds: int | Column, offset: int | Column = 0) -> Column:
    """The opening of the bucket that holds ``t``."""
    s, off = (x if isinstance(x, Column) else F.lit(x) for x in (seconds, offset))
    return (t - F.pmod(t - off, s)).cast("long")


def epoch(ts: Column) -> Column:
    """Unix seconds of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def closes(timeframe: str = "timeframe", t: str = "t") -> Column:
    """When a bar becomes known."""
    seconds = F.create_map(*[x for n, s in SECONDS.items() for x in (F.lit(n), F.lit(s))])
    return F.col(t) + seconds[F.col(timeframe)]


def surrogate(*columns: str) -> Column:
    """An id that is the same for the same row in every run."""
    return F.xxhash64(*columns)

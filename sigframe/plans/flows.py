"""Registered queries over sources, sinks and replayed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..schema import KEY
from ..sources import tables as S
from ..streaming import streams as M
from .relations import _DAYS, _TRADES, daily, trades
from .series import BARS, TICKS, hourly, register, rounded
from .studies import _RUNGS

c = F.col
#: The ticks come in so many slices of time at least, and in one for each so many ticks.
SLICES, SLICE_ROWS = 8, 100_000
#: A micro-batch takes so many slices at most.
TRIGGER = 8
#: A task compares so many pairs of events, about.
TASK_PAIRS = 10_000_000
#: Slices come in the order of time, so none is late; so far the watermark still stays behind.
LATE = "3600 seconds"
#: An instrument whose one tick, far ahead, lets the watermark pass everything.
END = "~end"


def sliced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The ticks with the number of their slice, how many slices there are, and the last time. Slices follow each other in (ts, seq), and are about equally large, however the ticks lie in time."""
    ticks, path = S.kept(S.ticks(spark, sf_dir)).where("ts IS NOT NULL"), S.shared_dir(spark)
    n, hi = ticks.agg(F.count("*"), F.max("ts")).first()
    dealt = ticks.repartitionByRange(max(SLICES, -(-n // SLICE_ROWS)), "ts", "seq").withColumn("slice", F.spark_partition_id())
    dealt.write.partitionBy("slice").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    return dealt, (dealt.agg(F.max("slice")).first()[0] or 0) + 1, hi or 0


def arrive(ticks: DataFrame, slices: range, path: str) -> None:
    """Slices in the order of time, each as one file, so that whatever files a micro-batch takes, no later one has ticks before its own."""
    for k in slices:
        part = ticks.where(c("slice") == k).drop("slice").withColumn("ts", F.timestamp_seconds("ts"))
        part.coalesce(1).write.mode("append").parquet(f"{path}/ticks")


def close(spark: SparkSession, path: str, hi: int) -> None:
    end = spark.createDataFrame([(END, hi + 400 * 86400, 0, 0.0, 0.0)], "instrument string, ts long, seq long, price double, volume double")
    end.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{path}/ticks")


def replayed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The ticks as files, written slice by slice in the order of time, and how late a tick may come."""
    path = S.shared_dir(spark)
    ticks, n, hi = sliced(spark, sf_dir)
    arrive(ticks, range(n), path)
    close(spark, path, hi)
    return path, LATE


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    return M.tick_stream(spark, f"{path}/ticks", files_per_trigger=TRIGGER)


@register(f"WITH {BARS} SELECT instrument, t, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 6) AS v FROM bars")
def m_bar_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4: bars of a replayed tick stream, once each can change no more."""
    path, late = replayed(spark, sf_dir)
    return rounded(M.replay(M.bar_stream(stream_of(spark, path), "1h", late), path).where(c("instrument") != END), "instrument", "t", *"ohlcv")


@register(f"""WITH {TICKS}, x AS (SELECT *, CASE WHEN ts - lag(ts) OVER k < 7201 THEN 0 ELSE 1 END AS n FROM ticks WINDOW k AS (PARTITION BY instrument ORDER BY ts, seq)), y AS (SELECT *, sum(n) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT instrument, min(ts) AS start_t, max(ts) + 7201 AS end_t, count(*) AS n, round(max(price), 6) AS h, round(min(price), 6) AS l FROM y GROUP BY instrument, s""")
def m_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: sessions of a stream that end after a gap."""
    path, late = replayed(spark, sf_dir)
    return rounded(M.replay(M.session_stream(stream_of(spark, path), "7201 seconds", late), path).where(c("instrument") != END))


@register(f"""WITH {TICKS}, x AS (SELECT instrument, seq, CAST(floor(price / 50) AS BIGINT) AS level, lag(CAST(floor(price / 50) AS BIGINT)) OVER (PARTITION BY instrument ORDER BY ts, seq) AS before FROM ticks) SELECT instrument, seq, level FROM x WHERE before IS NULL OR before <> level""")
def m_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: rows of a stream whose payload differs from the one before of their key."""
    path, _ = replayed(spark, sf_dir)
    ticks = stream_of(spark, path).where(c("instrument") != END)
    rows = ticks.select("instrument", F.unix_timestamp("ts").alias("t"), "seq", F.floor(c("price") / 50).alias("level"))
    return M.replay(M.changes(rows, ["instrument"], ["level"], ["t", "seq"]), path).select("instrument", "seq", "level")


@register(f"""WITH {TICKS}, x AS (SELECT *, CASE WHEN price BETWEEN 40 AND 60 THEN 'testing' WHEN price > 60 THEN 'above' ELSE 'below' END AS place FROM ticks), y AS (SELECT *, lag(place) OVER k AS p1, last_value(CASE WHEN place <> 'testing' THEN place END IGNORE NULLS) OVER u AS side FROM x WINDOW k AS (PARTITION BY instrument ORDER BY ts, seq), u AS (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT instrument, min({{'ts': ts, 'seq': seq}}) AS k FROM ticks GROUP BY 1), z AS (SELECT y.*, CASE WHEN p1 IS NULL THEN 'watching' WHEN place = 'testing' THEN 'testing' WHEN p1 = 'testing' THEN CASE WHEN place = coalesce(side, 'testing') THEN 'held' ELSE 'broken' END END AS s FROM y),
w AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS status FROM z), v AS (SELECT *, lag(status) OVER (PARTITION BY instrument ORDER BY ts, seq) AS b FROM w) SELECT instrument, ts AS t, status FROM v WHERE b IS NULL OR b <> status""")
def m_stepped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state machine over a stream, with the same step as in batch."""
    path, _ = replayed(spark, sf_dir)
    ticks = stream_of(spark, path).where(c("instrument") != END)
    rows = ticks.select("instrument", F.unix_timestamp("ts").alias("t"), "seq", c("price").alias("c"))
    return M.replay(M.stepped(rows, M.zone_lifecycle({}, (40.0, 60.0)), "t long, status string", ["instrument"], ["t", "seq"]), path)


@register(f"""WITH {_DAYS} SELECT k.instrument, k.seq, max(d.t) AS day, round(arg_max(d.c, d.t), 6) AS day_close FROM ticks k LEFT JOIN days d ON d.instrument = k.instrument AND d.t + 86400 <= k.ts GROUP BY 1, 2""")
def m_join_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick of a stream with the last bar of a slower rung that had closed by then, both sides as streams."""
    path, late = replayed(spark, sf_dir)
    days = daily(spark, sf_dir).where("timeframe = '1d'").select("instrument", F.timestamp_seconds(c("t") + 86400).alias("ts"), c("t").alias("day"), c("c").alias("day_close"))
    days.repartition(1).sortWithinPartitions("ts").write.parquet(f"{path}/days")
    ended = spark.read.parquet(f"{path}/ticks").where(c("instrument") == END)
    ended.select("instrument", "ts", F.lit(0).cast("long").alias("day"), F.lit(0.0).alias("day_close")).write.mode("append").parquet(f"{path}/days")
    closed = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/days")
    out = M.asof_stream(stream_of(spark, path).select("instrument", "ts", "seq"), closed, ["instrument"], ["day", "day_close"], late)
    got = M.replay(out, path).where(c("instrument") != END)
    return rounded(got.select("instrument", "seq", c("day_asof").alias("day"), c("day_close_asof").alias("day_close")))


@register(f"WITH {BARS} SELECT instrument, t, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 6) AS v FROM bars")
def m_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a stream that is stopped halfway and started again from its checkpoint, when more files have come."""
    path = S.shared_dir(spark)
    ticks, n, hi = sliced(spark, sf_dir)
    for slices in (range(n // 2), range(n // 2, n)):
        arrive(ticks, slices, path)
        if slices.stop == n:
            close(spark, path, hi)
        got = M.replay(M.bar_stream(stream_of(spark, path), "1h", LATE), path)
    return rounded(got.where(c("instrument") != END), "instrument", "t", *"ohlcv")


@register(f"""WITH {TICKS} SELECT a.seq, b.seq AS other FROM ticks a JOIN ticks b ON b.instrument = 'view' AND a.instrument = 'purchase' AND abs(b.ts - a.ts) <= 3600""")
def m_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two streams near each other in time."""
    path, late = replayed(spark, sf_dir)
    side = lambda n: stream_of(spark, path).where(c("instrument").isin(n, END)).select(F.when(c("instrument") == END, END).otherwise("all").alias("pool"), "ts", "seq")
    blocks = M.replay(M.nearby_blocks(side("purchase"), side("view"), "pool", "1 HOUR", late, ["seq"]), path).where(c("pool") != END)
    n = blocks.agg(F.sum(F.size("a").cast("long") * F.size("b"))).first()[0] or 0
    dealt = blocks.repartition(max(SLICES, -(-n // TASK_PAIRS)))
    return M.paired(dealt, "1 HOUR", [], ["seq"]).withColumnRenamed("other_seq", "other")


@register(f"""WITH {_TRADES} SELECT instrument, side, bar_idx, why AS status, round(pnl, 5) AS pnl_pct FROM trades""")
def m_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: a ledger in which trades are opened and later resolved, however often a batch comes."""
    t, _ = trades(spark, sf_dir)
    none = F.lit(None).cast("double")
    opened = t.select("event_id", "instrument", "side", "bar_idx", F.lit("open").alias("status"), none.alias("pnl_pct"), F.lit(0).alias("rank"))
    closed = t.select("event_id", "instrument", "side", "bar_idx", c("exit_reason").alias("status"), "pnl_pct", F.lit(1).alias("rank"))
    path = S.shared_dir(spark)
    for part in (opened, closed, opened):
        part.write.mode("append").parquet(f"{path}/rows")
    stream = spark.readStream.schema(closed.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/rows")
    M.run_batches(stream, M.upsert(f"{path}/ledger", ["event_id"], "rank"), f"{path}/checkpoint")
    return rounded(M.stored_table(spark, f"{path}/ledger", closed.schema), "instrument", "side", "bar_idx", "status", "pnl_pct", places=5)


@register(f"""WITH {TICKS} SELECT instrument, ts - ts % 86400 AS day, count(*) AS n, round(sum(price), 4) AS total FROM ticks GROUP BY 1, 2""")
def m_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: late ticks put into the days that they belong to; ticks that come twice count once."""
    t = S.kept(S.ticks(spark, sf_dir).withColumn("day", c("ts") - c("ts") % 86400))
    path = S.shared_dir(spark)
    S.replace_partitions(t.where("pmod(xxhash64(seq), 5) > 0"), f"{path}/days", ["day"])
    t.where("pmod(xxhash64(seq), 5) < 2").write.parquet(f"{path}/late")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/late")
    M.run_batches(stream, M.repaired(f"{path}/days", ["day"], lambda rows: S.latest(rows, ["instrument", "seq", "day"], "ts")), f"{path}/checkpoint")
    whole = spark.read.schema(t.schema).parquet(f"{path}/days")
    return whole.groupBy("instrument", "day").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("total"))


@register(f"""WITH {_RUNGS} SELECT instrument, timeframe, t, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c FROM x UNION ALL SELECT instrument, '1h', t, round(o, 6), round(h, 6), round(l, 6), round(c, 6) FROM bars""")
def m_rungs_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: late ticks, and the hours, four hours, days and weeks that they change built again, and no others."""
    t = S.kept(S.ticks(spark, sf_dir).withColumn("day", c("ts") - c("ts") % 86400))
    path = S.shared_dir(spark)
    for late in (False, True):  # every fifth tick comes late, and some that were there come twice
        t.where(F.pmod(F.xxhash64("seq"), F.lit(5)) < 2 if late else F.pmod(F.xxhash64("seq"), F.lit(5)) > 0).coalesce(1).write.mode("append").parquet(f"{path}/arrived")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arrived")
    M.run_batches(stream, M.rungs_repaired(f"{path}/days", f"{path}/bars", ["4h", "1d", "1w"], 8), f"{path}/checkpoint")
    bars = "instrument string, timeframe string, t long, o double, h double, l double, c double"
    return rounded(M.stored_table(spark, f"{path}/bars", bars))


@register(f"""WITH {TICKS}, k AS (SELECT *, price < 10 AS bad FROM ticks) SELECT instrument, arg_max(seq, {{'t': ts, 's': seq}}) FILTER (NOT bad) AS seq, round(arg_max(price, {{'t': ts, 's': seq}}) FILTER (NOT bad), 6) AS price, count(*) FILTER (bad) AS errors,
max(CASE WHEN bad THEN 'unreadable: {{"instrument":"' || instrument || '","ts":' || ts || ',"seq":' || seq || ',"price":"n/a"}}' END)[1:50] AS last_error, CASE instrument WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE instrument END AS symbol FROM k GROUP BY 1""")
def m_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each instrument of a stream, under its proxy's name, and its errors; lines with an unreadable price change no state."""
    path = S.shared_dir(spark)
    t = S.ticks(spark, sf_dir)
    price = F.when(c("price") < 10, F.lit('"n/a"')).otherwise(c("price").cast("string"))
    line = F.concat(F.lit('{"instrument":"'), "instrument", F.lit('","ts":'), "ts", F.lit(',"seq":'), "seq", F.lit(',"price":'), price, F.lit("}"))
    t.select(line.alias("value")).repartition(4).write.text(f"{path}/lines")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{path}/lines")
    rows = M.parsed(lines, "instrument string, ts long, seq long, price double", "instrument").withColumn("at", F.struct("ts", "seq"))
    state = M.status(rows, "instrument", ["seq", "price"], "at")
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/status")  # noqa: E731  a row for each instrument
    state.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    proxies = spark.createDataFrame([("click", "C"), ("view", "V")], "instrument string, proxy string")
    got = spark.read.parquet(f"{path}/status").join(F.broadcast(proxies), "instrument", "left")  # two rows of configuration
    got = got.withColumns({"symbol": F.coalesce("proxy", "instrument"), "last_error": F.substring("last_error", 1, 50)})
    return rounded(got, "instrument", "seq", "price", "errors", "last_error", "symbol")


@register(f"""WITH {BARS} SELECT 'tick' AS stream, instrument, ts AS t, round(price, 6) AS value FROM ticks UNION ALL SELECT 'bar', instrument, t, round(c, 6) FROM bars""")
def m_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of ticks and one of bars as JSON lines with their stream's name, read back."""
    path, late = replayed(spark, sf_dir)
    streams = {"tick": stream_of(spark, path).select("instrument", F.unix_timestamp("ts").alias("t"), c("price").alias("value")), "bar": M.bar_stream(stream_of(spark, path), "1h", late).select("instrument", "t", c("c").alias("value"))}
    for name, s in streams.items():
        M.json_sink(s, name, f"{path}/json/{name}", f"{path}/checkpoint/{name}").trigger(availableNow=True).start().awaitTermination()
    lines = spark.read.schema("instrument string, t long, value double, _ts long, _stream string").json([f"{path}/json/{n}" for n in streams])
    return rounded(lines.where((c("_ts") > 0) & (c("instrument") != END)).select(c("_stream").alias("stream"), "instrument", "t", "value"))


@register(f"""WITH {BARS} SELECT 'all' AS instrument, timeframe, t, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 6) AS v FROM bars""")
def s_candle_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as a CSV with ISO times and read back."""
    path = S.shared_dir(spark)
    iso = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
    hourly(spark, sf_dir).select(iso.alias("timestamp"), *[c(k).alias(n) for k, n in names.items()]).write.option("header", True).csv(path)
    return rounded(S.candle_csv(spark, path, "all", "1h"))


@register(f"""WITH {TICKS} SELECT seq, ts, ts AS again FROM ticks""")
def s_binary_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: times as eight bytes of little-endian nanoseconds, read back."""
    t = S.ticks(spark, sf_dir).select("seq", "ts")
    big = F.lpad(F.hex(c("ts") * 1_000_000_000), 16, "0")
    little = F.unhex(F.concat(*[F.substring(big, k, 2) for k in range(15, 0, -2)]))
    return t.withColumn("again", S.binary_nanoseconds(little))


@register(f"""WITH {BARS} SELECT instrument, count(*) AS n, round(sum(CASE WHEN instrument IN ('click', 'view') THEN c + 1 ELSE c END), 4) AS total FROM bars GROUP BY 1""")
def s_replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole instruments replaced, the others left as they are."""
    b, path = hourly(spark, sf_dir), S.shared_dir(spark)
    S.replace_partitions(b, path, KEY)
    S.replace_partitions(b.where("instrument IN ('click', 'view')").withColumn("c", c("c") + 1), path, KEY)
    return spark.read.schema(b.schema).parquet(path).groupBy("instrument").agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("total"))


@register(f"""WITH {_TRADES} SELECT instrument, count(*) AS n, round(sum(r), 4) AS r FROM trades GROUP BY 1""")
def s_json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results written as JSON and read back."""
    t, _ = trades(spark, sf_dir)
    path = S.shared_dir(spark)
    row = F.struct("side", "bar_idx", "r")
    t.select("instrument", F.struct(row.alias("trade"), F.lit("barrier").alias("kind")).alias("result")).write.json(path)
    back = spark.read.schema("instrument string, result struct<trade: struct<side: string, bar_idx: long, r: double>, kind: string>").json(path)
    return back.groupBy("instrument").agg(F.count("*").alias("n"), F.round(F.sum("result.trade.r"), 4).alias("r"))


@register(f"""WITH {_TRADES} SELECT count(*) AS parents, CAST(count(*) AS BIGINT) AS children, CAST(count(DISTINCT (instrument, side, bar_idx)) AS BIGINT) AS ids FROM trades""")
def s_surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with ids that agree in every run, and children keyed to them."""
    parents, _ = trades(spark, sf_dir)
    again = parents.select("instrument", "side", "bar_idx", "exit_idx")
    children = again.withColumn("event_id", F.xxhash64("instrument", "side", "bar_idx"))
    joined = parents.select("event_id").join(children, "event_id")
    return joined.agg(F.count("*").alias("parents"), F.count("exit_idx").alias("children"), F.countDistinct("event_id").alias("ids"))

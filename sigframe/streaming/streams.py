"""The same operators over streams: bars from ticks, changes, state machines, late data and ledgers.

Streams are event-time DataFrames. Results over a replayed stream equal the batch operators' once the watermark has passed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import from_ticks, rollup
from ..operators.folds import Step
from ..schema import OFFSET, SECONDS, bucket
from ..sources.tables import kept, latest, replace_partitions

TICK = T.StructType([T.StructField("instrument", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])


def tick_stream(spark: SparkSession, path: str, schema: T.StructType = TICK, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from Parquet files as they arrive; where it left off is kept by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bar_stream(ticks: DataFrame, timeframe: str, late: str = "1 hour") -> DataFrame:
    """Bars by tumbling windows: in update mode the last bar as it grows, in append mode each bar once it can change no more."""
    at = F.struct("ts", "seq")
    window = F.window("ts", f"{SECONDS[timeframe]} seconds", f"{SECONDS[timeframe]} seconds", f"{OFFSET[timeframe]} seconds")
    rows = ticks.withWatermark("ts", late).groupBy("instrument", window.alias("w"))
    out = rows.agg(F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.sum("volume").alias("v"))
    return out.select("instrument", F.lit(timeframe).alias("timeframe"), F.unix_timestamp("w.start").alias("t"), "o", "h", "l", "c", "v")


def session_stream(ticks: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap without ticks."""
    rows = ticks.withWatermark("ts", late).groupBy("instrument", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("price").alias("h"), F.min("price").alias("l"))
    return rows.select("instrument", F.unix_timestamp("w.start").alias("start_t"), F.unix_timestamp("w.end").alias("end_t"), "n", "h", "l")


def _plain(v: Any) -> Any:
    """A value of a frame as JSON has it, the same whether its column held nulls (and so floats) or not."""
    if pd.isna(v):
        return None
    v = v.item() if isinstance(v, np.generic) else v
    return int(v) if isinstance(v, float) and v.is_integer() else v


def changes(stream: DataFrame, keys: list[str], payload: list[str], order: str | list[str]) -> DataFrame:
    """Rows whose payload differs from the one before of their key; nulls and NaN are equal. Rows of equal ``order`` come by their payload, so that every run agrees.

    Rows of a micro-batch are compared as columns with those before them; only the payload of the last one is state, as JSON.
    """
    order = [order] if isinstance(order, str) else order
    schema = T.StructType([f for f in stream.schema.fields if f.name in (*keys, *payload, *order)])
    names = schema.fieldNames()

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)[names].sort_values([*order, *payload], kind="stable")
        now, before = rows[payload], rows[payload].shift()
        new = ~((now == before) | (now.isna() & before.isna())).all(axis=1).to_numpy()
        edge = lambda k: json.dumps([_plain(v) for v in now.iloc[k]], default=str)
        new[0] = not state.exists or state.get[0] != edge(0)
        state.update((edge(-1),))
        yield rows[new]

    return stream.select(*names).groupBy(*keys).applyInPandasWithState(work, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def stepped(stream: DataFrame, step: Step, schema: str, keys: list[str], order: str | list[str]) -> DataFrame:
    """A fold's step function over a stream: state lives from one micro-batch to the next, rows of a micro-batch are put in order."""
    names = [x.split()[0] for x in schema.split(", ")]
    out_schema = ", ".join([*[f"{k} string" for k in keys], schema])

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        got: list[tuple[Any, ...]] = []
        for row in pd.concat(list(batches)).sort_values(order).to_dict("records"):
            clean = {k: None if isinstance(v, float) and v != v else v for k, v in row.items()}
            got += [(*key, *(r.get(n) for n in names)) for r in step(held, clean)]
        state.update((json.dumps(held),))
        yield pd.DataFrame(got, columns=[*keys, *names])

    return stream.groupBy(*keys).applyInPandasWithState(work, out_schema, "state string", "append", GroupStateTimeout.NoTimeout)


def zone_lifecycle(bounds: dict[str, tuple[float, float]], others: tuple[float, float] | None = None) -> Step:
    """Watching, testing, held or broken, by the close of each bar against a zone of its instrument, or that of all others; a row for each change."""

    def step(state: dict, r: dict) -> list[dict]:
        zone = bounds.get(r["instrument"], others)
        if zone is None:
            return []
        lo, hi = zone
        now = "testing" if lo <= r["c"] <= hi else "above" if r["c"] > hi else "below"
        before, side = state.get("at"), state.get("side")
        status = "watching" if before is None else "testing" if now == "testing" else ("held" if now == side else "broken") if before == "testing" else state["status"]
        out = [{"t": r["t"], "status": status}] if status != state.get("status") else []
        state.update(at=now, status=status, side=side if now == "testing" and side else now)
        return out

    return step


def _stored(rows: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream, which keeps types and all digits."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


#: The layout of the state of ``asof_stream``; state of another layout is an error, not a guess.
ASOF_VERSION = 2


def asof_stream(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], late: str = "1 hour") -> DataFrame:
    """Rows of ``left`` (keys, ts, ..) with the ``values`` of the row of ``right`` (keys, ts, values) that is the last one at or before them.

    Of a slower rung ``ts`` is when its bar has closed. Rows of both sides wait until the watermark, which is that of the slower side, has passed them; then no row can come any more that lies
    before them, and each left row gets its right row, once. A key's state is its last right row and what still waits, as Arrow; an event-time timer wakes a key whose rows all lie before the watermark.
    A task holds what of a key waits and comes with one micro-batch, so the stream's trigger bounds its memory.
    """
    cols = [f for f in left.schema.fields if f.name not in keys]
    vals = [f for f in right.schema.fields if f.name in values]
    own = [c.name for c in cols if c.name != "ts"]
    names = [*own, *[f"{v}_asof" for v in values]]
    a = left.withWatermark("ts", late).select(*keys, "ts", F.lit(1).alias("side"), *own, *[F.lit(None).cast(f.dataType).alias(f"{f.name}_asof") for f in vals])
    b = right.withWatermark("ts", late).select(*keys, "ts", F.lit(0).alias("side"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in cols if f.name != "ts"], *[F.col(v).alias(f"{v}_asof") for v in values])
    out = T.StructType([T.StructField(k, left.schema[k].dataType) for k in keys] + [T.StructField("ts", T.TimestampType())] + [T.StructField(c, left.schema[c].dataType) for c in own] + [T.StructField(f"{f.name}_asof", f.dataType) for f in vals])

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, last, waiting = state.get if state.exists else (ASOF_VERSION, "", b"")
        if version != ASOF_VERSION:
            raise ValueError(f"state of layout {version}, not {ASOF_VERSION}")
        parts = [] if state.hasTimedOut else [x[["ts", "side", *names]].assign(ts=x["ts"].astype("datetime64[us]").astype("int64")) for x in batches]
        if waiting:
            parts.insert(0, pa.ipc.open_stream(waiting).read_pandas())
        rows = pd.concat([p for p in parts if len(p)] or [pd.DataFrame(columns=["ts", "side", *names])], ignore_index=True)
        mark = state.getCurrentWatermarkMs() * 1000
        done = (rows["ts"] <= mark).to_numpy(bool)
        ready = rows[done].sort_values(["ts", "side"], kind="stable")
        rest = rows[~done]
        before = pd.DataFrame([json.loads(last)], columns=names) if last else pd.DataFrame([[None] * len(names)], columns=names)
        is_right = (ready["side"] == 0).to_numpy(bool)
        met = np.cumsum(is_right)  # the right row that a row has met; 0 is the one before this batch
        table = pd.concat([before.astype(object), ready.loc[is_right, names].astype(object)], ignore_index=True)
        if is_right.any():
            last = json.dumps([None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in table.iloc[-1]])
        state.update((ASOF_VERSION, last, _stored(rest) if len(rest) else b""))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["ts"].min()) // 1000, int(mark) // 1000 + 1))
        left_rows = ready[~is_right]
        if len(left_rows):
            got = left_rows[["ts", *own]].copy()
            for v in values:
                got[f"{v}_asof"] = table[f"{v}_asof"].to_numpy()[met[~is_right]]
            got["ts"] = pd.to_datetime(got["ts"].astype("int64"), unit="us")
            for k, v in zip(keys, key, strict=True):
                got[k] = v
            for f in out.fields:  # whole numbers that may be missing
                if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                    got[f.name] = got[f.name].astype("Int64")
                elif isinstance(f.dataType, T.DoubleType):
                    got[f.name] = got[f.name].astype(float)
            yield got[out.fieldNames()]

    grouped = a.unionByName(b).groupBy(*keys)
    return grouped.applyInPandasWithState(work, out, "version int, last string, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


#: A block holds so many rows at most, so a pair of blocks stands for at most the square of it.
BLOCK = 512


def _blocks(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows (key, cell, ts, values) as blocks (key, cell, first, ts, rows): rows of one key and cell in the order of time, with their first and last times. A block is made from what lies in one Arrow batch, so it needs no state."""
    names = ["ts", *values]
    one = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names])
    types = {key: rows.schema[key].dataType, "cell": T.LongType(), "first": rows.schema["ts"].dataType, "ts": rows.schema["ts"].dataType, "rows": T.ArrayType(one)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k, cell, at = batch.column(key).dictionary_encode().indices.to_numpy(), batch.column("cell").to_numpy(), batch.column("ts").cast(pa.int64()).to_numpy()
            order = np.lexsort((at, cell, k))
            new = np.flatnonzero(np.r_[True, (np.diff(k[order]) != 0) | (np.diff(cell[order]) != 0)])
            begin = np.concatenate([np.arange(i, j, BLOCK) for i, j in zip(new, [*new[1:], len(order)], strict=True)])
            end = np.r_[begin[1:], len(order)]
            put = batch.take(pa.array(order))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(order)], pa.int32()), pa.StructArray.from_arrays([put.column(n) for n in names], names))
            own = [put.column(n).take(pa.array(i)) for n, i in ((key, begin), ("cell", begin), ("ts", begin), ("ts", end - 1))]
            yield pa.RecordBatch.from_arrays([*own, lists], list(types))

    return rows.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).mapInArrow(work, T.StructType([T.StructField(*f) for f in types.items()]))


def _micros(within: str) -> Column:
    return F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00+00:00' + INTERVAL {within})")


def nearby_blocks(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "1 hour", values: list[str] | None = None) -> DataFrame:
    """Pairs of blocks (key, a, b) of events (key, ts, values) of two streams that may hold events at most ``within`` (days to seconds) apart; ``paired`` makes the pairs of events from them.

    Time is cut into cells as long as ``within``: a left event lies in one, a right one is put into its own and the two beside it, so each pair meets once, in its left event's cell. Events of a cell
    wait and meet as blocks, each with its last time as its own: state and work grow with the blocks, not with the pairs, and neither a key nor a cell is held as a whole.
    """
    cell = F.floor(F.unix_micros("ts") / _micros(within)).alias("cell")
    side = lambda rows: _blocks(rows.select(key, cell, "ts", *(values or [])), key, values or []).withWatermark("ts", late)
    a, b = side(left).alias("a"), side(right).withColumn("cell", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1))).alias("b")
    # the last times of blocks that meet are less than two cells apart, which bounds how long one waits; one more, for a day in local time may have 23 hours
    waits = f"b.ts BETWEEN a.ts - 3 * INTERVAL {within} AND a.ts + 3 * INTERVAL {within}"
    near = (F.unix_micros("b.first") - F.unix_micros("a.ts") <= _micros(within)) & (F.unix_micros("a.first") - F.unix_micros("b.ts") <= _micros(within))
    met = a.join(b, F.expr(f"a.{key} = b.{key} AND a.cell = b.cell AND {waits}") & near)
    return met.select(f"a.{key}", F.col("a.rows").alias("a"), F.col("b.rows").alias("b"))


def paired(blocks: DataFrame, within: str, keys: list[str], values: list[str]) -> DataFrame:
    """Pairs of events (keys, and ``values`` of both) at most ``within`` apart, from the pairs of blocks that ``nearby_blocks`` finds, of a stream or a table. A left event's pairs are a range of the right block, which is in order."""
    others = [f"other_{v}" for v in values]
    types = {k: blocks.schema[k].dataType for k in keys}
    for side, names in (("a", values), ("b", others)):
        types |= {n: blocks.schema[side].dataType.elementType[v].dataType for n, v in zip(names, values, strict=True)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(side)[i].values for side in "ab")
                at, other = (x.field("ts").cast(pa.int64()).to_numpy() for x in (a, b))
                reach = batch.column("reach")[i].as_py()
                low, high = np.searchsorted(other, at - reach, "left"), np.searchsorted(other, at + reach, "right")
                n = high - low
                end = np.cumsum(n)
                if end[-1]:
                    mine, its = pa.array(np.repeat(np.arange(len(n)), n)), pa.array(np.arange(end[-1]) + np.repeat(low - (end - n), n))
                    own = [pa.repeat(batch.column(k)[i], int(end[-1])) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, *(a.field(v).take(mine) for v in values), *(b.field(v).take(its) for v in values)], list(types))

    return blocks.select(*keys, "a", "b", _micros(within).alias("reach")).mapInArrow(work, T.StructType([T.StructField(*f) for f in types.items()]))


def nearby_streams(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "1 hour", values: list[str] | None = None) -> DataFrame:
    """Pairs of events (key, ts, values) of two streams at most ``within`` (days to seconds) apart, as a stream."""
    names = ["ts", *(values or [])]
    pairs = paired(nearby_blocks(left, right, key, within, late, values), within, [key], names)
    return pairs.select(key, *[n for v in names for n in (v, f"other_{v}")])


PARTS = 64


def upsert(path: str, keys: list[str], rank: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a table at ``path`` with one row for each key, that of the highest ``rank`` (open before resolved). A batch that comes twice changes nothing.

    The table is partitioned by a hash of the key; a batch rewrites the partitions that its keys fall in.
    """

    def work(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r[0] for r in rows.select("_part").distinct().collect()]  # at most ``parts`` numbers
        if not touched:
            return
        old = stored_rows(batch.sparkSession, path, rows.schema)
        both = rows if old is None else rows.unionByName(old.where(F.col("_part").isin(touched)))
        rest = [c for c in batch.columns if c not in keys]
        best = both.groupBy("_part", *keys).agg(F.max_by(F.struct(*rest), F.col(rank)).alias("_r")).select(*keys, "_r.*", "_part")
        replace_partitions(kept(best), path, ["_part"])

    return work


def repaired(path: str, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rebuilds the partitions that late rows fall in, from what ``build`` makes of the rows that they hold and the late ones."""

    def work(batch: DataFrame, number: int) -> None:
        old = stored_rows(batch.sparkSession, path, batch.schema)
        both = batch if old is None else batch.unionByName(old.join(batch.select(keys).distinct(), keys, "left_semi").select(batch.columns))
        replace_partitions(kept(build(both)), path, keys)

    return work


def rungs_repaired(ticks_path: str, bars_path: str, rungs: list[str], parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: late ticks (with their ``day``) put into the days that they belong to, and then what is derived from these: first the hours that they fall in, then the buckets of each
    slower rung that hold these hours, from stored hours. No other hour or bucket is built again, and only partitions of the table of bars that hold one are written.

    Bars are (instrument, timeframe, t, o, h, l, c, v, version); the version is the batch that built them. A batch that comes twice builds the same bars again.
    """
    days = repaired(ticks_path, ["day"], lambda rows: latest(rows, ["instrument", "seq", "day"], "ts"))
    put = upsert(bars_path, ["instrument", "timeframe", "t"], "version", parts)
    columns = ["instrument", "timeframe", "t", "o", "h", "l", "c", "v"]

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        days(batch, number)
        hours = kept(batch.select("instrument", bucket(F.col("ts"), SECONDS["1h"]).alias("t")).distinct())
        if hours.isEmpty():
            return
        own = spark.read.schema(batch.schema).parquet(ticks_path).join(batch.select("day").distinct(), "day", "left_semi")
        hourly = from_ticks(own, "1h").join(hours, ["instrument", "t"], "left_semi").select(*columns)
        versioned = hourly.withColumn("version", F.lit(number).cast("long"))
        put(versioned, number)
        all_hours = stored_rows(spark, bars_path, versioned.schema).where("timeframe = '1h'").select(*columns)
        slower = None
        for rung in rungs:
            at = bucket(F.col("t"), SECONDS[rung], OFFSET[rung]).alias("_b")
            inside = all_hours.select("*", at).join(hours.select("instrument", at).distinct(), ["instrument", "_b"], "left_semi").drop("_b")
            one = rollup(inside, [rung]).select(*columns)
            slower = one if slower is None else slower.unionByName(one)
        if slower is not None:  # kept first, for it reads the table that is written next
            put(kept(slower.withColumn("version", F.lit(number).cast("long"))), number)

    return work


def parsed(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """JSON lines (a column ``value``) as rows with ``error``: null, or why the line can't be read. A line that can't be read whole still has its key, if that can be found."""
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("value", row.alias("_r")).select("value", "_r.*")
    found = F.coalesce(F.col(key), F.get_json_object("value", f"$.{key}"), F.lit("unknown"))
    error = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("unreadable: "), F.substring("value", 1, 80)))
    return rows.withColumns({key: found, "error": error}).drop("value", "_bad")


def status(rows: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """For each key the last row without an error, how many rows had one, and the last error. Bad rows take nothing from the state of their key; for update or complete mode."""
    good = F.col("error").isNull()
    last = F.max_by(F.when(good, F.struct(*values)), F.when(good, F.col(order))).alias("_r")
    out = rows.groupBy(key).agg(last, F.count("error").alias("errors"), F.max("error").alias("last_error"))
    return out.select(key, "_r.*", "errors", "last_error")


def stored_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """What a table holds; nothing if there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else None


def stored_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What a table holds; no rows if nothing has come for it."""
    none = spark.createDataFrame([], schema)
    got = stored_rows(spark, path, none.schema)
    return none if got is None else got.select(none.columns)


def latest_state(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key so far, for update or complete mode."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def json_sink(stream: DataFrame, name: str, path: str, checkpoint: str):
    """Writes each row as a JSON line with its stream's name and the time of writing."""
    body = F.struct(*stream.columns, F.unix_millis(F.current_timestamp()).alias("_ts"), F.lit(name).alias("_stream"))
    return stream.select(F.to_json(body).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)


def replay(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there, in append mode, into a Parquet table below ``path``, and reads it."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that is there, batch by batch."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

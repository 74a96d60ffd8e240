"""Registered queries over a session's snapshots: one stream, seven shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows
from ..streaming import panes as V
from ..streaming import streams as M
from .series import BARS, hourly, last, register, rounded
from .steps import fed

c = F.col
REACH = 20
_SEEN = f"""{BARS}, x AS (SELECT *, CASE WHEN count(c) OVER {last(5)} = 5 THEN avg(c) OVER {last(5)} END AS mean5, CASE WHEN count(c) OVER {last(20)} = 20 THEN avg(c) OVER {last(20)} END AS mean20,
CASE WHEN count(h) OVER {last(20)} = 20 THEN max(h) OVER {last(20)} END AS top, CASE WHEN count(l) OVER {last(20)} = 20 THEN min(l) OVER {last(20)} END AS bottom, CAST(t // 3600 % 24 AS INT) AS hour FROM bars)"""


def _study(name: str, visible: bool = True, **parts) -> Column:
    none = F.lit(None)
    fields = [parts.get(p, none).alias(p) for p in ("values", "lines", "labels", "cells")]
    return F.struct(F.lit(name).alias("name"), F.lit(visible).alias("visible"), *fields).cast(V.STUDY)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of each hourly bar: one when it opens, before studies have drawn, and one when it closes."""
    extremes = lambda w: {"top": windows.highest("h", REACH, w), "bottom": windows.lowest("l", REACH, w)}
    means = lambda w: {"mean5": windows.sma("c", 5, w), "mean20": windows.sma("c", 20, w)}
    b = windows.bounded(hourly(spark, sf_dir), REACH, means, extremes)
    hour = F.floor(c("t") / 3600 % 24).cast("int")
    is_top, is_bottom = c("h") == c("top"), c("l") == c("bottom")
    none = F.lit(None).cast("double")
    line = lambda on, start, end: F.struct(F.when(on, start).alias("start"), F.when(on, end).alias("end"))
    text = F.when(is_top, "high").when(is_bottom, "low").otherwise("")
    cell = lambda col, value: F.struct(hour.alias("row"), F.lit(col).alias("col"), value.cast("string").alias("text"))
    studies = F.array(
        _study("Means", values=F.create_map(F.lit("mean 5"), c("mean5"), F.lit("mean 20"), c("mean20"))),
        _study("Volume", visible=False, values=F.create_map(F.lit("volume"), c("v"))),
        _study(
            "Extremes",
            lines=F.array(line(is_top, c("h"), c("h")), line(is_bottom, none, c("l"))),
            labels=F.array(F.struct(c("bar_idx").cast("long").alias("id"), text.alias("text"), c("c").alias("price"))),
        ),
        _study("Hours", cells=F.array(cell(0, hour), cell(1, c("bar_idx")), cell(2, F.lit(None)))),
    )
    own = [c("instrument").alias("symbol"), c("timeframe").alias("resolution"), (c("bar_idx") * 2).cast("long").alias("seq"), "t", c("bar_idx").cast("long").alias("bar_idx")]
    opened = b.select(*own, "o", c("o").alias("h"), c("o").alias("l"), c("o").alias("c"), none.alias("v"), F.lit(None).cast(f"array<{V.STUDY}>").alias("studies"))
    closed = b.select(*own, "o", "h", "l", "c", "v", studies.alias("studies")).withColumn("seq", c("seq") + 1)
    return opened.unionByName(closed)


def _fanned(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    stream, path = fed(snapshots(spark, sf_dir), "bar_idx")
    M.run_batches(stream, V.fan_out(f"{path}/shown", names, parts=2), f"{path}/checkpoint")
    return {n: V.table(spark, f"{path}/shown", n) for n in names}


_OPEN = "SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t DESC) AS n FROM x"


@register(f"""WITH {_SEEN}, z AS ({_OPEN}) SELECT 'quote' AS shape, instrument AS symbol, k AS name, t, round(v, 6) AS value FROM (SELECT instrument, t, unnest(['open', 'high', 'low', 'close', 'volume']) AS k, unnest([o, h, l, c, coalesce(v, 0)]) AS v FROM z WHERE n = 1)
UNION ALL SELECT 'bars', instrument, timeframe, t, round(c, 6) FROM x
UNION ALL SELECT 'values', instrument, k, NULL, round(v, 6) FROM (SELECT instrument, 'mean 5' AS k, arg_max(mean5, t) FILTER (mean5 IS NOT NULL) AS v FROM x GROUP BY 1 UNION ALL SELECT instrument, 'mean 20', arg_max(mean20, t) FILTER (mean20 IS NOT NULL) FROM x GROUP BY 1) WHERE v IS NOT NULL
UNION ALL SELECT 'all panes', instrument, timeframe, t, round(c, 6) FROM z WHERE n = 1 UNION ALL SELECT 'all panes', '~empty', 'no bars', NULL, NULL""")
def m_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: quotes, bars, values of studies and all panes, from one pass over a session's snapshots; a pane without bars has an error."""
    got = _fanned(spark, sf_dir, ["quotes", "bars", "values", "panes"])
    fields = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c(k).alias("value")) for n, k in fields.items()]))
    quote = got["quotes"].select(F.lit("quote").alias("shape"), "symbol", "t", each.alias("f")).select("shape", "symbol", "f.name", "t", "f.value")
    bar = got["bars"].select(F.lit("bars").alias("shape"), "symbol", c("resolution").alias("name"), "t", c("c").alias("value"))
    value = got["values"].select(F.lit("values").alias("shape"), "symbol", "name", F.lit(None).cast("long").alias("t"), "value")
    shown = got["panes"].select("symbol", "resolution").unionByName(spark.createDataFrame([("~empty", "1h")], "symbol string, resolution string"))
    pane = V.all_panes(got["panes"], shown)
    pane = pane.select(F.lit("all panes").alias("shape"), "symbol", F.coalesce("error", "resolution").alias("name"), "t", c("c").alias("value"))
    return rounded(quote.unionByName(bar).unionByName(value).unionByName(pane))


@register(f"""WITH {_SEEN}, lb AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bar_idx) - 1 AS place FROM x WHERE h = top OR l = bottom), hr AS (SELECT instrument, hour, max(bar_idx) AS b FROM x GROUP BY 1, 2)
SELECT 'lines' AS shape, instrument AS symbol, 'Extremes' AS study, NULL AS place, NULL AS text, round(level, 6) AS price FROM (SELECT instrument, h AS level FROM x WHERE h = top UNION SELECT instrument, l FROM x WHERE l = bottom)
UNION ALL SELECT 'labels', instrument, 'Extremes', place, CASE WHEN h = top THEN 'high' ELSE 'low' END, round(c, 6) FROM lb WHERE place < 50
UNION ALL SELECT 'tables', instrument, 'Hours', hour, hour || '|' || b || '|', NULL FROM hr""")
def m_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: levels of lines, labels and tables that studies draw, from one pass over a session's snapshots."""
    got = _fanned(spark, sf_dir, ["lines", "labels", "cells"])
    place, text, price = F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("price")
    line = got["lines"].select(F.lit("lines").alias("shape"), "symbol", "study", place, text, c("level").alias("price"))
    label = V.first_labels(got["labels"]).select(F.lit("labels").alias("shape"), "symbol", "study", c("place").cast("long").alias("place"), "text", "price")
    row = V.table_rows(got["cells"])
    row = row.select(F.lit("tables").alias("shape"), "symbol", "study", c("row").cast("long").alias("place"), F.concat_ws("|", "texts").alias("text"), price)
    return rounded(line.unionByName(label).unionByName(row))

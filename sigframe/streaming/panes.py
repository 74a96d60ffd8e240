"""What a chart session shows, as one stream of snapshots that is fanned out to seven tables, each of one shape.

A snapshot is a bar of a symbol as it stands, with what each study draws on it. One pass over the stream feeds all tables: quotes, bars, values of studies, levels of lines, labels, cells of tables and
panes. Each table holds one row for each of its keys, that of the snapshot with the highest ``seq``, so neither late, repeated nor half-written batches change a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from .streams import PARTS, stored_rows, upsert

STUDY = """struct<name: string, visible: boolean, values: map<string, double>, lines: array<struct<start: double, end: double>>,
labels: array<struct<id: bigint, text: string, price: double>>, cells: array<struct<row: int, col: int, text: string>>>"""
SNAPSHOT = f"symbol string, resolution string, seq long, t long, bar_idx long, o double, h double, l double, c double, v double, studies array<{STUDY}>"
#: A study lists so many labels at most.
MOST_LABELS = 50

c = F.col


def quotes(rows: DataFrame) -> DataFrame:
    """The bar that a symbol has now; no volume counts as zero."""
    return rows.select("symbol", "seq", "t", "o", "h", "l", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def bars(rows: DataFrame) -> DataFrame:
    """Each bar of a symbol and resolution, as its last snapshot left it."""
    return rows.select("symbol", "resolution", "t", "seq", "bar_idx", "o", "h", "l", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def _drawn(rows: DataFrame, part: str, wanted: str | None) -> DataFrame:
    """(symbol, study, visible, seq, item): what studies have in one of their parts; ``wanted`` is in their names, in any case."""
    named = rows.select("symbol", "seq", F.explode("studies").alias("s"))
    if wanted:
        named = named.where(F.contains(F.lower("s.name"), F.lit(wanted.lower())))
    return named.select("symbol", c("s.name").alias("study"), c("s.visible").alias("visible"), "seq", F.explode(f"s.{part}"))


def values(rows: DataFrame, wanted: str | None = None) -> DataFrame:
    """The numbers of studies that are shown; those that are null or not numbers are no values."""
    got = _drawn(rows, "values", wanted).where("visible").withColumnsRenamed({"key": "name"})
    return got.where(c("value").isNotNull() & ~F.isnan("value")).select("symbol", "study", "name", "seq", "value")


def _level(start: Column, end: Column) -> Column:
    """A line's price: where it starts if it starts anywhere but at zero or is level, else where it ends."""
    return F.when(start == end, start).when(start.isNull() | F.isnan(start) | (start == 0), end).otherwise(start)


def lines(rows: DataFrame, wanted: str | None = None) -> DataFrame:
    """The levels of a study's lines, each once."""
    got = _drawn(rows, "lines", wanted).select("symbol", "study", _level(c("col.start"), c("col.end")).alias("level"), "seq")
    return got.where("level IS NOT NULL")


def labels(rows: DataFrame, wanted: str | None = None) -> DataFrame:
    """Labels with a text; their price may be null."""
    got = _drawn(rows, "labels", wanted).select("symbol", "study", "col.id", "seq", "col.text", "col.price")
    return got.where("text <> ''")


def cells(rows: DataFrame, wanted: str | None = None) -> DataFrame:
    """Cells of a study's table; one without a text is empty."""
    return _drawn(rows, "cells", wanted).select("symbol", "study", "col.row", "col.col", "seq", F.coalesce("col.text", F.lit("")).alias("text"))


def panes(rows: DataFrame) -> DataFrame:
    """The last bar of each symbol and resolution."""
    return bars(rows)


#: Each table's shape and keys.
SHAPES: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    "quotes": (quotes, ["symbol"]),
    "bars": (bars, ["symbol", "resolution", "t"]),
    "values": (values, ["symbol", "study", "name"]),
    "lines": (lines, ["symbol", "study", "level"]),
    "labels": (labels, ["symbol", "study", "id"]),
    "cells": (cells, ["symbol", "study", "row", "col"]),
    "panes": (panes, ["symbol", "resolution"]),
}


def fan_out(path: str, names: list[str] | None = None, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch of snapshots is read once and put into the tables below ``path``, all seven or those named.

    A batch that fails between two tables comes again, and changes nothing in those that have it.
    """
    sinks = [(SHAPES[n][0], upsert(f"{path}/{n}", SHAPES[n][1], "seq", parts)) for n in names or SHAPES]

    def work(batch: DataFrame, number: int) -> None:
        once = kept(batch)
        for shape, put in sinks:
            put(shape(once), number)

    return work


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the tables that ``fan_out`` keeps; empty if nothing has come for it."""
    shape, _ = SHAPES[name]
    schema = shape(spark.createDataFrame([], SNAPSHOT)).schema
    got = stored_rows(spark, f"{path}/{name}", schema)
    return spark.createDataFrame([], schema) if got is None else got


def first_labels(drawn: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """The first labels of each study, by their ids, with their ``place`` from 0."""
    w = Window.partitionBy("symbol", "study").orderBy("id")
    return drawn.withColumn("place", F.row_number().over(w) - 1).where(c("place") < most)


def table_rows(parts: DataFrame) -> DataFrame:
    """(symbol, study, row, texts): the rows of each study's table, cells from left to right."""
    inside = F.array_sort(F.collect_list(F.struct("col", "text")))  # as many as a table has columns
    return parts.groupBy("symbol", "study", "row").agg(F.transform(inside, lambda x: x["text"]).alias("texts"))


def all_panes(last: DataFrame, layout: DataFrame) -> DataFrame:
    """Each pane of a layout (index, symbol, resolution) with its last bar, or with ``error`` if it has none."""
    got = layout.join(last, ["symbol", "resolution"], "left")
    return got.withColumn("error", F.when(c("t").isNull(), "no bars"))

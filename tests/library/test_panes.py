"""The seven shapes of a session: late and repeated batches, what does not count as a value, and sessions that are empty."""

from __future__ import annotations

import pytest

from sigframe.streaming import panes, streams


def snap(symbol, seq, t, close, studies=None):
    return (symbol, "1h", seq, t, t, close, close, close, close, None, studies)


def study(name, visible=True, values=None, lines=None, labels=None, cells=None):
    return (name, visible, values, lines, labels, cells)


def rows_of(spark, path, name, *columns):
    return sorted(tuple(r) for r in panes.table(spark, path, name).select(*columns).collect())


@pytest.fixture(scope="module")
def shown(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panes"))
    drawn = [
        study("Means", values={"fast": 1.5, "slow": None, "odd": float("nan")}),
        study("Hidden", False, values={"x": 9.0}, lines=[(3.0, 3.0)]),
        study("Levels", lines=[(5.0, 5.0), (5.0, 5.0), (None, 4.0), (0.0, 2.0), (7.0, 8.0), (None, None)]),
        study("Notes", labels=[(k, f"n{k}" if k % 2 else "", None if k == 3 else 1.0) for k in range(140)]),
        study("Table", cells=[(0, 1, "b"), (0, 0, "a"), (1, 0, None)]),
    ]
    batches = [
        [snap("A", 2, 10, 2.0, drawn), snap("B", 1, 10, 5.0), snap(None, 1, 10, 6.0)],
        [snap("A", 1, 10, 1.0, [study("Means", values={"fast": 9.0})]), snap("A", 3, 11, 3.0, [])],
        [snap("B", 1, 10, 5.0)],
        [],
    ]
    work = panes.fan_out(path, parts=3)
    for number, rows in enumerate([*batches, *batches[:2]]):  # the first two come again
        work(spark.createDataFrame(rows, panes.SNAPSHOT), number)
    return path


def test_bars_and_panes_are_the_last_of_their_key(spark, shown):
    assert {r.symbol: (r.t, r.c, r.v) for r in panes.table(spark, shown, "quotes").collect()} == {"A": (11, 3.0, 0.0), "B": (10, 5.0, 0.0), None: (10, 6.0, 0.0)}
    assert {(r.symbol, r.t, r.c) for r in panes.table(spark, shown, "bars").collect()} == {("A", 10, 2.0), ("A", 11, 3.0), ("B", 10, 5.0), (None, 10, 6.0)}
    layout = spark.createDataFrame([(0, "A", "1h"), (1, "C", "1h"), (2, "A", "4h")], "index int, symbol string, resolution string")
    got = {r["index"]: (r.c, r.error) for r in panes.all_panes(panes.table(spark, shown, "panes"), layout).collect()}
    assert got == {0: (3.0, None), 1: (None, "no bars"), 2: (None, "no bars")}


def test_drawings(spark, shown):
    assert rows_of(spark, shown, "values", "study", "name", "value") == [("Means", "fast", 1.5)]
    assert rows_of(spark, shown, "lines", "study", "level") == [("Hidden", 3.0), ("Levels", 2.0), ("Levels", 4.0), ("Levels", 5.0), ("Levels", 7.0)]
    assert panes.table(spark, shown, "labels").count() == 70
    first = panes.first_labels(panes.table(spark, shown, "labels")).orderBy("place").collect()
    assert [(r.place, r.text) for r in first] == [(k, f"n{2 * k + 1}") for k in range(50)] and first[1].price is None
    assert sorted((r.row, list(r.texts)) for r in panes.table_rows(panes.table(spark, shown, "cells")).collect()) == [(0, ["a", "b"]), (1, [""])]


def test_a_name_selects_studies_and_empty_sessions_have_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([snap("A", 1, 1, 1.0, [study("Key Levels", lines=[(5.0, 5.0)]), study(None, lines=[(6.0, 6.0)])])], panes.SNAPSHOT)
    assert [r.level for r in panes.lines(rows, "LEVEL").collect()] == [5.0]
    assert sorted(r.level for r in panes.lines(rows).collect()) == [5.0, 6.0]
    panes.fan_out(str(tmp_path))(rows.limit(0), 0)
    assert [panes.table(spark, str(tmp_path), n).count() for n in panes.SHAPES] == [0] * 7


def test_whole_numbers_stay_equal_beside_nulls(spark, tmp_path):
    schema = "k string, at long, n long, text string"
    for rows in ([("a", 1, 7, "x")], [("a", 2, 7, "x"), ("a", 3, None, "x"), ("a", 4, 7, "x")], [("a", 5, 7, "x"), ("a", 6, 8, "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streams.replay(streams.changes(stream, ["k"], ["n", "text"], "at"), str(tmp_path)).collect()
    assert sorted((r["at"], r.n) for r in got) == [(1, 7), (3, None), (4, 7), (6, 8)]


def test_changes_over_batches(spark, tmp_path):
    nan = float("nan")
    parts = [
        [("a", 1, 1.0, "x"), ("a", 3, 1.0, "x"), ("a", 2, 1.0, None), ("b", 1, None, None), ("b", 2, nan, None)],
        [("a", 4, 1.0, "x"), ("a", 5, 2.0, "x"), ("b", 3, None, None), ("b", 4, None, "y"), ("c", 1, 0.0, "")],
        [("b", 5, None, "y"), ("c", 2, 0.0, ""), ("c", 2, 1.0, ""), (None, 1, 1.0, "z")],
    ]
    schema = "k string, at long, price double, text string"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streams.replay(streams.changes(stream, ["k"], ["price", "text"], "at"), str(tmp_path)).collect()
    assert {(r.k, r["at"]) for r in got} == {("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 1), ("b", 4), ("c", 1), ("c", 2), (None, 1)} and len(got) == 9

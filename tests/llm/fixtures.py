"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import pandas as pd

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, label string"


def documents(spark, extra=()):
    """Given texts, and null, empty, short, long, repeated, odd ones; with columns whose names operators use inside."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).toPandas().sort_values("doc_id")
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars), 0.5, 1, "x") for r in base.itertuples()]
    long = " ".join(f"word{i % 977} of the mit license" for i in range(30_000))
    odd = [None, "", " ", "\n \t", "one", "one two", "MIT License", "a  b\n\n c\x0bd\x0ce\r\nf", "é\u2003ü 你好 😀 ＡＢ", "K\u212a MIT\u0130 license", long, "same text here " * 40, "same text here " * 40]
    rows += [(100_000 + i, t, None, None if i % 3 else "src1", None, None, None, None) for i, t in enumerate(odd)]
    rows += [rows[5], rows[5]]
    rows += [(200_000 + i, t, "en", "src2", len(t), 0.0, 0, "") for i, t in enumerate(extra)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df) -> pd.DataFrame:
    return df.toPandas()

"""Small hostile tables, and the SQL check, for the tests of this folder."""

import duckdb
import pandas as pd
from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"
LONG = ("The quick brown fox, 12 of them, jumped over the lazy dog near mail. " * 4000).strip()
WORDS = "the house of a friend is old and the garden behind it is green so we sit there in the evening".split()

DOCUMENTS = [
    (1, "The house of my friend is old, and the garden behind it is green.", "en", "a", 66),
    (1, "The house of my friend is old, and the garden behind it is green.", "en", "a", 66),  # a repeated row
    (1, "An id that comes twice with another text altogether, about ships.", "en", "b", 66),
    (2, "", "en", "a", 0),
    (3, None, "fr", "a", None),
    (4, " \n\t ", None, "b", 4),
    (5, "!!! ... ???", "en", None, 11),
    (None, "Kein Name, aber ein Text über das alte Haus und den grünen Garten.", "de", "b", 66),
    (None, None, None, None, None),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG + " end", "en", "a", len(LONG) + 4),
    (8, "x", "en", "hot", 1),
    (9, "mot " * 300, "fr", "hot", 1200),
    (10, "日本語のテキスト\u0000 with 😀 and ﻿ marks", "xx", "b", 30),
]


def documents(spark, rows=DOCUMENTS):
    """Documents with extra columns whose names clash with the five, or with names inside the operators."""
    kinds = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    extra = [("TEXT", T.StringType()), ("Doc_Id", T.StringType()), ("node", T.StringType()), ("key", T.StringType()), ("list", T.StringType()), ("copy", T.StringType()), ("name", T.StringType())]
    schema = T.StructType([T.StructField(n, k) for n, k in kinds + extra])
    return spark.createDataFrame([(*r, *["no"] * len(extra)) for r in rows], schema)


def as_rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


def same_as_sql(got, sql, **views):
    """Whether ``got`` has the rows that DuckDB gives for ``sql`` over views of Parquet files or pandas frames."""
    c = duckdb.connect()
    for name, what in views.items():
        if isinstance(what, str):
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{what}'")
        else:
            c.register(name, what)
    want = c.sql(sql).df()
    frame = got.toPandas()
    assert sorted(frame.columns) == sorted(want.columns)
    assert as_rows(frame) == as_rows(want)

"""Schemas of the tables that the operators pass on."""

from __future__ import annotations

from pyspark.sql import types as T

_LIST = T.ArrayType(T.StringType(), False)
#: One function or method. ``ord`` grows in the order of the walk, then of the declarations; it need not be dense.
UNITS = T.StructType(
    [
        T.StructField("ord", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("file", T.StringType()), T.StructField("start_line", T.IntegerType()),
        T.StructField("body", T.StringType()), T.StructField("signature", T.StringType()), T.StructField("package", T.StringType()), T.StructField("patterns", _LIST),
        T.StructField("doc_comment", T.StringType()), T.StructField("exported", T.BooleanType()), T.StructField("receiver_type", T.StringType()), T.StructField("callees", _LIST),
    ]
)
#: List columns of a concept document, in the order of its text.
DOC_LISTS = ("inputs", "outputs", "dependencies", "callers", "callees", "patterns", "caller_patterns", "callee_patterns", "caller_packages", "callee_packages")
DOC_COLUMNS = ("ord", "name", "package", "doc_comment", "exported", "receiver_type", "role", *DOC_LISTS)
UNIT_COLUMNS = tuple(UNITS.names)

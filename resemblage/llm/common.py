"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder, written

__all__ = ["DOCUMENT_COLUMNS", "Memo", "byte_texts", "checkpoint", "pick", "shared_folder", "slices", "table", "written"]

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, be it a file or a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly ``names``, whatever other columns there are.

    Columns are found by position and exact spelling, so extra columns that
    differ in case only, or repeat a name, make no reference ambiguous (of
    repeated ones the first counts). A missing column is an error.
    """
    where: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        where.setdefault(c, i)
    missing = [n for n in names if n not in where]
    if missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{where[n]}").alias(n) for n in names])


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with about ``limit`` in total, at least one each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Memo(dict):
    """A dict that computes what it lacks, and is emptied when it is full.

    Keys longer than ``longest`` are computed each time. Emptying and leaving
    out cost time, never a different result.
    """

    def __init__(self, make, most: int = 300_000, longest: int = 1 << 30):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value

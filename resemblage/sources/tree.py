"""Source trees: listing, reading and parsing into ``units``."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import UNITS
from ..session import numbered as in_order
from . import golang

SKIPPED = frozenset([".claude", ".git", ".idea", ".vscode", "build", "testdata", "vendor"])
EXTENSION = ".go"
#: A file may have so many functions before ``ord`` of two files could meet.
PER_FILE = 1 << 24
#: Files of one task, about.
FILES_PER_TASK = 500


def walk(root: str) -> Iterator[str]:
    """Files below ``root`` with the extension, in the order of names within each folder.

    Skipped folders (the root too, by its own name) aren't entered, links to folders
    not followed; what can't be listed gives nothing.
    """
    if os.path.basename(os.path.normpath(root)) in SKIPPED and os.path.isdir(root):
        return
    if os.path.isfile(root):
        if root.endswith(EXTENSION):
            yield root
        return
    todo = [root]
    while todo:
        place = todo.pop()
        if place.endswith(EXTENSION) and not (os.path.isdir(place) and not os.path.islink(place)):
            if not os.path.isdir(place):
                yield place
            continue
        if os.path.islink(place) and place != root or not os.path.isdir(place):
            continue
        try:
            names = sorted(os.listdir(place), key=os.fsencode, reverse=True)
        except OSError:
            continue
        todo += [os.path.join(place, n) for n in names if not (n in SKIPPED and os.path.isdir(os.path.join(place, n)))]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ord_, path = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            content, warning = None, None
            try:
                with open(batch.column(2)[i].as_py(), "rb") as f:
                    content = f.read()
            except OSError as e:
                warning = f"{path}: {e.strerror}"
            yield pa.RecordBatch.from_arrays([pa.array([ord_], pa.int64()), pa.array([path]), pa.array([content], pa.binary()), pa.array([warning], pa.string())], names=["file_ord", "path", "content", "warning"])


def files(spark: SparkSession, root: str) -> DataFrame:
    """``(file_ord, path, content, warning)`` of a tree that all executors can open.

    Only the list of paths is made on the driver. A file that can't be read has null
    content and a warning. A root with a scheme is a tree of ``remote_files``.
    """
    if "://" in root:
        return remote_files(spark, root)
    paths = [(i, p, os.path.abspath(p)) for i, p in enumerate(walk(root))]
    listed = spark.createDataFrame(paths, "file_ord long, path string, place string").repartition(max(1, len(paths) // FILES_PER_TASK), "file_ord")
    return listed.mapInArrow(_read, "file_ord long, path string, content binary, warning string")


def remote_files(spark: SparkSession, root: str) -> DataFrame:
    """``(file_ord, path, content, warning)`` of a tree on any file system that Spark reads, listed and read by executors.

    Folders that are skipped and the order of files are those of ``files``. Names that begin with "_" or "." are hidden to Spark and left
    out; a file that can't be read is an error.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{EXTENSION}").load(base)
    start = spark._jvm.org.apache.hadoop.fs.Path(base)
    start = start.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(start).toString()
    below = F.expr(f"substring(regexp_replace(path, '^file:/+', 'file:/'), {len(re.sub('^file:/+', 'file:/', start)) + 2})")
    skipped = F.exists(F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1), lambda x: x.isin(*sorted(SKIPPED)))
    rows = found.filter(~skipped if os.path.basename(base) not in SKIPPED else F.lit(False)).select(F.concat(F.lit(base + "/"), below).alias("path"), "content")
    return numbered(rows).withColumn("warning", F.lit(None).cast("string"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for ord_, path, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if raw is None or not (path or "").endswith(EXTENSION):
                continue
            for k, f in enumerate(golang.functions(raw.decode("utf-8", "replace"))):
                rows.append((ord_ * PER_FILE + k, f.name, path, f.start_line, f.body, f.signature, f.package, [], f.doc_comment, f.exported, f.receiver_type, f.callees))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=UNITS.names)


def parse(found: DataFrame) -> DataFrame:
    """``(file_ord, path, content)`` -> ``units`` without patterns: a row for each function; malformed files give none."""
    return found.select("file_ord", "path", "content").mapInArrow(_parse, UNITS)


def numbered(found: DataFrame) -> DataFrame:
    """``(path, content)`` from any source, with ``file_ord`` in the order of a walk (folder by folder, not of whole paths).

    Paths are sorted by ranges; contents stay where they are.
    """
    paths = found.select("path").distinct().withColumn("steps", F.split("path", "/"))
    return found.join(in_order(paths, "file_ord", "steps").select("path", "file_ord"), "path").select("file_ord", "path", "content")

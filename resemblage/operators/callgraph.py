"""The call graph by bare names, and concept documents made with it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.compare import listed, role
from ..session import written

#: Names shorter than this, in bytes, are not looked for in texts.
LEAST_NAME = 4
#: Bytes of the bitmap of names that is broadcast, at most.
BROADCAST_NAMES = 1 << 24
#: Bits of one row on the bitmap's way to the driver.
_SEGMENT = 20
#: Edges of one task, about. Shuffled edges compress to a few bytes each, so partitions by bytes would hold too many to sort in memory.
EDGES = 400_000
#: Up to so many different packages with patterns, of so many bytes, edges carry their number.
TOKENS, TOKEN_BYTES = 1 << 14, 1 << 17


def exact_edges(units: DataFrame) -> DataFrame:
    """``(callee, caller, caller_ord)`` of listed callees that are names of units; a recursive one calls itself."""
    calls = units.select(F.col("name").alias("caller"), F.col("ord").alias("caller_ord"), F.explode("callees").alias("callee"))
    return calls.join(units.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi").select("callee", "caller", "caller_ord")


def _slot(name: bytes, bits: int) -> int:
    return zlib.crc32(name) >> (32 - bits)


def _slots(bits: int):
    """The bitmap's bits that names set: of the whole name, and of its first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n.encode() for n in batch.column(0).to_pylist()]
            found = {_slot(n, bits) for n in names} | {_slot(n[:LEAST_NAME], bits) for n in names}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["slot"])

    return run


def _segment(table: pa.Table) -> pa.Table:
    slots = table.column("slot").to_numpy()
    bits = np.zeros(1 << _SEGMENT, np.uint8)
    bits[slots & ((1 << _SEGMENT) - 1)] = 1
    return pa.table({"segment": pa.array([int(slots[0]) >> _SEGMENT], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _bitmap(names: DataFrame, bits: int) -> bytes:
    """``2 ** bits`` bits, set where a name or the first bytes of one hash to."""
    slots = names.mapInArrow(_slots(bits), "slot long").withColumn("segment", F.shiftright("slot", _SEGMENT))
    width = 1 << (_SEGMENT - 3)
    out = bytearray(width << max(0, bits - _SEGMENT))
    for r in slots.groupBy("segment").applyInArrow(_segment, "segment long, bits binary").toLocalIterator():
        out[r["segment"] * width : (r["segment"] + 1) * width] = r["bits"]
    return bytes(out)


def _scan(shared, lengths: list[int], bits: int):
    """Parts of bodies that may be names: those of a name's length whose bits are set."""

    def found(body: bytes, bitmap: bytes) -> set[bytes]:
        out = set()
        for i in range(len(body) - LEAST_NAME + 1):
            first = _slot(body[i : i + LEAST_NAME], bits)
            if bitmap[first >> 3] >> (7 - (first & 7)) & 1:
                for n in lengths:
                    if i + n > len(body):
                        break
                    whole = _slot(body[i : i + n], bits)
                    if bitmap[whole >> 3] >> (7 - (whole & 7)) & 1:
                        out.add(body[i : i + n])
        return out

    def text(part: bytes) -> str | None:
        try:
            return part.decode()
        except UnicodeDecodeError:  # it begins or ends within a character, so it is no name
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows: list[tuple[str, str, int]] = []
                for caller, ord_, body in zip(*(batch.column(c).slice(start, 1000).to_pylist() for c in range(3))):
                    names = sorted(n for n in map(text, found(body.encode(), bitmap)) if n is not None and n != caller)
                    rows += [(name, caller, ord_) for name in names]
                columns = [[r[k] for r in rows] for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["callee", "caller", "caller_ord"])

    return run


_EDGE = "callee string, caller string, caller_ord long"


def text_edges(units: DataFrame, names: DataFrame | None = None, broadcast: int = BROADCAST_NAMES) -> DataFrame:
    """Edges of units without callees: each other name of enough bytes that stands in the body.

    A bitmap of the names' hashes, ``broadcast`` bytes at most however many names there are, tells which parts of a body may be names; those that are
    are found by a join. The result doesn't depend on the bitmap's size.
    """
    spark = units.sparkSession
    names = units.select(F.col("name").alias("callee")) if names is None else names.select("callee")
    names = written(names.filter(F.octet_length("callee") >= LEAST_NAME).distinct())
    lengths = [r[0] for r in names.select(F.octet_length("callee").alias("n")).distinct().orderBy("n").collect()]  # as many as names are long, at most
    if not lengths:
        return spark.createDataFrame([], _EDGE)
    bits = min(max(3, (broadcast * 8).bit_length() - 1), max(_SEGMENT, (names.count() * 16).bit_length()))
    scanned = units.filter(F.size(listed(F.col("callees"))) == 0).select(F.col("name").alias("caller"), F.col("ord").alias("caller_ord"), "body").filter("caller is not null and body is not null")
    maybe = scanned.mapInArrow(_scan(spark.sparkContext.broadcast(_bitmap(names, bits)), lengths, bits), _EDGE)
    return maybe.join(names, "callee").select("callee", "caller", "caller_ord")


def edges(units: DataFrame) -> DataFrame:
    return exact_edges(units).unionByName(text_edges(units))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` in ``tasks`` partitions by ``keys``."""
    return df.repartition(*keys) if tasks is None else df.repartition(tasks, *keys)


def tasks_for(edges_: int, spark: SparkSession) -> int | None:
    """How many partitions so many edges are dealt to; None: as many as Spark likes. Fewer than Spark's own number it would deal again for a join."""
    return max(-(-edges_ // EDGES), int(spark.conf.get("spark.sql.shuffle.partitions"))) if edges_ > 4 * EDGES else None


def _tasks(units: DataFrame) -> int | None:
    return tasks_for(units.agg(F.sum(F.size(listed(F.col("callees"))))).first()[0] or 0, units.sparkSession)


def callers(found: DataFrame, key: str = "name") -> DataFrame:
    """Edges, dealt by callee -> ``(name, callers)``: distinct callers in the order in which units first call. If edges have a ``token``, a set of these is gathered."""
    sets = [F.collect_set("token").alias("token")] if "token" in found.columns else []
    lists = found.groupBy(F.col("callee").alias(key)).agg(F.array_sort(F.collect_list(F.struct(F.col("caller_ord").alias("at"), "caller"))).alias("xs"), *sets)
    return lists.select(key, F.array_distinct("xs.caller").alias("callers"), *[F.col("token")] * len(sets))


def call_graph(units: DataFrame) -> DataFrame:
    """``(name, callers)`` for every distinct name of a unit; without callers the list is empty."""
    tasks = _tasks(units)
    names = dealt(units.select("name"), tasks, "name").distinct()
    # a callee that is no unit's name goes at this join, so edges needn't be filtered before
    calls = units.select(F.explode("callees").alias("callee"), F.col("name").alias("caller"), F.col("ord").alias("caller_ord"))
    return names.join(callers(dealt(calls.unionByName(text_edges(units)), tasks, "callee")), "name", "left").select("name", listed(F.col("callers")).alias("callers"))


def last_wins(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Of rows that share ``key`` the one of greatest ``ord``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "ord").alias("row")).select(key, *[F.col(f"row.{c}").alias(c) for c in columns])


def _sets(tokens: str, info: Callable[[Column], Column], prefix: str) -> dict[str, Column]:
    """Sets of packages and of tags, of what ``tokens`` stand for, as ``<prefix>_patterns`` and ``<prefix>_packages``: sorted, without what is empty."""
    patterns, packages = F.transform(tokens, lambda t: info(t)["patterns"]), F.transform(tokens, lambda t: info(t)["package"])
    return {f"{prefix}_patterns": F.sort_array(F.array_compact(F.array_distinct(F.flatten(patterns)))), f"{prefix}_packages": F.sort_array(F.array_remove(F.array_distinct(packages), ""))}


def _tokens(own: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``own`` with a ``token`` for its package and patterns, and what makes a struct of both from a token.

    While there are few different ones a token is their number, so that an edge carries four bytes; else it is the struct itself.
    """
    infos = written(own.select("package", "patterns").distinct())
    n, size = infos.agg(F.count("*"), F.sum(F.octet_length("package") + F.octet_length(F.array_join("patterns", " ", " ")) + 1)).first()
    if n > TOKENS or (size or 0) > TOKEN_BYTES:
        return own.withColumn("token", F.struct("package", "patterns")), lambda t: t
    infos = written(infos.coalesce(1).withColumn("token", F.monotonically_increasing_id().cast("int")))  # in one partition: from 0, without gaps
    listing = infos.agg(F.to_json(F.array_sort(F.collect_list(F.struct("token", "package", "patterns"))))).first()[0]
    listed_ = F.from_json(F.lit(listing), "array<struct<token int, package string, patterns array<string>>>")  # a constant, which the optimizer makes once
    return own.join(F.broadcast(infos), ["package", "patterns"], "left"), lambda t: F.get(listed_, t)


def _kept(value: Column, *columns: str) -> Column:
    """``value``, but the optimizer can't leave ``columns`` out: two readers of one shuffle share it only while they read the same columns."""
    return F.when(F.hash(*columns) >= F.lit(-(1 << 31)), value)


def concept_docs(units: DataFrame) -> DataFrame:
    """A concept document for each unit.

    Units of one name share callers. What is known of a neighbour is that of the last unit of
    its name. Fan-out counts callees that are no units too. Lists are never null.

    All is dealt to as many partitions as edges need. Edges go once to their callee, with the token of what is known of the caller; there they make callers' lists, and
    meet the callee's token, which alone goes back by the caller's ``ord``. Units meet both by name, so that lists of names aren't shuffled again.
    """
    tasks = _tasks(units)
    own, info = _tokens(units.withColumns({"package": F.coalesce("package", F.lit("")), "patterns": listed(F.col("patterns"))}))
    known = own.filter("name is not null").groupBy("name").agg(F.max_by("token", "ord").alias("token"), F.count("*").alias("n"))
    known = written(known)
    repeated = written(known.filter("n > 1").select("name", F.col("token").alias("last")))  # often none
    calls = own.select("name", "ord", "callees", "token").join(repeated, "name", "left")
    calls = calls.select(F.explode("callees").alias("callee"), F.col("name").alias("caller"), F.col("ord").alias("caller_ord"), F.when(F.col("name").isNotNull(), F.coalesce("last", "token")).alias("token"), F.lit(False).alias("scanned"))
    scanned = text_edges(units).join(known.select(F.col("name").alias("caller"), "token"), "caller").select("callee", "caller", "caller_ord", "token", F.lit(True).alias("scanned"))
    found = dealt(calls.unionByName(scanned).filter("callee is not null"), tasks, "callee")
    upward = callers(found.withColumn("token", _kept(F.col("token"), "scanned")), key="key")

    near = dealt(known.select(F.col("name").alias("callee"), F.col("token").alias("near")), tasks, "callee").hint("shuffle_hash")
    # a condition on both sides, as one on edges alone would be pushed below their shuffle, which then couldn't be shared
    back = found.join(near, "callee").filter(~F.col("scanned") | F.col("near").isNull()).select(F.col("caller_ord").alias("ord"), _kept(F.col("near"), "caller", "token").alias("near"))
    named = units.withColumn("key", F.coalesce("name", F.lit("")))
    # no join with units, as the optimizer would then look for nulls of ord below the shuffle of edges
    back = dealt(back.unionByName(named.select("ord", "key"), allowMissingColumns=True), tasks, "ord").groupBy("ord").agg(F.collect_set("near").alias("near"), F.collect_set("key").alias("keys"))
    unit = F.struct("name", "package", "doc_comment", "exported", "receiver_type", "callees", "patterns").alias("unit")
    downward = back.select(F.explode("keys").alias("key"), "ord", "near")
    both = named.select("key", "ord", unit).unionByName(downward, allowMissingColumns=True)
    docs = dealt(both, tasks, "key").groupBy("key", "ord").agg(F.collect_list("unit").alias("units"), F.first("near", ignorenulls=True).alias("near"))
    docs = docs.select("key", "ord", "near", F.inline("units")).join(upward, "key", "left").withColumns(_sets("token", info, "caller") | _sets("near", info, "callee"))
    docs = docs.withColumns({c: F.when(F.col("name").isNotNull(), F.col(c)) for c in ("callers", "caller_patterns", "caller_packages")})
    empty = F.array().cast("array<string>")

    def of(c: str) -> Column:
        return listed(F.col(c)).alias(c)

    return docs.select(
        "ord", "name", "package", "doc_comment", "exported", "receiver_type", role(F.size(listed(F.col("callers"))), F.size(listed(F.col("callees")))).alias("role"),
        empty.alias("inputs"), empty.alias("outputs"), empty.alias("dependencies"), *[of(c) for c in ("callers", "callees", "patterns", "caller_patterns", "callee_patterns", "caller_packages", "callee_packages")],
    )

"""SimHash near-duplicates, found by recursive filtering on random coordinate strips.

A fingerprint has 256 bits: every distinct word and pair of neighbouring words
(lower case, cut at punctuation) votes on each. Close fingerprints are found
as May and Ozerov do for binary vectors: a repetition cuts the coordinates, in
random order, into strips; on every strip a list is filtered by partial weight
(the distance to random centres on that strip's coordinates alone), the lists
that result are filtered on the next strip, and the small lists at the end are
searched by brute force. Repetitions are added until the recall wanted is met.

A vector goes to the centres of least partial weight rather than to all below a
fixed weight, so that each repetition keeps every vector. Spark holds the lists:
the path of centres is the key of one shuffle. A list that is far longer than chance makes it is searched in pairs
of blocks, all of them, so no task holds more than two blocks and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import DOCUMENT_COLUMNS, byte_texts, checkpoint, pick, slices, written
from .components import components
from .words import mix, word_hashes

BITS, LANES = 256, 4
#: Fingerprints at most so far apart belong together.
DISTANCE = 52
#: Pairs exactly DISTANCE apart are found with this probability; closer ones more often.
RECALL = 0.95
#: Strips of a repetition, centres kept on each, and chance comers that a list may have.
STRIPS, KEPT, LIST = 2, 2, 1000
#: Fingerprints of a list that one task searches, at most.
LONG = 8192
WORDS = ("f0", "f1", "f2", "f3")

_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors, one for each 64 bits of a fingerprint.
_LANES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def fingerprint(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The four 64-bit words of a fingerprint, from the hashes of a text's words and word pairs."""
    features = np.concatenate([_distinct(words), _distinct(pairs)])
    lanes = features[:, None] * _LANES
    lanes ^= lanes >> np.uint64(32)
    n, ones = len(features), np.zeros(BITS, np.int64)
    bits = np.unpackbits(lanes.view(np.uint8), axis=1)
    for a in range(0, n, 255):  # the sum of 255 bits fits into a byte
        ones += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n).view(np.uint64)


def fingerprint_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``texts``, and which of them have words at all."""
    hashes, at = word_hashes(texts)
    pairs = mix(hashes[:-1] * _PAIR + hashes[1:])
    out = np.zeros((len(texts), LANES), np.uint64)
    for i in np.flatnonzero(at[1:] > at[:-1]):
        out[i] = fingerprint(hashes[at[i] : at[i + 1]], pairs[at[i] : at[i + 1] - 1])
    return out, at[1:] > at[:-1]


def node_ids(f: np.ndarray) -> np.ndarray:
    """A 64-bit id of each fingerprint."""
    h = np.zeros(len(f), np.uint64)
    for k in range(LANES):
        h = mix(h * _PAIR + f[:, k])
    return h


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = byte_texts(batch.column(2))
        out, known = np.zeros((len(texts), LANES), np.uint64), np.zeros(len(texts), bool)
        for a, b in slices([len(t) for t in texts], 1_000_000):
            out[a:b], known[a:b] = fingerprint_all(texts[a:b])
        columns = [pa.array(x.view(np.int64), mask=~known) for x in (node_ids(out), *out.T.copy())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "th", "node", *WORDS])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, node, f0..f3)`` for each row; ``th`` hashes the text, ``node`` the fingerprint f0..f3, which are null where there are no words."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, th long, node long, " + ", ".join(f"{w} long" for w in WORDS))


def _nearest(bits: np.ndarray, centres: np.ndarray, kept: int) -> np.ndarray:
    """Of each row, the ``kept`` centres (of +1 and -1) of least partial weight."""
    near = (bits @ centres.T) + np.arange(len(centres), dtype=np.float32) * 1e-4
    return np.argpartition(-near, kept - 1, axis=1)[:, :kept]


def _strip(rng: np.random.Generator, order: np.ndarray, centres: int) -> tuple[np.ndarray, np.ndarray]:
    return order, (rng.integers(0, 2, (centres, len(order))) * 2 - 1).astype(np.float32)


@lru_cache(maxsize=512)
def _strips(centres: int, repetition: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each strip of a repetition its coordinates and centres."""
    rng, width = np.random.default_rng([seed, repetition]), BITS // STRIPS
    order = rng.permutation(BITS)
    return [_strip(rng, order[s * width : (s + 1) * width], centres) for s in range(STRIPS)]


def _paths(signs: np.ndarray, strips: list[tuple[np.ndarray, np.ndarray]], kept: int) -> np.ndarray:
    """Recursion over the strips: for each row the lists in which it ends."""
    paths = np.zeros((len(signs), 1), np.int64)
    for order, centres in strips:
        near = _nearest(signs[:, order], centres, kept)
        paths = (paths[:, :, None] * len(centres) + near[:, None, :]).reshape(len(signs), -1)
    return paths


def _signs(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def plan(n: int, distance: int = DISTANCE, recall: float = RECALL, seed: int = 7) -> tuple[int, int]:
    """(centres of a strip, repetitions) for ``n`` fingerprints.

    Centres: so many that a list gets LIST chance comers at most. Repetitions: the
    fewest for which pairs exactly ``distance`` apart share a list with probability
    ``recall``, as measured on random pairs and the very strips that are used.
    """
    centres = max(KEPT, int(np.ceil(KEPT * (max(n, 1) / LIST) ** (1 / STRIPS))))
    rng, tries = np.random.default_rng(seed), 2000
    a = rng.integers(0, 2, (tries, BITS)).astype(np.float32) * 2 - 1
    b = a.copy()
    for row in b:
        row[rng.choice(BITS, distance, replace=False)] *= -1
    met, repetitions = np.zeros(tries, bool), 0
    while met.mean() < recall:
        strips = _strips(centres, repetitions, seed)
        repetitions += 1
        x, y = _paths(a, strips, KEPT), _paths(b, strips, KEPT)
        met |= (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    return centres, repetitions


def _assign(centres: int, repetitions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                f = np.stack([part.column(k).to_numpy() for k in range(LANES)], axis=1)
                signs, lists = _signs(f), []
                for r in range(repetitions):
                    lists.append(_paths(signs, _strips(centres, r, seed), KEPT) * repetitions + r)
                lists = np.concatenate(lists, axis=1)
                times = lists.shape[1]
                columns = [lists.ravel(), *(np.repeat(f[:, k], times) for k in range(LANES))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", *WORDS])

    return run


def _near(f: np.ndarray, rows: np.ndarray, others: np.ndarray, distance: int) -> np.ndarray:
    total = np.zeros((len(rows), len(others)), np.uint16)
    for k in range(LANES):
        total += np.bitwise_count(f[rows, k][:, None] ^ f[others, k][None, :])
    return total <= distance


def spanning(f: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Brute force over one list: edges (hub, member) that connect exactly what pairs within ``distance`` connect."""
    n, edges = len(f), []
    if n < 2:
        return edges
    everything = np.arange(n)
    if n <= 2048:
        close = _near(f, everything, everything, distance)
        todo = set(np.flatnonzero(close.sum(axis=1) > 1).tolist())
        while todo:
            hub = min(todo)
            member, front = np.zeros(n, bool), np.array([hub])
            while len(front):
                member[front] = True
                front = np.flatnonzero(close[front].any(axis=0) & ~member)
            own = np.flatnonzero(member).tolist()
            edges += [(hub, m) for m in own if m != hub]
            todo.difference_update(own)
        return edges
    left = everything  # a long list: each row is compared with those not yet reached, a block at a time
    while len(left):
        hub, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:64], front[64:]
            hit = _near(f, block, left, distance).any(axis=0)
            edges += [(int(hub), int(m)) for m in left[hit]]
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return edges


def _words(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)


def _edges_of(rows: pa.Table, distance: int) -> list[np.ndarray]:
    """The edges within each list of ``rows``, which are in the order of lists."""
    lists, f = rows.column("list").to_numpy(), _words(rows)
    node = node_ids(f).view(np.int64)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])
    return [node[a + np.array(pairs)] for a, b in zip(bounds[:-1], bounds[1:]) if (pairs := spanning(f[a:b], distance))]


_ROWS = ", ".join(f"{w} long" for w in WORDS)


def _search(distance: int, long: int):
    """Edges of lists up to ``long``, as ``(a, b)``; rows of longer ones go on as ``(list, f0..f3)``."""

    def rest(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        none = [pa.nulls(sum(p.num_rows for p in parts), pa.int64())] * 2
        table = pa.Table.from_batches(parts)
        return pa.table([*none, *(table.column(c) for c in ("list", *WORDS))], names=["a", "b", "list", *WORDS]).combine_chunks().to_batches()

    def found(rows: pa.Table) -> list[pa.RecordBatch]:
        if not (parts := _edges_of(rows, distance)):
            return []
        e = _edges(parts)
        none = pa.nulls(e.num_rows, pa.int64())
        return [pa.RecordBatch.from_arrays([e.column(0), e.column(1), *[none] * 5], names=["a", "b", "list", *WORDS])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the list that goes on in the next batch
        size, own, passing = 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])
            at = 0
            if own == lists[0]:  # the list of the batch before goes on
                at = int(starts[1])
                held.append(batch.slice(0, at))
                size += at
            if held and (at < len(lists) or own != lists[0] or passing or size > long):
                passing = passing or size > long
                yield from rest(held) if passing else found(pa.Table.from_batches(held))
                held, size = [], 0
            if at == len(lists):
                continue
            last = int(starts[-2])
            inner = starts[(starts >= at) & (starts <= last)]
            short = np.repeat(np.diff(inner) <= long, np.diff(inner)) if len(inner) > 1 else np.zeros(0, bool)
            middle = batch.slice(at, last - at)
            if short.any():
                yield from found(pa.Table.from_batches([middle]).filter(pa.array(short)))
            if not short.all():
                yield from rest(pa.Table.from_batches([middle]).filter(pa.array(~short)).to_batches())
            held, size, own, passing = [batch.slice(last)], len(lists) - last, lists[last], False
        if held:
            passing = passing or size > long
            yield from rest(held) if passing else found(pa.Table.from_batches(held))

    return run


def _crossed(distance: int):
    """Edges of two blocks of a list taken together."""

    def run(rows: pa.Table) -> pa.Table:
        f = _words(rows)
        pairs = spanning(f, distance)
        return pa.Table.from_batches([_edges([node_ids(f).view(np.int64)[np.array(pairs)] if pairs else np.zeros((0, 2), np.int64)])])

    return run


def _edges(parts: list[np.ndarray]) -> pa.RecordBatch:
    e = np.unique(np.sort(np.concatenate(parts), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])


_ROWS = ", ".join(f"{w} long" for w in WORDS)


def close_nodes(nodes: DataFrame, n: int, distance: int = DISTANCE, recall: float = RECALL, seed: int = 7, long: int = LONG) -> DataFrame:
    """Edges ``(a, b)`` of node ids that connect the ``n`` rows of ``nodes(f0..f3)`` as pairs within ``distance`` do."""
    centres, repetitions = plan(n, distance, recall, seed)
    lists = nodes.select(*WORDS).mapInArrow(_assign(centres, repetitions, seed), f"list long, {_ROWS}").repartition("list").sortWithinPartitions("list")
    found = written(lists.mapInArrow(_search(distance, long), f"a long, b long, list long, {_ROWS}"))
    edges, rest = found.filter("a is not null").select("a", "b"), found.filter("list is not null").select("list", *WORDS)
    return (edges if rest.isEmpty() else edges.union(_blocks(rest, distance, long))).distinct()


def _blocks(rest: DataFrame, distance: int, long: int) -> DataFrame:
    """All edges of lists of any length, by pairs of blocks of half of ``long`` rows, about."""
    sizes = rest.groupBy("list").agg(F.ceil(F.count("*") / (long / 2)).cast("int").alias("blocks"))  # two at least
    dealt = rest.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64(*WORDS), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("o != block").withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    return dealt.groupBy("list", "i", "j").applyInArrow(_crossed(distance), "a long, b long")


def _grouped(docs: DataFrame, distance: int, recall: float) -> DataFrame:
    """``(doc_id, th, node, root)`` for each row; node and root are null where there are no words."""
    prints = checkpoint(fingerprints(docs))
    nodes = prints.filter("node is not null").groupBy("node").agg(*[F.first(w).alias(w) for w in WORDS])
    n = nodes.count()
    roots = components(close_nodes(nodes, n, distance, recall)).withColumnRenamed("node", "r_node") if n > 1 else None
    slim = prints.select("doc_id", "th", "node")
    if roots is None:
        return slim.withColumn("root", F.col("node"))
    return slim.join(roots, F.col("node") == F.col("r_node"), "left").select("doc_id", "th", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """``documents`` -> ``(doc_id, group_id, group_size, is_kept)``, a row for every row.

    Rows of one group are connected by fingerprints within ``distance``; of each
    group the row of least ``doc_id`` is kept (nulls last, and one of repeated
    rows). ``group_id`` is that row's ``doc_id``. Null, empty and wordless texts
    are groups of their own and kept. An empty table gives no rows. Very long texts are read whole; other columns are
    ignored, whatever their names.
    """
    g = _grouped(docs, distance, recall)
    alone = g.filter("root is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("is_kept"))
    g = g.filter("root is not null")
    sizes = g.groupBy("root").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("group_id"), F.min(_order()).alias("best"))
    # One of the rows that repeat the best one is kept: they are counted, and one row is given back.
    same = g.groupBy("root", "doc_id", "th").agg(F.count("*").alias("times"))
    rows = same.join(sizes, "root").select("doc_id", "group_id", "group_size", (_order() == F.col("best")).alias("is_best"), "times")
    rows = rows.select("doc_id", "group_id", "group_size", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda i: (i == 1) & F.col("is_best"))).alias("is_kept"))
    return rows.union(alone)


def _order():
    """Null ids are last; rows that share an id are in the order of their texts' hashes."""
    return F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("th").alias("c"))


def deduplicate(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """The rows of ``documents`` that ``near_duplicates`` keeps, with its five columns.

    Of rows that repeat each other one stays, but all of those whose texts are null, empty or wordless do. Nulls in any column stay
    as they are; an empty table gives no rows; further columns are left out.
    The texts move once, to meet the keys that are kept; both the join and the
    choice among repeated rows use that one partitioning.
    """
    g = _grouped(docs, distance, recall)
    best = g.filter("root is not null").groupBy("root").agg(F.min(_order()).alias("best"))
    keys = best.select(F.col("best.b").alias("doc_id"), F.col("best.c").alias("th"), F.lit(True).alias("once"))
    keys = keys.union(g.filter("root is null").select("doc_id", "th", F.lit(False)).distinct())
    keys = keys.select(_key("doc_id").alias("key"), "th", "once")
    rows = pick(docs, *DOCUMENT_COLUMNS).withColumns({"key": _key("doc_id"), "th": F.xxhash64("text")})
    same = Window.partitionBy("key", "th").orderBy("th")
    kept = rows.join(keys, ["key", "th"]).withColumn("nth", F.row_number().over(same))
    return kept.filter("nth = 1 or not once").select(*DOCUMENT_COLUMNS)


def _key(name: str):
    """A key that no other value has, null neither."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))

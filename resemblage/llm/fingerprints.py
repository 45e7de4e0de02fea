"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is five neighbouring words (lower case, cut at punctuation); of a text
with fewer words all of them are its only shingle. A sketch holds the k least of
the distinct shingles' hashes. The sketch of a union is the k least of the
sketches' union, so sketches of parts merge to that of the whole. From sketches
alone come estimates of the number of distinct shingles, of the resemblance of
two sets and of how far one contains the other.

Documents of equal sketches are one class. Two classes are linked if the estimate of their resemblance is
``LINK`` or more; every link is found, as follows. A linked pair shares so many hashes that it has one
among the rarest few of either (prefix filtering, the rarest first). Classes that have such a hash in common meet at the
least class that has it, in pairs of blocks of ``BLOCK`` classes, where products of 0-1 matrices count what they share; a pair that meets
several times is counted at the first. Hashes that stand in more than a few thousandths of the
rows, as those of a passage in a third of them, are the last in the order, so that rows hardly meet at them, and don't move by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_texts, pick, slices, written
from .words import mix, word_hashes

K, WORDS = 128, 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NONE = "(none)"
#: Hashes are halved to lie in [0, 2**63), where signed and unsigned order are the same.
SPACE = float(1 << 63)
_PAD = np.int64((1 << 63) - 1)
#: The least resemblance of a link.
LINK = 0.5
#: Classes of a block, and of the squares that its matrices are cut into; elements of a matrix of pairs.
BLOCK, SQUARE, ELEMENTS = 2048, 256, 4_000_000
#: A hash that stands in so many rows of a batch, or in one of so many, is reported; one that is reported for as large a share of all rows is common.
COMMON, COMMON_ROWS = 1000, 8
#: Sketches of names that a task holds.
MOST_NAMES = 20_000


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours among word hashes; of fewer words, one of them all."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.int64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = mix(h * _FACTOR + words[i : len(words) - n + 1 + i])
    return (h >> np.uint64(1)).astype(np.int64)


def least(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least distinct ones, ascending."""
    if len(hashes) > 8 * k:  # the repeated ones among the least may leave too few; then all are looked at
        some = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def sketches_of(texts: list[bytes], k: int = K, n: int = WORDS) -> list[np.ndarray]:
    hashes, at = word_hashes(texts)
    return [least(shingles(hashes[at[i] : at[i + 1]], n), k) for i in range(len(texts))]


def class_of(sketch: np.ndarray) -> int:
    """A 64-bit key of all equal sketches."""
    return xxhash.xxh3_64_intdigest(sketch.tobytes()) - (1 << 63)


def _sketched(column: pa.Array, k: int, n: int) -> list[np.ndarray]:
    texts, out = byte_texts(column), []
    for a, b in slices([len(t) for t in texts], 1_000_000):
        out += sketches_of(texts[a:b], k, n)
    return out


def _sketch(k: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_sketched(batch.column(2), k, n), pa.list_(pa.int64()))], names=["doc_id", "source", "sketch"])

    return run


def sketches(docs: DataFrame, k: int = K, n: int = WORDS) -> DataFrame:
    """``documents`` -> ``(doc_id, source, sketch)`` for each row; texts without words, null or empty, have empty sketches."""
    rows = pick(docs, "doc_id", "source", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_sketch(k, n), f"doc_id {kind}, source string, sketch array<long>")


def _merge(k: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["name", "sketch"])

        for batch in batches:
            column = batch.column(1)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            owner = np.repeat(codes, np.diff(ends))
            values = values[ends[0] : ends[-1]]
            order = np.argsort(owner, kind="stable")
            values, at = values[order], np.searchsorted(owner[order], np.arange(len(names.dictionary) + 1))
            for code, name in enumerate(names.dictionary.to_pylist()):
                held[name] = least(np.concatenate([held.get(name, values[:0]), values[at[code] : at[code + 1]]]), k)
            if len(held) > most:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def _merged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one name are neighbours: the last one waits for the next batch."""
        name, sketch, names, out = None, None, [], []
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1)):
                y = y.values.to_numpy(zero_copy_only=False)
                if x == name:
                    sketch = least(np.concatenate([sketch, y]), k)
                    continue
                if name is not None:
                    names.append(name), out.append(sketch)
                name, sketch = x, y
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.list_(pa.int64()))], names=["name", "sketch"])
                names, out = [], []
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([sketch], pa.list_(pa.int64()))], names=["name", "sketch"])

    return run


def merged(parts: DataFrame, k: int = K, most: int = MOST_NAMES) -> DataFrame:
    """``parts(name, sketch)`` -> ``(name, sketch)``, a row for each name: sketches of one name merge to that of their union.

    Each task merges what it reads first, so one sketch of a name and task
    moves, however many documents a name has; of more than ``most`` names in a task it gives what it has and goes on. A null name is "(none)".
    """
    rows = parts.select(F.coalesce("name", F.lit(_NONE)).alias("name"), "sketch")
    moved = rows.mapInArrow(_merge(k, most), "name string, sketch array<long>").repartition("name").sortWithinPartitions("name")
    return moved.mapInArrow(_merged(k), "name string, sketch array<long>")


def distinct_count(sketch: Column | str, k: int = K) -> Column:
    """About how many distinct shingles a sketch was made of; exact where it isn't full."""
    s = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.greatest(F.lit(float(k)), (k - 1) * SPACE / (F.element_at(s, k).cast("double") + 1)))


def overlap(a: Column, b: Column, k: int = K) -> tuple[Column, Column]:
    """Of the least ``k`` hashes of the union of two sketches: (how many are in both, how many there are)."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))), F.size(union)


def compared(a: Column, b: Column, k: int = K) -> tuple[Column, Column, Column]:
    """(resemblance, share of a that is in b, share of b that is in a); 0 where there is nothing to compare."""
    both, n = overlap(a, b, k)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = F.when(n > 0, both / n * distinct_count(union, k)).otherwise(0.0)

    def share(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.least(F.lit(1.0), shared / distinct_count(x, k))).otherwise(0.0)

    return F.when(n > 0, both / n).otherwise(0.0), share(a), share(b)


def compare(pairs: DataFrame, k: int = K) -> DataFrame:
    """``pairs`` with columns ``sketch_a`` and ``sketch_b`` -> with ``resemblance``, ``a_in_b`` and ``b_in_a`` too. A null sketch is empty."""
    a, b = (F.coalesce(c, F.array().cast("array<long>")) for c in ("sketch_a", "sketch_b"))
    r, ab, ba = compared(a, b, k)
    return pairs.withColumns({"resemblance": F.round(r, 6), "a_in_b": F.round(ab, 6), "b_in_a": F.round(ba, 6)})


def overlapping(parts: DataFrame, k: int = K) -> DataFrame:
    """``parts(name, sketch)`` of distinct names -> estimates for each pair whose sketches share a hash; for all others they are 0."""
    hashes = parts.select("name", F.explode("sketch").alias("h"))
    pairs = hashes.join(hashes.withColumnRenamed("name", "other"), "h").filter("name < other").select("name", "other").distinct()
    left = parts.select("name", F.col("sketch").alias("sketch_a"))
    right = parts.select(F.col("name").alias("other"), F.col("sketch").alias("sketch_b"))
    return compare(pairs.join(left, "name").join(right, "other"), k).select("name", "other", "resemblance", "a_in_b", "b_in_a")


def _gathered(k: int, n: int, common: int, least_rows: int, most: int):
    """Three kinds of rows: 0, the class of each document and how many shingles it has; 1, hashes that are common in a batch; 2, merged sketches of sources."""

    def rows(kind: int, size: int, /, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int8()), *(columns.get(c, pa.nulls(size, t)) for c, t in _GATHERED.items())], names=["kind", *_GATHERED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sources() -> pa.RecordBatch:
            return rows(2, len(held), name=pa.array(list(held), pa.string()), sketch=pa.array(list(held.values()), pa.list_(pa.int64())))

        for batch in batches:
            found = _sketched(batch.column(2), k, n)
            keys = pa.array([class_of(x) if len(x) else None for x in found], pa.int64())
            counts = pa.array([float(len(x)) if len(x) < k else max(float(k), (k - 1) * SPACE / (float(x[k - 1]) + 1)) for x in found], pa.float64())
            yield rows(0, len(found), doc_id=batch.column(0).cast(pa.int64()), **{"class": keys, "count": counts})
            h, times = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            often = times >= max(least_rows, batch.num_rows // common)
            yield rows(1, int(often.sum()), h=pa.array(h[often]), times=pa.array(times[often].astype(np.int64)))
            own: dict[str, list[np.ndarray]] = {}
            for name, x in zip(batch.column(1).to_pylist(), found):
                own.setdefault(_NONE if name is None else name, []).append(x)
            for name, xs in own.items():
                held[name] = least(np.concatenate([*xs, held[name]] if name in held else xs), k)
            if len(held) > most:
                yield sources()
                held.clear()
        yield sources()

    return run


_GATHERED = {"doc_id": pa.int64(), "class": pa.int64(), "count": pa.float64(), "h": pa.int64(), "times": pa.int64(), "name": pa.string(), "sketch": pa.list_(pa.int64())}


def gathered(docs: DataFrame, k: int, n: int, common: int, common_rows: int) -> DataFrame:
    """What one pass over the texts tells of classes, common hashes and sources, written."""
    rows = pick(docs, "doc_id", "source", "text")
    return written(rows.mapInArrow(_gathered(k, n, common, common_rows, MOST_NAMES), "kind byte, doc_id long, class long, count double, h long, times long, name string, sketch array<long>"))


def common_hashes(parts: DataFrame, n: int, common: int = COMMON, least_rows: int = COMMON_ROWS) -> DataFrame:
    """``(h)``: hashes in a ``common``-th of ``n`` sketches at least, so K times ``common`` at most; all that are in a few times as many are among them."""
    counts = parts.filter("kind = 1").groupBy("h").agg(F.sum("times").alias("times"))
    return counts.filter(F.col("times") >= max(2 * least_rows, n / common)).select("h")


def _tokens(k: int, n: int):
    """``(h, class, code)`` for each hash of each class of a batch; a code is 256 times the sketch's size and the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {class_of(x): x for x in _sketched(batch.column(0), k, n) if len(x)}
            if found:
                sizes = np.array([len(x) for x in found.values()])
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(found.values()))), pa.array(np.repeat(np.array(list(found), np.int64), sizes)), pa.array((place + 256 * np.repeat(sizes, sizes)).astype(np.int32))], names=["h", "class", "code"])

    return run


def _repeated(n: int):
    """Of rows ``(h, class, code)`` in the order of h and class those whose h has more than one class, each once, with how many classes it has.

    The code of a common hash is negative: it stays, and counts as one of ``n`` classes.
    """

    def out(rows: pa.Table) -> list[pa.RecordBatch]:
        h, c = rows.column("h").to_numpy(), rows.column("class").to_numpy()
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        rows, h = rows.filter(pa.array(new)), h[new]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        code = rows.column("code").to_numpy()
        df = np.where(code < 0, n, np.diff(np.append(np.flatnonzero(first), len(h)))[np.cumsum(first) - 1])
        rows = rows.set_column(2, "code", pa.array(np.where(code < 0, -1 - code, code).astype(np.int32)))
        return rows.append_column("df", pa.array(df, pa.int64())).filter(pa.array(df > 1)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            last = int(np.searchsorted(h, h[-1]))  # what has the last hash waits for the next batch
            if last or (held and held[-1].column(0)[-1].as_py() != h[0]):
                held.append(batch.slice(0, last))
                yield from out(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def records(docs: DataFrame, hot: DataFrame, rows: int, k: int, n: int, link: float) -> DataFrame:
    """``documents`` -> ``(class, prefix, hashes, ranks)`` of classes that share enough hashes with others to be linked.

    ``hashes`` are those that other classes have too, ascending, ``ranks`` their places in the sketch, ``prefix`` the rarest of
    them, so many that of any two linked classes the rarest hash they share is in both.
    """
    found = pick(docs, "text").mapInArrow(_tokens(k, n), "h long, class long, code int")
    hot = F.broadcast(hot.withColumn("hot", F.lit(True)))  # at most k * common hashes
    found = found.join(hot, "h", "left").select("h", "class", F.when(F.col("hot"), -1 - F.col("code")).otherwise(F.col("code")).alias("code"))
    # a common hash goes by its classes, so that no task has all of them
    found = found.repartition(F.when(F.col("code") < 0, F.col("class")).otherwise(F.col("h"))).sortWithinPartitions("h", "class")
    shared = found.mapInArrow(_repeated(max(rows, 2)), "h long, class long, code int, df long").repartition("class")
    lists = shared.groupBy("class").agg(F.first("code").alias("code"), F.array_sort(F.collect_set(F.struct("df", "h", (F.col("code") % 256).cast("short").alias("rank")))).alias("xs"))  # k at most
    need = F.ceil(F.lit(link) * F.floor(F.col("code") / 256) - 1e-9).cast("int")
    able = lists.withColumn("spare", F.size("xs") - need).filter("spare >= 0")
    by_hash = F.array_sort(F.transform("xs", lambda x: F.struct(x["h"], x["rank"])))
    return able.select("class", F.slice("xs.h", 1, F.col("spare") + 1).alias("prefix"), by_hash.alias("ys")).select("class", "prefix", F.col("ys.h").alias("hashes"), F.col("ys.rank").alias("ranks"))


def _matrix(flat: np.ndarray, owner: np.ndarray, rows: np.ndarray, known: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Which of the ``known`` hashes each of ``rows`` has (or with what value; -1 if not)."""
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = known[at] == flat
    out = np.zeros((len(rows), len(known)), np.float32) if values is None else np.full((len(rows), len(known)), -1, np.int16)
    out[np.searchsorted(rows, owner[hit]), at[hit]] = 1 if values is None else values[hit]
    return out


class _Ragged:
    """A list column: flat values, their rows, and where each row starts."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks()
        self.ends = column.offsets.to_numpy().astype(np.int64)
        self.flat = column.values.to_numpy(zero_copy_only=False)[self.ends[0] : self.ends[-1]]
        self.ends = self.ends - self.ends[0]

    def part(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.flat[self.ends[a] : self.ends[b]], np.repeat(np.arange(a, b), np.diff(self.ends[a : b + 1]))


def _links(k: int, link: float, square: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hub, i, j = (x.as_py() for x in key)
        table = table.sort_by([("block", "ascending"), ("class", "ascending")])
        block, own, count = (table.column(c).to_numpy() for c in ("block", "class", "count"))
        hashes, ranks, hubs = _Ragged(table.column("hashes")), _Ragged(table.column("ranks")), _Ragged(table.column("hubs"))
        size = np.minimum(k, count).astype(np.int64)
        need = np.ceil(link * size - 1e-9)
        middle = int(np.searchsorted(block, i, side="right")) if i != j else len(block)
        found = []
        for a in range(0, middle, square):
            for b in range(a if i == j else middle, len(block), square):
                found += _square((a, min(a + square, middle)), (b, min(b + square, len(block))), hub, hashes, ranks, hubs, size, need, k, link)
        r, c, res = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        a, b, res = np.concatenate([r, c]), np.concatenate([c, r]), np.concatenate([res, res])
        shared = res * (count[a] + count[b]) / (1 + res)
        ids = table.column("class_id").combine_chunks()
        known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.cast(pa.int64()).fill_null(0).to_numpy()
        order = np.lexsort((own[b], number[b], ~known[b], -res, a))  # the best link of each class first
        a, b, res, shared = a[order], b[order], res[order], shared[order]
        best = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        x, y = a[best], b[best]
        return pa.table(
            {
                "class": own[x], "links": np.bincount(a, minlength=len(own))[x], "resemblance": res[best], "other": own[y], "other_id": pa.array(number[y], mask=~known[y]),
                "a_in_b": np.minimum(1.0, shared[best] / count[x]), "b_in_a": np.minimum(1.0, shared[best] / count[y]),
            }
        )

    return run


def _square(rows: tuple[int, int], columns: tuple[int, int], hub: int, hashes: _Ragged, ranks: _Ragged, hubs: _Ragged, size: np.ndarray, need: np.ndarray, k: int, link: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The links between two ranges of classes that no lesser hub has found."""
    same = rows == columns
    (ha, oa), (hb, ob) = hashes.part(*rows), hashes.part(*columns)
    if same:
        v, n = np.unique(ha, return_counts=True)
        known = v[n > 1]
    else:
        known = np.intersect1d(ha, hb)
    if not len(known):
        return []
    ra, rb = np.arange(*rows), np.arange(*columns)
    x = _matrix(ha, oa, ra, known)
    y = x if same else _matrix(hb, ob, rb, known)
    shared = x @ y.T
    near = shared >= np.maximum(need[ra][:, None], need[rb][None, :])
    if same:
        near &= np.arange(len(ra))[:, None] < np.arange(len(rb))[None, :]
    if not near.any():
        return []
    (ua, pa_), (ub, pb) = hubs.part(*rows), hubs.part(*columns)
    less_a, less_b = ua < hub, ub < hub
    earlier = np.intersect1d(ua[less_a], ub[less_b])
    if len(earlier):
        near &= (_matrix(ua[less_a], pa_[less_a], ra, earlier) @ _matrix(ub[less_b], pb[less_b], rb, earlier).T) == 0
    r, c = np.nonzero(near)
    if not len(r):
        return []
    x = _matrix(ha, oa, ra, known, ranks.part(*rows)[0])
    y = x if same else _matrix(hb, ob, rb, known, ranks.part(*columns)[0])
    out, step = [], max(1, ELEMENTS // len(known))
    for a in range(0, len(r), step):
        p, q = r[a : a + step], c[a : a + step]
        u, v = x[p], y[q]
        both = (u >= 0) & (v >= 0)
        # a hash that is the i-th, j-th and m-th of a, of b and of what they share is the (i + j - m)-th of the union
        least_k = both & (u + v + 2 - np.cumsum(both, axis=1, dtype=np.int16) <= k)
        res = least_k.sum(axis=1) / np.minimum(k, size[ra[p]] + size[rb[q]] - shared[p, q])
        ok = res >= link - 1e-12
        out.append((ra[p[ok]], rb[q[ok]], res[ok]))
    return out


def classes(docs: DataFrame, parts: DataFrame, k: int = K, n: int = WORDS, link: float = LINK, block: int = BLOCK, square: int = SQUARE, common: int = COMMON, common_rows: int = COMMON_ROWS) -> DataFrame:
    """``documents`` and what was ``gathered`` of them -> ``(class, class_id, class_size, n_links, other_id, resemblance, a_in_b, b_in_a)``, a row for each class.

    ``class_id`` is the least ``doc_id`` of the class. ``n_links`` counts the other classes that resemble it by ``link`` or more; what follows is
    of the one that does most (of several the one of least ``class_id``, nulls last), and null without any.
    """
    known = parts.filter("kind = 0 and class is not null")
    own = written(known.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.first("count").alias("count")))
    able = written(records(docs, common_hashes(parts, rows := known.count(), common, common_rows), rows, k, n, link))
    posted = able.select("class", F.explode("prefix").alias("h"))
    least_class = posted.groupBy("h").agg(F.min("class").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("h", "hub")
    met = written(posted.join(least_class, "h").select("hub", "class").distinct())
    blocks = met.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    wide = met.groupBy("class").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))  # as many as a prefix has hashes
    wide = able.select("class", "hashes", "ranks").join(wide, "class").join(own.select("class", "class_id", "count"), "class")
    dealt = met.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("hub", "class", "block", other.alias("o")).select("hub", "class", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    parts = dealt.join(wide, "class").groupBy("hub", "i", "j").applyInArrow(_links(k, link, square), "class long, links long, resemblance double, other long, other_id long, a_in_b double, b_in_a double")
    order = F.struct((-F.col("resemblance")).alias("r"), F.col("other_id").isNull().alias("last"), "other_id", "other", "a_in_b", "b_in_a")
    sums = parts.groupBy("class").agg(F.sum("links").alias("n_links"), F.min(order).alias("x"))
    return own.join(sums, "class", "left").select(
        "class", "class_id", "class_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("x.other_id").alias("other_id"),
        F.round(-F.col("x.r"), 6).alias("resemblance"), F.round("x.a_in_b", 6).alias("a_in_b"), F.round("x.b_in_a", 6).alias("b_in_a"),
    )


def fingerprint(docs: DataFrame, k: int = K, n: int = WORDS, link: float = LINK, **how) -> DataFrame:
    """``documents`` -> ``(level, doc_id, other_id, name, other, n_shingles, resemblance, a_in_b, b_in_a, class_id, class_size, n_links, sketch)``.

    Level "document": a row for each row, with its sketch and about how many
    distinct shingles it has. Level "links": a row for each row again, with the class of equal sketches that it is of
    (named by the least ``doc_id``), how many rows that has, how many other classes resemble it by ``link`` or more, and with the one
    that does most as ``other_id`` the three estimates. Level "source": the sketches of a source's documents
    merged, a row for each source (null is "(none)"). Level "pair": for each two
    sources, the resemblance of ``name`` and ``other``, and
    how far each is contained in the other. Null, empty and wordless texts have empty
    sketches, count 0 and are of no class; repeated rows repeat; very long texts are read whole; an empty table gives no rows; other columns are
    ignored, whatever their names. Ids are integers. Texts are read three times, as sketches of all of them would be larger than what
    is kept of them. ``how`` is passed to ``classes``; the result doesn't depend on it.
    """
    parts = gathered(docs, k, n, how.get("common", COMMON), how.get("common_rows", COMMON_ROWS))
    linked = parts.filter("kind = 0").select("doc_id", "class").join(classes(docs, parts, k, n, link, **how), "class", "left")
    sources = written(merged(parts.filter("kind = 2").select("name", "sketch"), k))
    each = sketches(docs, k, n)
    kind = each.schema["doc_id"].dataType
    shape = {
        "level": "string", "doc_id": kind, "other_id": kind, "name": "string", "other": "string", "n_shingles": "double", "resemblance": "double", "a_in_b": "double", "b_in_a": "double",
        "class_id": kind, "class_size": "long", "n_links": "long", "sketch": "array<long>",
    }

    def shaped(df: DataFrame, level: str) -> DataFrame:
        df = df.withColumn("level", F.lit(level))
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()])

    a = each.select("doc_id", F.coalesce("source", F.lit(_NONE)).alias("name"), F.round(distinct_count("sketch", k), 3).alias("n_shingles"), "sketch")
    b = sources.select("name", F.round(distinct_count("sketch", k), 3).alias("n_shingles"), "sketch")
    return shaped(a, "document").unionByName(shaped(linked, "links")).unionByName(shaped(b, "source")).unionByName(shaped(overlapping(sources, k), "pair"))

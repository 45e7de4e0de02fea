"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by hash. A shard's graph is a handful of flat
arrays: for each layer the nodes that reach it, and a row of neighbours for each.
Nodes are put in in blocks that double; all searches of a block walk the graph in
lockstep, so that numpy does each step for all of them. Every vector is in the index. The
queries (every ``EVERY``-th id) are searched in every shard, and the shards' results are merged.

A task has one shard's graph at a time and the queries stream through it, so a graph
moves once for each ``SEARCHES`` queries and no task holds more than a graph and a batch.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pick, written

#: Neighbours wanted; links of a node (twice as many on the ground layer); beams while building and searching.
K, LINKS, BUILD, BEAM = 10, 16, 100, 64
#: Rows whose ids this divides are the queries.
EVERY = 20
#: A shard has SHARD vectors at least, about, while there are fewer than SPREAD shards; beyond that as many as SHARD_BYTES hold.
SHARD, SPREAD, SHARD_BYTES = 16_384, 32, 128_000_000
#: Searches that one task makes on one shard, at most, about.
SEARCHES = 1_000_000
_LOCKSTEP, _STEPS = 256, 4


class Graph:
    """A navigable small world over unit vectors ``x``; ``near[l]`` has the neighbours on layer l of the nodes, by ``place[l]``."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray], place: list[np.ndarray], entry: int):
        self.x, self.near, self.place, self.entry = x, near, place, entry

    def search_layer(self, layer: int, q: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``q`` the ``beam`` best nodes found from ``entries`` (a row each, -1 for none), best first, and their similarities."""
        near, place, x = self.near[layer], self.place[layer], self.x
        n, links = len(q), near.shape[1]
        width = max(beam, entries.shape[1])
        ids, sims = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
        seen = np.full((n, len(near)), -1, np.int16)
        r, c = np.nonzero(entries >= 0)
        ids[r, c] = entries[r, c]
        sims[r, c] = np.einsum("ij,ij->i", q[r], x[entries[r, c]])
        seen[r, place[entries[r, c]]] = 0
        fresh = ids >= 0
        active = np.arange(n)
        steps = min(_STEPS, width)
        while len(active):
            best = np.where(fresh[active], sims[active], -np.inf)
            chosen = np.argpartition(-best, steps - 1, axis=1)[:, :steps] if steps < width else np.broadcast_to(np.arange(width), best.shape)
            open_ = np.take_along_axis(best, chosen, 1) > -np.inf
            go = open_.any(axis=1)
            if not go.all():
                active, chosen, open_ = active[go], chosen[go], open_[go]
                if not len(active):
                    break
            rows = active[:, None]
            fresh[rows, chosen] = False
            nodes = np.where(open_, ids[rows, chosen], 0)
            found = np.where(open_[:, :, None], near[place[nodes]], -1).reshape(len(active), -1)
            at = place[found]
            new = (found >= 0) & (seen[rows, at] < 0)
            a, s = np.nonzero(new)
            spots = at[a, s]
            seen[active[a], spots] = s  # of a node that came twice, one place stays
            once = seen[active[a], spots] == s
            a, s = a[once], s[once]
            own = found[a, s]
            more_ids, more = np.full(found.shape, -1, np.int32), np.full(found.shape, -np.inf, np.float32)
            more_ids[a, s] = own
            more[a, s] = np.einsum("ij,ij->i", q[active[a]], x[own])
            all_sims = np.concatenate([sims[active], more], axis=1)
            all_ids = np.concatenate([ids[active], more_ids], axis=1)
            all_fresh = np.concatenate([fresh[active], more_ids >= 0], axis=1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[active], ids[active], fresh[active] = (np.take_along_axis(v, top, 1) for v in (all_sims, all_ids, all_fresh))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """An entry for each row of ``q``, from the top to above layer ``down_to``."""
        entries = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.near) - 1, down_to, -1):
            entries = self.search_layer(layer, q, entries, 1)[0]
        return entries

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best nodes for each row of ``q``, -1 where there are fewer."""
        ids, sims = np.full((len(q), k), -1, np.int32), np.full((len(q), k), -np.inf, np.float32)
        for a in range(0, len(q), _LOCKSTEP):
            part = q[a : a + _LOCKSTEP]
            i, s = self.search_layer(0, part, self.descend(part, 0), max(beam, k))
            ids[a : a + _LOCKSTEP], sims[a : a + _LOCKSTEP] = i[:, :k], s[:, :k]
        return ids, sims

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, entry=self.entry, layers=len(self.near), **{f"n{i}": v for i, v in enumerate(self.near)}, **{f"p{i}": v for i, v in enumerate(self.place)})
        return out.getvalue()

    @staticmethod
    def unpack(raw: bytes) -> Graph:
        z = np.load(io.BytesIO(raw))
        layers = int(z["layers"])
        return Graph(z["x"], [z[f"n{i}"] for i in range(layers)], [z[f"p{i}"] for i in range(layers)], int(z["entry"]))


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates, best first, at most ``most``: those nearer to the node than to any chosen before; then the best of the rest."""
    n, c = ids.shape
    v = x[np.maximum(ids, 0)]
    pairs = v @ v.transpose(0, 2, 1)
    valid = ids >= 0
    chosen = np.zeros((n, c), bool)
    for j in range(c):
        blocked = (chosen & (pairs[:, j, :] >= sims[:, j, None])).any(axis=1)
        chosen[:, j] = valid[:, j] & ~blocked & (chosen.sum(axis=1) < most)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(np.where(valid, ids, -1), order, 1)
    return out if c >= most else np.pad(out, ((0, 0), (0, most - c)), constant_values=-1)


def _link_back(g: Graph, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Each neighbour that ``nodes`` chose gets the node among its own candidates, and chooses anew if it has too many."""
    near, place, x = g.near[layer], g.place[layer], g.x
    most = near.shape[1]
    r, c = np.nonzero(chosen >= 0)
    to, new = chosen[r, c], nodes[r]
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    targets, first, times = np.unique(to, return_index=True, return_counts=True)
    for a in range(0, len(targets), 512):
        t, f, k = targets[a : a + 512], first[a : a + 512], times[a : a + 512]
        wide = int(k.max())
        at = f[:, None] + np.minimum(np.arange(wide), k[:, None] - 1)
        added = np.where(np.arange(wide) < k[:, None], new[at], -1)
        ids = np.concatenate([near[place[t]], added], axis=1)
        sims = np.where(ids >= 0, np.einsum("ij,ikj->ik", x[t], x[np.maximum(ids, 0)]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        full = (ids[:, most:] >= 0).any(axis=1) if ids.shape[1] > most else np.zeros(len(t), bool)
        near[place[t[~full]]] = ids[~full, :most]
        if full.any():
            near[place[t[full]]] = _diverse(x, ids[full], sims[full], most)


def build(x: np.ndarray, links: int = LINKS, beam: int = BUILD, seed: int = 5) -> Graph:
    """The graph of the unit vectors ``x``, put in in the order given."""
    n = len(x)
    levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(links)).astype(int), 12)
    levels[0] = levels.max(initial=0)
    g, place, near = Graph(x, [], [], 0), [], []
    for layer in range(levels[0] + 1):
        own = np.flatnonzero(levels >= layer)
        where = np.zeros(n, np.int32)
        where[own] = np.arange(len(own))
        place.append(where)
        near.append(np.full((len(own), links * (2 if layer == 0 else 1)), -1, np.int32))
    g.near, g.place = near, place
    done = 1
    while done < n:
        nodes = np.arange(done, min(n, done + min(done, 2 * _LOCKSTEP)), dtype=np.int32)
        q = x[nodes]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        entries = np.zeros((len(nodes), 1), np.int32)
        for layer in range(len(near) - 1, -1, -1):
            here = levels[nodes] >= layer
            entries_low = g.search_layer(layer, q[~here], entries[~here][:, :1], 1)[0] if (~here).any() else None
            following = np.full((len(nodes), beam if here.any() else 1), -1, np.int32)
            if entries_low is not None:
                following[~here, :1] = entries_low
            if here.any():
                own, starts = nodes[here], entries[here]
                ids, sims = g.search_layer(layer, q[here], starts[:, : max(1, (starts >= 0).any(axis=0).sum())], beam)
                following[here] = ids
                # nodes of the same block can't be found by search yet: they are compared directly
                side = np.where(here[None, :], among[here], -np.inf)
                top = np.argsort(-side, axis=1)[:, : min(links * 2, side.shape[1])]
                block_sims = np.take_along_axis(side, top, 1)
                block_ids = np.where(block_sims > -np.inf, nodes[top], -1)
                ids, sims = np.concatenate([ids, block_ids], axis=1), np.concatenate([sims, block_sims], axis=1).astype(np.float32)
                order = np.argsort(-sims, axis=1, kind="stable")[:, : beam // 2 + links]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
                chosen = _diverse(x, ids, sims, links)
                near[layer][place[layer][own], :links] = chosen
                _link_back(g, layer, own, chosen)
            entries = following
        done += len(nodes)
    return g


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    """Unit vectors."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distinct(table: pa.Table) -> pa.Table:
    """One row for each id and key; rows of one vector and id share both."""
    ids = table.column("vec_id").combine_chunks()
    rows = np.stack([table.column("key").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)], axis=1)
    return table.take(pa.array(np.sort(np.unique(rows, axis=0, return_index=True)[1])))


def _build(dimension: int, links: int, beam: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = _distinct(table.sort_by("key"))
        keys, x = rows.column("key").to_numpy(), _vectors(rows.column("embedding"), dimension)
        # equal vectors are one node
        _, first, node = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * dimension))).ravel(), return_index=True, return_inverse=True)
        place = np.argsort(np.argsort(first))  # in the order of keys, which are hashes
        first, node = np.sort(first), place[node]
        vec = rows.column("vec_id").combine_chunks().cast(pa.int64())
        order = np.lexsort((keys, vec.fill_null(0).to_numpy(), vec.is_null().to_numpy(zero_copy_only=False), node))  # a node offers its least ids, nulls last
        g = build(np.ascontiguousarray(x[first]), links, beam)
        starts = np.searchsorted(node[order], np.arange(len(first) + 1)).astype(np.int64)
        ids = vec.take(pa.array(order))
        return pa.table({"shard": [key[0].as_py()], "graph": [g.pack()], "keys": [keys[order].tobytes()], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "starts": [starts.tobytes()]})

    return run


_NEAR = pa.list_(pa.struct([("similarity", pa.float64()), ("vec_id", pa.int64()), ("key", pa.int64())]))


class _Shard:
    """A shard's graph, and the ids and keys of the vectors of each node."""

    def __init__(self, graph: bytes, keys: bytes, ids: list, starts: bytes):
        self.graph, self.keys, self.starts = Graph.unpack(graph), np.frombuffer(keys, np.int64), np.frombuffer(starts, np.int64)
        self.ids, self.known = np.array([-1 if i is None else i for i in ids], np.int64), np.array([i is not None for i in ids], bool)

    def search(self, rows: pa.RecordBatch, dimension: int, k: int, beam: int) -> pa.RecordBatch:
        keys, vec = (rows.column(rows.schema.get_field_index(c)) for c in ("key", "vec_id"))
        keys, ids, known = keys.to_numpy(), vec.fill_null(-1).to_numpy(zero_copy_only=False), vec.is_valid().to_numpy(zero_copy_only=False)
        found, sims = self.graph.search(_vectors(rows.column(rows.schema.get_field_index("embedding")), dimension), k + 1, beam)
        out_s, out_m, lengths = [], [], []
        for i in range(len(keys)):
            nodes = found[i][found[i] >= 0]
            # of a node with many vectors the least ids, one more than wanted as the query itself may be one
            spans = [np.arange(self.starts[j], min(self.starts[j + 1], self.starts[j] + k + 1)) for j in nodes]
            members = np.concatenate(spans) if spans else np.zeros(0, np.int64)
            s = np.repeat(sims[i][: len(spans)], [len(v) for v in spans])
            other = (self.keys[members] != keys[i]) | (self.ids[members] != ids[i]) | (self.known[members] != known[i])
            members, s = members[other][:k], s[other][:k]
            out_m.append(members), out_s.append(s), lengths.append(len(members))
        members = np.concatenate(out_m).astype(np.int64)
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(out_s).astype(np.float64)), pa.array(self.ids[members], mask=~self.known[members]), pa.array(self.keys[members])], names=["similarity", "vec_id", "key"])
        near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
        return pa.RecordBatch.from_arrays([vec, pa.array(keys, pa.int64()), near.cast(_NEAR)], names=["vec_id", "key", "near"])


def _stream(dimension: int, k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            graphs = batch.column(batch.schema.get_field_index("graph")).is_valid().to_numpy(zero_copy_only=False)
            at = 0
            for g in [*np.flatnonzero(graphs).tolist(), batch.num_rows]:  # a graph comes before its queries
                for a in range(at, g, 2048):
                    yield shard.search(batch.slice(a, min(2048, g - a)), dimension, k, beam)
                if g < batch.num_rows:
                    shard = _Shard(*(batch.column(batch.schema.get_field_index(c))[g].as_py() for c in ("graph", "keys", "ids", "starts")))
                at = g + 1

    return run


def shards_of(n: int, dimension: int, links: int = LINKS, shard: int = SHARD, most: int = SHARD_BYTES) -> int:
    """How many shards ``n`` vectors are dealt to."""
    return max(1, -(-n * (4 * dimension + 8 * links + 64) // most), min(SPREAD, -(-n // shard)))


def neighbours(
    vectors: DataFrame, k: int = K, every: int = EVERY, links: int = LINKS, build_beam: int = BUILD, beam: int = BEAM, shard: int = SHARD, searches: int = SEARCHES
) -> DataFrame:
    """``embeddings`` -> ``(vec_id, neighbour_ids, similarities)``: the ``k`` vectors of greatest cosine, best first, for each vector whose id ``every`` divides.

    Queries are searched for among all vectors, in every shard. A query is no neighbour of its own,
    but another of the same direction is one; of equal similarities the lesser id is first. Rows that repeat
    id and vector count once. Vectors that are null, empty, zero, not finite, have a null in
    them, or another dimension than most, have no neighbours (empty arrays) and are nobody's. Ids may repeat; a null
    id is no query unless ``every`` is 1, but may be a neighbour. An empty table gives no rows; other columns are ignored.
    """
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = rows.withColumn("square", squares)
    usable = F.coalesce((F.col("square") > 0) & (F.col("square") < 1e30) & ~F.isnan("square"), F.lit(False))
    asked = F.lit(True) if every == 1 else F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    most = rows.filter(usable).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.sum(asked.cast("long")).alias("asked")).orderBy(F.desc("n"), "d").first()
    lists = {"neighbour_ids": "array<long>", "similarities": "array<double>"}
    if most is None:
        return rows.filter(asked).select("vec_id", *[F.array().cast(t).alias(c) for c, t in lists.items()]).distinct()
    dimension, n = most["d"], most["n"]
    good = usable & (F.size("embedding") == dimension)
    shards, parts = shards_of(n, dimension, links, shard), max(1, -(-most["asked"] // searches))
    keyed = rows.filter(good).select("vec_id", "embedding", F.xxhash64("vec_id", "embedding").alias("key"))
    to_shards = keyed.withColumn("shard", F.pmod(F.xxhash64(F.col("key")), F.lit(shards)).cast("long"))
    graphs = written(to_shards.groupBy("shard").applyInArrow(_build(dimension, links, build_beam), "shard long, graph binary, keys binary, ids array<long>, starts binary"))
    left = graphs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    right = keyed.filter(asked).dropDuplicates(["vec_id", "key"]).withColumns({"part": F.pmod(F.xxhash64(F.col("key"), F.lit(1)), F.lit(parts)).cast("long"), "shard": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))})
    both = left.unionByName(right, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("graph").isNull())
    found = both.mapInArrow(_stream(dimension, k, beam), "vec_id long, key long, near array<struct<similarity: double, vec_id: long, key: long>>")
    found = found.groupBy("key", "vec_id").agg(F.flatten(F.collect_list("near")).alias("near"))  # k for each shard
    first = F.transform("near", lambda x: F.struct((-x["similarity"]).alias("s"), x["vec_id"].isNull().alias("last"), x["vec_id"].alias("vec_id"), x["key"].alias("key")))
    best = found.withColumn("near", F.slice(F.array_sort(first), 1, k))
    merged = best.select("vec_id", F.col("near.vec_id").alias("neighbour_ids"), F.transform("near.s", lambda s: F.round(-s, 6)).alias("similarities"))
    others = rows.filter(~good & asked).select("vec_id", *[F.array().cast(t).alias(c) for c, t in lists.items()]).distinct()
    return merged.unionByName(others)

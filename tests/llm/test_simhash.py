"""Near duplicates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DATA, DOCUMENTS, WORDS, documents

from resemblage.llm import simhash
from resemblage.llm.components import components


def distances(f):
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1).astype(int)
    return (bits[:, None, :] != bits[None, :, :]).sum(axis=2)


def groups_by_brute_force(f, distance=simhash.DISTANCE):
    near = distances(f) <= distance
    root = list(range(len(f)))
    for i in range(len(f)):
        for j in np.flatnonzero(near[i, :i]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_groups_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    f, known = simhash.fingerprint_all([r["text"].encode() for r in rows])
    root = groups_by_brute_force(f)
    want = {rows[i]["doc_id"]: rows[root[i]]["doc_id"] if known[i] else rows[i]["doc_id"] for i in range(len(rows))}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r["group_id"] for i, r in got.items()} == want
    assert all(r["is_kept"] == (r["group_id"] == i) for i, r in got.items())
    kept = simhash.deduplicate(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, r in got.items() if r["is_kept"]) and set(kept) <= set(docs.collect())


def test_edited_copies_meet_and_others_do_not(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)] + WORDS
    rows, of = [], {}
    for g in range(30):
        base = r.choices(words, k=120)
        for k in range(4):
            copy = list(base)
            for _ in range(2 * k):
                copy[r.randrange(len(copy))] = r.choice(words)
            of[len(rows)] = g
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    got = {x["doc_id"]: x["group_id"] for x in simhash.near_duplicates(documents(spark, rows)).collect()}
    met = [got[i] == got[i - i % 4] for i in got]
    assert np.mean(met) >= 0.9 and all(of[i] == of[g] for i, g in got.items())


def test_recall_of_pairs_at_the_limit(spark):
    rng = np.random.default_rng(4)
    n = 3000
    bits = rng.integers(0, 2, (n, simhash.BITS), dtype=np.uint8)
    for i in range(0, 600, 2):
        bits[i + 1] = bits[i]
        bits[i + 1, rng.choice(simhash.BITS, simhash.DISTANCE, replace=False)] ^= 1
    f = np.packbits(bits, axis=1).view(np.uint64)
    node = simhash.node_ids(f).view(np.int64)
    df = spark.createDataFrame([tuple(int(x) for x in row) for row in f.view(np.int64)], ", ".join(f"{w} long" for w in simhash.WORDS))
    old, simhash.LIST = simhash.LIST, 50  # so that lists are short beside the table
    try:
        edges = {(r["a"], r["b"]) for r in simhash.close_nodes(df, n).collect()}
    finally:
        simhash.LIST = old
    planted = {tuple(sorted((int(node[i]), int(node[i + 1])))) for i in range(0, 600, 2)}
    assert len(edges & planted) / len(planted) >= 0.9 and edges <= planted


def linked(edges, nodes):
    """Which nodes the edges connect."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("long", [1 << 30, 40, 12])
def test_long_lists_lose_nothing(spark, long):
    """A hot group of close fingerprints, in chains too: lists of any length give the same groups as brute force."""
    rng = np.random.default_rng(long % 7)
    centre = rng.integers(0, 2, simhash.BITS, dtype=np.uint8)
    bits = [centre]
    for i in range(250):
        row = bits[int(rng.integers(0, len(bits)))].copy() if i < 200 else rng.integers(0, 2, simhash.BITS, dtype=np.uint8)
        row[rng.choice(simhash.BITS, 12, replace=False)] ^= 1
        bits.append(row)
    f = np.packbits(np.array(bits), axis=1).view(np.uint64)
    node = simhash.node_ids(f).view(np.int64).tolist()
    df = spark.createDataFrame([tuple(int(x) for x in row) for row in f.view(np.int64)], ", ".join(f"{w} long" for w in simhash.WORDS)).repartition(3)
    edges = [(r["a"], r["b"]) for r in simhash.close_nodes(df, len(f), long=long).collect()]
    want = {}
    for i, r in enumerate(groups_by_brute_force(f)):
        want.setdefault(r, set()).add(node[i])
    assert linked(edges, node) == {frozenset(g) for g in want.values()} and len(want) == 51


def test_search_over_any_batches():
    """Lists that end, begin or go on at the bounds of batches, long ones too."""
    rng = np.random.default_rng(6)
    sizes = [1, 5, 30, 2, 2, 40, 1, 3, 7, 31, 8]
    lists = np.repeat(np.arange(len(sizes)), sizes)
    base = rng.integers(0, 1 << 62, (len(sizes), 4), dtype=np.int64)
    f = base[lists] ^ rng.integers(0, 4, (len(lists), 4))
    table = pa.table({"list": lists, **{w: f[:, k] for k, w in enumerate(simhash.WORDS)}})
    for step in (1, 3, 10, 33, 1000):
        out = pa.Table.from_batches(simhash._search(simhash.DISTANCE, 10)(iter(table.to_batches(max_chunksize=step))))
        assert sorted(x for x in out.column("list").to_pylist() if x is not None) == [x for x in lists.tolist() if sizes[x] > 10]
        edges = {(a, b) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist()) if a is not None}
        node = simhash.node_ids(f.view(np.uint64)).view(np.int64).tolist()
        want = {frozenset(node[i] for i in np.flatnonzero(lists == k)) for k, n in enumerate(sizes) if n <= 10}
        assert {g for g in linked(edges, set(node)) if len(g) > 1} == {g for g in want if len(g) > 1}


def test_null_and_the_text_null_are_two_ids(spark):
    rows = spark.createDataFrame([("null", ".", "en", "s", 1), (None, ".", "en", "s", 1), ("null", "one text of some words", "en", "s", 1), (None, "one text of some words", "en", "s", 1)], "doc_id string, text string, lang string, source string, n_chars long")
    kept = simhash.deduplicate(rows).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("None", "."), ("null", "."), ("null", "one text of some words")] and sum(r["doc_id"] is None for r in kept) == 1
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == 4 and sum(r["is_kept"] for r in got) == 3


def test_scripts_without_spaces(spark):
    a = "今日は天気がとても良いので、友達と一緒に公園へ行きました。公園では子供たちが遊んでいて、私たちはベンチに座って話をしました。その後、近くの喫茶店で紅茶を飲みながら、将来の夢について語り合いました。"
    other = "全く別の文章です。これは猫について書かれた短い物語であり、前の文とは関係がありません。猫は毎日屋根の上で眠ります。"
    thai = "ภาษาไทยเป็นภาษาที่เขียนโดยไม่เว้นวรรคระหว่างคำ และมีผู้พูดจำนวนมากในประเทศไทย รวมทั้งในประเทศเพื่อนบ้าน"
    texts = [a, a.replace("紅茶", "珈琲"), other, thai, thai + "ด้วย", "« L’été »… est là", "L été est là"]
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(documents(spark, [(i, t, "xx", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}


def test_long_lists_are_spanned_as_short_ones(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (20, 4), dtype=np.int64).view(np.uint64)
    f = base[rng.integers(0, 20, 2500)] ^ (np.uint64(1) << rng.integers(0, 64, (2500, 4)).astype(np.uint64))
    pairs = simhash.spanning(f)
    assert len({b for _, b in pairs}) == 2500 - 20


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (1, 2)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 141)}


def test_hostile_table(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(DOCUMENTS)
    kept = simhash.deduplicate(documents(spark)).collect()
    assert len(kept) == sum(r["is_kept"] for r in rows) == len(DOCUMENTS) - 2  # the repeated row and one of the long texts
    assert sum(r["is_kept"] for r in rows if r["doc_id"] == 1) == 2
    assert simhash.near_duplicates(documents(spark, [])).count() == 0 == simhash.deduplicate(documents(spark, [])).count()
    few = [(3, None, None, None, None), (3, None, None, None, None)]
    assert simhash.deduplicate(documents(spark, few)).count() == 2


def test_all_alike(spark):
    rows = [(i, "one text that all of them have in common", "en", "s", 1) for i in range(50)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert {(r["group_id"], r["group_size"]) for r in got} == {(0, 50)} and [r["doc_id"] for r in got if r["is_kept"]] == [0]

"""Sketches against the sets they stand for."""

import numpy as np
import pytest
from fixtures import DATA, DOCUMENTS, documents

from resemblage.llm import fingerprints as fp
from resemblage.llm.words import word_hashes


def all_shingles(text):
    return set(fp.shingles(word_hashes([text.encode()])[0]).tolist())


def test_sketches_are_the_least_hashes(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r["sketch"] for r in fp.sketches(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert got == {i: sorted(all_shingles(t))[: fp.K] for i, t in texts.items()}


def test_shingles_are_of_words():
    a, b = all_shingles("One, two three four five six"), all_shingles("one two  three (four) five SIX!")
    assert a == b and len(a) == 2 and len(all_shingles("just three words")) == 1 and not all_shingles(" .!")
    assert all_shingles("a b c d e") != all_shingles("e d c b a")


def test_parts_merge_to_the_whole(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(5)
    want = {}
    for r in docs.collect():
        want.setdefault(r["source"], set()).update(all_shingles(r["text"]))
    parts = fp.sketches(docs).selectExpr("source AS name", "sketch")
    merged = fp.merged(parts)
    got = {r["name"]: r["sketch"] for r in merged.collect()}
    assert got == {s: sorted(h)[: fp.K] for s, h in want.items()}
    assert {r["name"]: r["sketch"] for r in fp.merged(merged.union(merged)).collect()} == got
    counts = {r[0]: r[1] for r in merged.select("name", fp.distinct_count("sketch")).collect()}
    assert all(abs(counts[s] / len(want[s]) - 1) < 5 / np.sqrt(fp.K) for s in counts)
    for r in fp.overlapping(merged).collect():
        a, b = want[r["name"]], want[r["other"]]
        assert abs(r["resemblance"] - len(a & b) / len(a | b)) < 0.2 and abs(r["a_in_b"] - len(a & b) / len(a)) < 0.25 and abs(r["b_in_a"] - len(a & b) / len(b)) < 0.25


@pytest.mark.parametrize("shared, only_a, only_b", [(0, 500, 400), (1000, 0, 0), (2000, 500, 500), (300, 0, 3000), (30, 10, 20), (0, 0, 0), (0, 0, 50)])
def test_estimates(spark, shared, only_a, only_b):
    rng = np.random.default_rng(shared + only_a)
    x = rng.integers(0, 1 << 63, shared + only_a + only_b)
    a, b = x[: shared + only_a], np.concatenate([x[:shared], x[shared + only_a :]])
    row = spark.createDataFrame([(fp.least(a, fp.K).tolist(), fp.least(b, fp.K).tolist())], "sketch_a array<long>, sketch_b array<long>")
    got = fp.compare(row).first()
    assert got["resemblance"] == pytest.approx(shared / max(1, len(x)), abs=0.15)
    assert got["a_in_b"] == pytest.approx(shared / max(1, len(a)), abs=0.25) and got["b_in_a"] == pytest.approx(shared / max(1, len(b)), abs=0.25)


def test_least_with_many_ties():
    x = np.concatenate([np.zeros(5000, np.int64), np.arange(300)])
    assert fp.least(x, 128).tolist() == list(range(128))


def resemblance(a, b, k):
    """The estimate of two sketches, by sets."""
    union = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*union}) / len(union)


def links_by_brute_force(rows, k=fp.K, link=fp.LINK):
    """``rows`` of (doc_id, sketch) -> for each its class, its size, the number of links and the best one, by all pairs."""
    classes = {}
    for i, s in rows:
        if s:
            classes.setdefault(tuple(s), []).append(i)
    last, sets = lambda i: (i is None, i or 0), {s: set(s) for s in classes}
    name = {s: min((i for i in ids if i is not None), default=None) for s, ids in classes.items()}
    near = {s: [(-round(r, 9), last(name[t]), name[t]) for t in classes if t != s and len(sets[s] & sets[t]) >= link * len(s) and (r := resemblance(s, t, k)) >= link] for s in classes}
    out = []
    for i, s in rows:
        s = tuple(s)
        if not s:
            out.append((i, None, None, None, None, None))
            continue
        r, _, other = min(near[s], default=(None, None, None))
        out.append((i, name[s], len(classes[s]), len(near[s]), other, None if r is None else round(-r, 5)))
    return sorted(out, key=str)


def same(got, want):
    """Equal but for the last digit of what was rounded twice."""
    return len(got) == len(want) and all(x[:-1] == y[:-1] and x[-1] == pytest.approx(y[-1], abs=2e-5) for x, y in zip(got, want))


def linked(df):
    return sorted(((r["doc_id"], r["class_id"], r["class_size"], r["n_links"], r["other_id"], None if r["resemblance"] is None else round(r["resemblance"], 5)) for r in df.filter("level = 'links'").collect()), key=str)


def test_links_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], sorted(all_shingles(r["text"]))[: fp.K]) for r in docs.collect()]
    want = links_by_brute_force(rows)
    assert same(linked(fp.fingerprint(docs)), want) and sum(r[3] or 0 for r in want) > 100 and max(r[2] or 0 for r in want) > 5


@pytest.mark.parametrize("block, square, common_rows", [(fp.BLOCK, fp.SQUARE, fp.COMMON_ROWS), (7, 3, 4)])
def test_links_of_near_copies_equal_brute_force(spark, block, square, common_rows):
    """A hot group of near copies, copies, a passage in every document, contained documents, null and repeated ids; over blocks and squares of any size."""
    how = {"block": block, "square": square, "common_rows": common_rows}
    rng = np.random.default_rng(block)
    words = [f"w{i}" for i in range(5000)]
    base, passage, rows = list(rng.choice(words, 90)), list(rng.choice(words, 40)), []
    for i in range(60):  # near copies
        text = list(base)
        for _ in range(int(rng.integers(0, 8))):
            text[int(rng.integers(0, 90))] = str(rng.choice(words))
        rows.append((i, text))
    rows += [(100 + i, list(base)) for i in range(30)]
    for i in range(60):
        own = list(rng.choice(words, int(rng.integers(5, 300))))
        rows.append((200 + i, own[: len(own) // 2] + passage + own[len(own) // 2 :]))
        rows.append((300 + i, own))
    rows += [(7, base[:50]), (None, base[:60]), (None, base[:60]), (5000, base[20:]), (5001, ["alone"]), (5002, [])]
    texts = [(i, " ".join(t)) for i, t in rows]
    sketched = [(i, sorted(all_shingles(t))[: fp.K]) for i, t in texts]
    df = documents(spark, [(i, t, "en", "s", len(t)) for i, t in texts]).repartition(5)
    assert same(linked(fp.fingerprint(df, **how)), links_by_brute_force(sketched))
    assert same(linked(fp.fingerprint(df, k=16, link=0.3, **how)), links_by_brute_force([(i, s[:16]) for i, s in sketched], k=16, link=0.3))


def test_estimates_of_the_best_link(spark):
    words = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(words[:60]), "en", "s", 1), (2, " ".join(words[:50]), "en", "s", 1), (3, " ".join(words[:60]), "en", "s", 1)]
    got = {r["doc_id"]: r for r in fp.fingerprint(documents(spark, rows)).filter("level = 'links'").collect()}
    assert [(got[i]["other_id"], got[i]["resemblance"], got[i]["a_in_b"], got[i]["b_in_a"]) for i in (1, 2, 3)] == [(2, round(46 / 56, 6), round(46 / 56, 6), 1.0), (1, round(46 / 56, 6), 1.0, round(46 / 56, 6)), (2, round(46 / 56, 6), round(46 / 56, 6), 1.0)]


def test_common_hashes_change_nothing(spark):
    """Hashes of a passage in all rows are common; the same links come out as without such a list."""
    rng = np.random.default_rng(1)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, passage + " " + " ".join(f"x{j}" for j in rng.integers(0, 400, int(rng.integers(1, 60)))), "en", "s", 1) for i in range(150)]
    df = documents(spark, rows).coalesce(1)
    assert fp.common_hashes(fp.gathered(df, fp.K, fp.WORDS, fp.COMMON, fp.COMMON_ROWS), 150).count() >= 50
    got = linked(fp.fingerprint(df))
    assert same(got, links_by_brute_force([(r[0], sorted(all_shingles(r[1]))[: fp.K]) for r in rows])) and sum(r[3] for r in got) > 1000
    assert linked(fp.fingerprint(df, common_rows=1 << 40)) == got


def test_pairs_of_sources_that_share_a_hash(spark):
    parts = spark.createDataFrame([("a", [1, 2]), ("b", [3]), ("c", [2, 3])], "name string, sketch array<long>")
    assert {(r["name"], r["other"]): r["b_in_a"] for r in fp.overlapping(parts).collect()} == {("a", "c"): 0.5, ("b", "c"): 0.5}


def test_many_names(spark):
    rows = [(f"n{i % 11}", sorted({i, i * 7 % 50, 99})) for i in range(200)]
    want = {n: sorted({h for m, s in rows if m == n for h in s})[:5] for n, _ in rows}
    parts = spark.createDataFrame(rows, "name string, sketch array<long>").repartition(4)
    assert {r["name"]: r["sketch"] for r in fp.merged(parts, 5, most=3).collect()} == want


def test_hostile_table(spark):
    rows = fp.fingerprint(documents(spark)).collect()
    docs = [r for r in rows if r["level"] == "document"]
    assert len(docs) == len(DOCUMENTS) and sum(r["n_shingles"] == 0 for r in docs) == 5
    assert same(linked(fp.fingerprint(documents(spark))), links_by_brute_force([(r[0], sorted(all_shingles(r[1] or ""))[: fp.K]) for r in DOCUMENTS]))
    assert {r["name"] for r in rows if r["level"] == "source"} == {"a", "b", "hot", "(none)"}
    assert fp.fingerprint(documents(spark, [])).count() == 0
    assert fp.compare(spark.createDataFrame([(None, [1])], "sketch_a array<long>, sketch_b array<long>")).first()["resemblance"] == 0

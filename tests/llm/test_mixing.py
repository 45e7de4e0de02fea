import hashlib
import math
from collections import Counter

import numpy as np
from fixtures import DATA, DOCUMENTS, documents, same_as_sql

from resemblage.llm import mixing


def drawn(rate, key, seed=mixing.SEED):
    """Poisson inversion, term by term."""
    parts = max(1, math.ceil(rate / mixing.PART))
    r, total = rate / parts, 0
    for j in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}:{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        p = c = math.exp(-r)
        k = 0
        while u >= c and k < r + 12 * math.sqrt(r) + 30:
            k += 1
            p *= r / k
            c += p
        total += k
    return total


def test_equals_sql(spark):
    same_as_sql(mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet")), mixing.SQL, documents=f"{DATA}/documents.parquet")


def test_counts_equal_inversion(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    weights = {"src1": 1.0, "src2": 3.0, "src3": 900.0}
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, weights).collect()}
    got = Counter(r["doc_id"] for r in mixing.mix(docs, weights).collect())
    assert got == Counter({r["doc_id"]: n for r in docs.collect() if (n := drawn(rate[r["source"]], r["doc_id"]))})


def test_shares_come_near_their_targets(spark):
    rows = [(i, "x" * 100, "en", f"s{i % 3 if i % 10 else 0}", 100) for i in range(6000)]
    chars = Counter()
    for r in mixing.mix(documents(spark, rows), {"s0": 0.2, "s1": 0.5, "s2": 0.3}).collect():
        chars[r["source"]] += len(r["text"])
    total = sum(chars.values())
    assert abs(total / 600_000 - 1) < 0.05 and all(abs(chars[s] / total - w) < 0.03 for s, w in (("s0", 0.2), ("s1", 0.5), ("s2", 0.3)))


def test_copies_are_shuffled(spark):
    rows = [(i, "some text", "en", "s", 9) for i in range(4000)]
    order = [r["doc_id"] for r in mixing.mix(documents(spark, rows)).collect()]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.1


def test_many_sources_are_joined_alike(spark):
    docs = documents(spark, [(i, "text " * (i % 7), "en", f"s{i % 40}", 5) for i in range(400)])
    want = sorted(map(str, mixing.mix(docs).collect()))
    assert sorted(map(str, mixing.mix(docs, broadcast=0).collect())) == want


def test_hostile_table(spark):
    rows = mixing.mix(documents(spark)).collect()
    times = Counter((r["doc_id"], r["text"]) for r in rows)
    assert {k for k in times} <= {(r[0], r[1]) for r in DOCUMENTS}
    assert mixing.mix(documents(spark, [])).count() == 0 == mixing.mix(documents(spark), {}).count()
    assert mixing.mixed_documents(documents(spark)).columns == ["doc_id", "text", "lang", "source", "n_chars"]

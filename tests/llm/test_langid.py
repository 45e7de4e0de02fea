import math

import numpy as np
import pytest
import xxhash
from fixtures import DOCUMENTS, documents

from resemblage.llm import langid
from resemblage.llm.words import _IN_WORD

TABLE = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    rows = [(r["text"].encode(), r["lang"]) for r in spark.read.parquet(TABLE).orderBy("doc_id").collect()]
    model = langid.fit(rows[:600])
    texts, y = [t for t, _ in rows[600:]], [x for _, x in rows[600:]]
    p, known = model.probabilities(texts)
    right = [model.languages[k] == x for k, x, ok in zip(p.argmax(axis=1), y, known) if ok]
    assert np.mean(right) >= 0.98 and np.allclose(p.sum(axis=1), 1)


def test_clean_documents_stay_and_noise_goes(spark):
    docs = spark.read.parquet(TABLE)
    assert langid.keep_identified(docs).count() >= 0.99 * docs.count()
    model = langid.train(docs)
    noise = [(1, "", None, "s", 0), (2, None, None, "s", 0), (3, "?! ... 12", None, "s", 0)]
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, noise), model).collect()}
    assert got[1]["is_rejected"] and got[2]["is_rejected"] and got[1]["language"] is None and got[2]["confidence"] is None


def test_calibration(spark):
    rows = [(r["text"].encode(), r["lang"]) for r in spark.read.parquet(TABLE).orderBy("doc_id").collect()]
    model = langid.fit(rows[:600])
    short = [b" ".join(t.split()[3:5]) for t, _ in rows[600:] if len(t.split()) > 6]
    y = [x for t, x in rows[600:] if len(t.split()) > 6]
    p, _ = model.probabilities(short)
    right = np.array([model.languages[k] == x for k, x in zip(p.argmax(axis=1), y)])
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.05


def test_features_equal_plain_ones():
    texts = ["Das ist, ein Haus!", "", "a", "é b", "x" * 30]
    h, owner = langid.subwords([t.encode() for t in texts])
    for i, t in enumerate(texts):
        alone, _ = langid.subwords([t.encode()])
        assert sorted(h[owner == i]) == sorted(alone)


def plain_features(text):
    """Buckets of the n-grams of one text, a character at a time."""
    low = [b if _IN_WORD[b] else 32 for b in text.lower().encode()]
    s = [32]
    for b in [*low, 32]:
        if b != 32 or s[-1] != 32:
            s.append(b)
    out = []
    for i in range(len(s) - 1):
        if s[i] == s[i + 1] == 32:
            continue
        out.append(s[i] * 256 + s[i + 1])
        for n, seen in ((3, [1]), (4, [1, 2])):
            if i + n > len(s) + 1 or any(i + k >= len(s) or s[i + k] == 32 for k in seen):
                continue
            g = 0
            for k in range(n):
                g = g * 256 + (s[i + k] if i + k < len(s) else 32)
            out.append((g * 0x9E3779B1 % 2**32) >> 16 if n == 3 else ((g ^ 0x5BD1E995) * 0x85EBCA6B % 2**32) >> 16)
    return sorted(out)


def test_features_and_probabilities_equal_a_plain_forward_pass(spark):
    rows = [(r["text"].encode(), r["lang"]) for r in spark.read.parquet(TABLE).orderBy("doc_id").limit(300).collect()]
    model = langid.fit(rows)
    for text in ["Das ist, ein Haus!", "a", "é b", "x" * 30, "the house (of a friend)", "日本 語", rows[5][0].decode(), "  two  gaps  "]:
        want = plain_features(text)
        assert sorted(langid.subwords([text.encode()])[0].tolist()) == want
        logits = [sum(float(model.table[h, k]) for h in want) / len(want) + float(model.bias[k]) for k in range(len(model.languages))]
        e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
        got, known = model.probabilities([text.encode()])
        assert known[0] and got[0].tolist() == pytest.approx([x / sum(e) for x in e], abs=1e-9)


def test_step_equals_a_plain_one():
    """Every weight by its own sum, and the direction against the loss's difference quotients."""
    rng = np.random.default_rng(1)
    n, d, m = 9, 4, 3
    e, w, bias = (rng.normal(size=x).astype(np.float64) for x in ((n, d), (d, m), (m,)))
    h, share, label, weight, rate = np.array([1, 4, 7]), np.array([0.5, 0.3, 0.2]), 2, 1.5, 0.1

    def loss(e, w, bias):
        z = [sum(share[i] * sum(e[h[i], k] * w[k, c] for k in range(d)) for i in range(3)) + bias[c] for c in range(m)]
        return weight * (math.log(sum(math.exp(x) for x in z)) - z[label])

    def slope(which, at):
        out = []
        for sign in (1, -1):
            moved = [e.copy(), w.copy(), bias.copy()]
            moved[which][at] += sign * 1e-6
            out.append(loss(*moved))
        return (out[0] - out[1]) / 2e-6

    new = [e.copy(), w.copy(), bias.copy()]
    langid.step(*new, h, share, label, weight, rate)
    for k in range(d):
        assert all(new[1][k, c] == pytest.approx(w[k, c] - rate * slope(1, (k, c)), abs=1e-7) for c in range(m))
        assert all(new[0][h[i], k] == pytest.approx(e[h[i], k] - rate * slope(0, (h[i], k)) / float(share @ share), abs=1e-7) for i in range(3))
    assert all(new[2][c] == pytest.approx(bias[c] - rate * 0.1 * slope(2, c), abs=1e-7) for c in range(m))
    assert (np.delete(new[0], h, axis=0) == np.delete(e, h, axis=0)).all()


def test_threshold_equals_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 7, 400):
        for _ in range(20):
            confidence = rng.random(n)
            right = rng.random(n) < confidence
            ok = [t for t in sorted(confidence) if 1 - right[confidence >= t].mean() <= 0.1]
            want = 1.0 if not ok else 0.0 if ok[0] == min(confidence) else ok[0]
            assert langid.threshold(confidence, right, 0.1, 0.999, 0.0) == min(want, max(confidence))
            assert langid.threshold(confidence, right, 0.1, 0.999, 0.7) == min(max(want, 0.7), max(confidence))
            assert (confidence < langid.threshold(confidence, right, 0.0, 0.05)).sum() <= 0.05 * n
    assert langid.threshold(np.array([0.3] + [0.9] * 39), np.ones(40, bool)) == langid.SURE


def test_copies_are_held_out_together(spark):
    rows = [(f"text number {i} of many words".encode(), "en") for i in range(40)] * 5
    held = [xxhash.xxh3_64_intdigest(t, langid.SEED) % 1000 < 1000 * langid.HELD_OUT for t, _ in rows]
    assert {t for (t, _), h in zip(rows, held) if h}.isdisjoint({t for (t, _), h in zip(rows, held) if not h}) and any(held)
    assert langid.fit(rows).languages == ["en"] and langid.fit([(b"one text", "en")] * 50) is not None


def test_other_scripts_are_rejected(spark):
    model = langid.train(spark.read.parquet(TABLE))
    texts = ["今日は天気がとても良いので、友達と一緒に公園へ行きました。", "Сегодня хорошая погода, и мы пошли гулять в парк.", "η γλώσσα αυτή δεν είναι γνωστή", "zqx wvk qqj xzv kkq jjw vvx"]
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, [(i, t, None, "s", 1) for i, t in enumerate(texts)]), model).collect()}
    assert all(got[i]["is_rejected"] for i in range(3)) and all(0 <= r["confidence"] <= 1 for r in got.values())


def test_hostile_table(spark):
    rows = langid.identify(documents(spark)).collect()
    assert len(rows) == len(DOCUMENTS) and all(r["is_rejected"] for r in rows if r["language"] is None)
    assert langid.identify(documents(spark, [])).count() == 0
    unlabelled = [(1, "some text", None, None, None)]
    got = langid.identify(documents(spark, unlabelled)).first()
    assert got["language"] is None and not got["is_rejected"]
    assert langid.keep_identified(documents(spark, unlabelled)).count() == 1
    assert langid.keep_identified(documents(spark)).columns == ["doc_id", "text", "lang", "source", "n_chars"]

"""The pipeline, stage by stage against brute force, and the registered queries."""

import base64
import math
from collections import Counter

import pytest
import tiktoken
from fixtures import DATA, documents, same_as_sql
from test_langid import plain_features
from test_mixing import drawn
from test_pii import EMAIL, plain as plain_pii
from test_simhash import groups_by_brute_force

import __spark_entry__ as entry
import corpus_pipeline
from resemblage.llm import bpe, langid, mixing, queries, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_language(model, text):
    """(language, confidence) by plain sums."""
    grams = plain_features(text)
    if not grams:
        return None, 0.0
    z = [(sum(float(model.table[h, k]) for h in grams) / len(grams) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
    e = [math.exp(x - max(z)) for x in z]
    return model.languages[e.index(max(e))], max(e) / sum(e)


def plain_redaction(text):
    """By regular expressions; of overlapping finds the earlier, then the longer."""
    found = plain_pii(text) | {(m.start(), m.end(), "email") for m in EMAIL.finditer(text)}
    out, at = "", 0
    for a, b, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
            at = b
    return out + text[at:]


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage against plain code over its predecessor's rows: sums, all pairs, regular expressions, term by term inversion and another encoder."""
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, seen = source, [source.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == COLUMNS
        seen.append(docs.collect())
    before, first, second, third, fourth, last = seen

    model = langid.train(source)
    want = {}
    for r in before:
        language, confidence = plain_language(model, r["text"])
        if language and confidence >= model.threshold:
            want[r["doc_id"]] = (r["text"], language, r["source"], r["n_chars"])
    assert {r["doc_id"]: tuple(r)[1:] for r in first} == want and len(first) <= len(before)

    rows = sorted(first, key=lambda r: r["doc_id"])
    prints, known = simhash.fingerprint_all([r["text"].encode() for r in rows])
    root = groups_by_brute_force(prints)
    assert sorted(map(tuple, second)) == [tuple(r) for i, r in enumerate(rows) if root[i] == i or not known[i]] and len(second) < len(first)

    redacted = {r["doc_id"]: plain_redaction(r["text"]) for r in second}
    assert {r["doc_id"]: r["text"] for r in third} == redacted and len(third) == len(second)
    assert all(r["n_chars"] == len(r["text"]) for r in third if "[" in r["text"]) and any("[EMAIL]" in t for t in redacted.values())

    size = Counter()
    for r in third:
        size[r["source"]] += len(r["text"])
    weight = {s: n**mixing.POWER for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / size[s] for s in size}
    copies = Counter({r["doc_id"]: drawn(rate[r["source"]], r["doc_id"]) for r in third})
    assert Counter(r["doc_id"] for r in fourth) == +copies and {tuple(r) for r in fourth} <= {tuple(r) for r in third}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {r["doc_id"]: other.encode_ordinary(r["text"]) for r in fourth}
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in fourth)
    assert all(r["token_ids"] == ids[r["doc_id"]] and r["n_tokens"] == len(ids[r["doc_id"]]) and r["is_exact"] for r in last)


def test_run(spark):
    assert entry.queries()["pipeline"](spark, DATA).count() > 0


def test_hostile_documents_pass_through(spark, tmp_path):
    docs = documents(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0


def test_no_documents(spark, tmp_path):
    docs = documents(spark, [])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0


def test_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    if name in queries.ORACLES:
        same_as_sql(got, queries.ORACLES[name], **{t: f"{DATA}/{t}.parquet" for t in ("documents", "pages", "conversations")})
    else:
        assert got.count() > 0

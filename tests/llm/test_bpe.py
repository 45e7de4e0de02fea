"""BPE against another implementation over the same vocabularies, and exact round trips."""

import base64

import pytest
import tiktoken
from fixtures import DATA, DOCUMENTS, documents
from hypothesis import given, settings, strategies as st

from resemblage.llm import bpe

PATHS = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]


@pytest.fixture(scope="module", params=PATHS)
def both(request):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(request.param, "rb"))}
    return bpe.Encoder(bpe.read_vocabulary(request.param)), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_merging(both, spark):
    own, other = both
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [r[1] for r in DOCUMENTS if r[1]]
    texts += ["", " ", "  a  b ", "a\n\n b\t c", "don't 'll x's", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "<|endoftext|>", "\r\n\r\n", "éééé" * 50, "1234567890" * 20, "!?!?" * 40]
    for t in texts:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t) and own.decode(ids) == t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" abcinth\n'e")), max_size=60))
def test_equals_merging_on_any_text(both, text):
    own, other = both
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text) and own.decode(ids) == text


def test_table(spark):
    docs = documents(spark)
    rows = bpe.encode(docs).collect()
    assert len(rows) == len(DOCUMENTS)
    for r in rows:
        assert (r["token_ids"] is None) == (r["n_tokens"] is None) == (r["is_exact"] is None)
        assert r["is_exact"] in (True, None) and (r["n_tokens"] is None or r["n_tokens"] == len(r["token_ids"]))
    back = bpe.decode(bpe.encode(docs))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(map(str, ((r[0], r[1]) for r in DOCUMENTS)))
    assert bpe.encode(documents(spark, [])).count() == 0


def test_ids_outside_the_vocabulary_stand_for_nothing(spark):
    df = spark.createDataFrame([(1, [64, None, 10**6, -1]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()} == {1: bpe.read_vocabulary()[64].decode(), 2: None, 3: ""}

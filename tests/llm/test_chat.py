import json

import pytest
from fixtures import DATA, same_as_sql

from resemblage.llm import bpe, chat

PARTS = [{"type": "text", "text": "see "}, {"type": "image", "url": "i.png", "width": 57, "height": 28}, {"type": "audio", "url": "a.wav", "seconds": 1.01}, {"type": "text", "text": " and <|user|>"}, {"type": "document", "url": "d.pdf", "pages": 3}]
ROWS = [
    (1, 1, "assistant", "Fine, thanks!"), (1, 0, "user", "Hi"), (1, 2, "user", json.dumps(PARTS)), (1, 3, "user", '[{"type": "image"}]'), (2, 0, None, None), (2, 0, "user", ""), (2, None, "user", "last"), (None, 0, "user", "nobody's"), (None, 0, "user", "nobody's"),
    (3, 0, "user", "[1, 2]"), (3, 1, "user", '[{"type": "video"}]'), (3, 2, "user", "[not json"), (3, 3, "us|er", "[]"), (4, 0, "user", "long " * 60_000),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "no", "no", "no") for r in rows], "conv_id long, turn long, role string, text string, TEXT string, m string, part string")


@pytest.fixture(scope="module")
def chats(spark):
    return {r["conv_id"]: r for r in chat.format_chats(frame(spark)).collect()}


def test_parts_become_placeholders(chats):
    c = chats[1]
    assert c["text"] == "<|user|>\nHi<|end|>\n<|assistant|>\nFine, thanks!<|end|>\n<|user|>\nsee <|image_1|><|audio_2|> and &lt;|user|><|document_3|><|end|>\n<|user|>\n<|image_4|><|end|>\n"
    assert [tuple(a) for a in c["attachments"]] == [(1, "image", "i.png", 3), (2, "audio", "a.wav", 26), (3, "document", "d.pdf", 1728), (4, "image", "", 144)]
    assert c["n_messages"] == 4 and c["attachment_tokens"] == 3 + 26 + 1728 + 144 and c["text_tokens"] == 1 + 4 + 1 + 6 and c["n_tokens"] == c["attachment_tokens"] + c["text_tokens"] + 8


def test_odd_messages(chats):
    assert chats[2]["text"] == "<|unknown|>\n<|end|>\n<|user|>\n<|end|>\n<|user|>\nlast<|end|>\n"
    assert chats[None]["n_messages"] == 2 and chats[None]["attachments"] == []
    assert chats[3]["text"] == '<|user|>\n[1, 2]<|end|>\n<|user|>\n[{"type": "video"}]<|end|>\n<|user|>\n[not json<|end|>\n<|user|>\n[]<|end|>\n'
    assert chats[4]["text_tokens"] == 60_000


def test_equals_sql(spark):
    own = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    same_as_sql(chat.as_text(chat.format_chats(own)), chat.SQL, conversations=own.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    same_as_sql(chat.as_text(chat.format_chats(spark.read.parquet(f"{DATA}/conversations.parquet"))), chat.SQL, conversations=f"{DATA}/conversations.parquet")


def test_typed_parts_equal_sql(spark):
    got = chat.as_text(chat.format_chats(chat.typed(spark.read.parquet(f"{DATA}/conversations.parquet"))))
    assert got.filter("attachment_tokens > 0").count() > 0.5 * got.count()
    same_as_sql(got, chat.TYPED_SQL, conversations=f"{DATA}/conversations.parquet")


def test_tokens_of_a_vocabulary(spark):
    encoder = bpe.Encoder(bpe.read_vocabulary())
    got = {r["conv_id"]: r for r in chat.format_chats(frame(spark), bpe.token_count(spark)).collect()}
    assert got[1]["text_tokens"] == sum(len(encoder.encode(t)) for t in ("Hi", "Fine, thanks!", "see ", " and <|user|>"))
    assert got[4]["text_tokens"] == len(encoder.encode("long " * 60_000)) and got[2]["text_tokens"] == 1 and got[1]["attachment_tokens"] == 3 + 26 + 1728 + 144


def test_empty(spark):
    assert chat.format_chats(frame(spark, [])).count() == 0

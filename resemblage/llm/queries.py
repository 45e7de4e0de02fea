"""One query for each operator, over the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, fingerprints, langid, mixing, pii, simhash, urls, wrappers
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether they decode to the same bytes."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by a model trained on a sample of them."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their sources, the class and the links of each document, and how the sources overlap."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors, for every vector whose id is divisible by 20."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the URL filter finds in the address of every page."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of every page, without what its host's pages share."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text."""
    return chat.as_text(chat.format_chats(table(spark, sf_dir, "conversations")))


def typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text, its messages made of typed parts of all kinds."""
    return chat.as_text(chat.format_chats(chat.typed(table(spark, sf_dir, "conversations"))))


def bpe_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of typed parts with the tokens of the vocabulary counted."""
    messages = table(spark, sf_dir, "conversations")
    return chat.as_text(chat.format_chats(chat.typed(messages), bpe.token_count(spark)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated to their sources' weights and shuffled."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    return pii.redacted(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_langid, op4_fingerprints, op5_neighbours, op6_urls, op7_html, op8_chat, op9_mixing, op10_pii, typed_chat, bpe_chat)}
ORACLES: dict[str, str] = {"op6_urls": urls.SQL, "op8_chat": chat.SQL, "typed_chat": chat.TYPED_SQL, "op9_mixing": mixing.SQL}

"""A training corpus from the documents: the stages, and running them one after another.

Every stage takes and gives whole rows, whatever is in them: nulls in any column, empty and very long texts, repeated rows and
empty tables pass as each stage's docstring says, and further columns, also of clashing names, are left out by the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from resemblage.llm import bpe, langid, mixing, pii, simhash
from resemblage.llm.common import shared_folder, table
from resemblage.session import forget, ship


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; ``lang`` is that language.

    Null, empty and wordless texts have no language and go, if any row is labelled at all; a null ``doc_id``, ``source`` or ``n_chars`` stays
    null; rows that repeat are kept or go alike; of no documents none are left.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least ``doc_id``, nulls last, then of the least hash of its text.

    Of rows that repeat each other in id and text one stays; texts without words are no duplicates of anything; of no documents none are left.
    """
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for personal data. A null text stays null, an empty one empty, repeated rows repeat; ``n_chars`` follows where a text changed."""
    return pii.redacted_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents, so many that the sources have their target weights, in shuffled order.

    A null source is a source of its own; rows that share an id, null too, come equally often; a source without any character gives nothing, and
    neither do no documents.
    """
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each copy of a document: nulls for a null text, none for an empty one, a row for each row."""
    return bpe.encode(docs)


STAGES = [
    ("language ID", identify_languages),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("BPE", encode_tokens),
]

#: SQL can't express the stages but one; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table ``documents``.

    What a stage gives is written as Parquet into the folder that all executors
    share, and read again as the next one's documents; it goes once the next one is written, and the last when the driver ends. Without documents, or if a stage keeps none, there are no rows.
    """
    ship(spark)
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{place}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            forget(spark, f"{place}/{k - 1}", now=True)
    forget(spark, place)
    return docs

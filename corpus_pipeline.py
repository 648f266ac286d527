"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Every stage takes empty tables, null ids and texts, repeated rows and extra columns; all but
the last return the columns they were given, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchment.llm.common import documents, shared_table
from parchment.llm.exact_dedup import drop_copies
from parchment.llm.jaccard import drop_near_copies
from parchment.llm.language_id import reject_unknown
from parchment.llm.packing import pack
from parchment.llm.secrets import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go, null, empty and letterless texts among them; all others stay as they are."""
    return reject_unknown(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest id stays; rows that share an id share its fate."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays; texts without words link with nothing and stay."""
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mask and n_chars follows; no document goes, and null or clean texts stay as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, repeats included, and their places in sequences; a null or empty text is one id."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# Learned languages and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

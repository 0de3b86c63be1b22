"""From raw documents to training shards, in five stages.

Documents that the quality classifier rejects go; of each near-duplicate class
one stays; contaminated documents go; sources, languages and topics are mixed
to their target weights; what remains is assigned to shards.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and further columns (found by exact name, so clashing names do no harm), and
gives no rows for an empty table; all but the last return ``COLUMNS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnscope.llm import decontamination, mixing, near_duplicates, quality, sharding
from churnscope.llm.shared import read, written

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts (all of them where the
    labels teach nothing); null and empty texts are judged as empty ones."""
    return quality.good(docs, read(spark, sf_dir, "labels"), COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate class, its first by id (null last) and
    text hash; texts without words are alike only if equal."""
    return near_duplicates.first_of_each(docs, COLUMNS)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated, told apart by id and text hash."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"), COLUMNS)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents kept by their cell's raked probability; a document without
    words costs no budget and stays."""
    return mixing.sample(docs, COLUMNS)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("sharding", sharded_documents),
]

#: The trained and sampled stages have no SQL form; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

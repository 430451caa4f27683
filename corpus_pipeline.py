"""A corpus pipeline of the operators in pairloom.llm; each stage is written and read again by run().

Order: quality classifier, line dedup, SimHash near-dedup, personal data, packing. Every stage works on
all rows that the stage before it kept, and all but the last return the columns of documents. Nulls,
empty texts, repeated rows and empty tables are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import lines, packing, pii, quality, queries, simhash
from pairloom.llm.common import staged, table


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.7) go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that keep nothing but blank lines without them."""
    return lines.without_copies(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: 2 bits or five-word Jaccard 0.8."""
    return simhash.one_of_each(docs)


def hide_people(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return pii.pseudonymise(docs, pii.key_of(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-two-fit packing of what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", accept),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", one_of_each),
    ("PII", hide_people),
    ("best-fit packing", pack),
]
#: Training, links and packing are not SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

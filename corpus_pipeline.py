"""From raw documents to packed training sequences, in five stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before. All but the last return the columns
of documents; the last returns pieces of documents in sequences. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearspan.llm import mixing, packing, secrets, simhash, toxicity
from nearspan.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go, labelled or not. Null and empty texts stay; repeated rows share their fate."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays. Null and empty texts are one group; rows without an id stay."""
    table(spark, sf_dir, "documents")  # also sends the package to the workers
    return simhash.simhash_dedup(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become [SECRET]; every document stays, null and repeated ones as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, repeating, and share 150 % of all words; a document is there as often as it is taken.

    A null source is a source, the last; null ids draw one key.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in as few sequences as can be; a null text is an empty one, and each repeat of a row is packed."""
    table(spark, sf_dir, "documents")
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("source_mixing", mix_sources), ("packing", pack_sequences),
]

#: The models and the tokenizer of the first and last stages have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, cutting lineage between them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

"""A corpus pipeline over documents: STAGES in order, each written and read again before the next.

Every stage takes all that the one before it kept. Null and empty texts, null ids, repeated rows and further columns, whatever
their names, pass through the filtering stages like other rows; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import dartminhash, mixing, packing, pii, quality, storage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from labels, does not reject; an empty text is scored like any other, and
    all stay if there are no labels."""
    return quality.keep_good(docs, storage.read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the least doc_id's, null last; texts without words are one class."""
    return dartminhash.keep_one(docs)


def remove_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by [KIND]; none goes, null texts stay null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; reruns agree, also on ties and repeated rows."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences; a null or empty text is one piece."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near-dedup", drop_near_copies),
    ("pii", remove_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens and signatures can't be expressed in SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made = storage.staged(made, f"stage-{name}")
        storage.discard(docs)  # the first stage's input is nobody's to delete, and stays
        docs = made

"""A corpus of documents made ready for training, in four stages.

Toxic documents go, one document of each group of near duplicates stays, personal data are
masked, and what is left is packed into sequences of tokens.  Every stage works on all
that the one before it kept; each result is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyread.llm import jaccard_join, packing, pii, toxicity
from tallyread.llm.common import settled, table
from tallyread.llm.queries import VOCABULARY


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    network = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, network)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest doc_id."""
    return jaccard_join.one_of_each_class(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their personal data replaced by the names of their kinds."""
    return pii.mask_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL cannot express the stages; the tests hold near duplicates and packing against brute force,
#: the other two against their operators' own functions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(stage)(spark, docs, sf_dir)
    return docs

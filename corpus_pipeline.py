"""A training-data pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and all
but the last return the columns of docs. Labels are learned from the rows of docs that the
``labels`` table names.

Defined cases: a null text counts as empty (and fails the base quality rules); of rows of
one near-duplicate group the one with the smallest doc_id stays, of equal ids the first in the order of the
other columns; rows with a null doc_id stay only in groups without other ids; an empty
table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from korpuscle.llm import packing, rules, simhash, toxicity
from korpuscle.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, labels)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    labels = table(spark, sf_dir, "labels")
    return rules.keep_good(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 1024, placed in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, keep_ids=False).drop("ids")


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Learned models and connected components are beyond SQL; tests hold run() against its stages and, given the
#: learned models, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

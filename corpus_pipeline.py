"""A training corpus from raw documents: drop toxic ones, drop poor ones, drop near copies, mask personal data, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vicinage.llm import neardup, packing, pii, quality, toxicity
from vicinage.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. A null or empty text is scored as one without words, rows that
    repeat are scored alike, rows without an id as any other; columns stay as they are; no rows give no rows."""
    return toxicity.clean_documents(spark, docs, table(spark, sf_dir, "labels"), threshold=0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more. A null or empty text has the statistics of nothing, rows that
    repeat are scored alike, rows without an id as any other; columns stay as they are; no rows give no rows."""
    return quality.good_documents(spark, docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: the document of smallest id stays of each group. Null, empty and blank texts
    are no copies of anything; rows without an id stay; of rows that repeat an id with a like text one stays."""
    return neardup.one_of_each(spark, docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind in brackets, n_chars set anew. Null and empty texts, rows
    without an id, repeated rows and all other columns stay as they are; no rows give no rows."""
    return pii.redact(docs, Scratch(spark, "pii").save)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens. A null or empty text is the end token
    alone; rows that repeat are packed one by one; no rows give no rows."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


#: All but the last return the columns of documents.
STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_copies), ("personal_data", mask_personal_data), ("packing", pack)]

#: Trained classifiers can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's result written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

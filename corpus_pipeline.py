"""A corpus cleaned and packed: toxic documents go, then those in no identifiable language, then near duplicates; personal
data become surrogates; what is left is packed into training windows.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of docs, whatever their names. Between stages
the rows are written as Parquet and read again; a stage's table goes when the next one is written. Empty tables go
through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import langid, neardup, packing, pii, toxicity
from lodestar.llm.common import discard, stored, table
from lodestar.llm.queries import WORD_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic. Null or empty text: stays. Repeated rows and ids: each by its own text."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows like the texts of a learned language. Null text, or no letter: goes. Repeated rows and ids: each by its own
    text."""
    return langid.accepted(docs, langid.train(docs), 0.0)  # by likeness to the sample; the score is high for unknown texts too


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the least doc_id, then the least hash of the row. Texts without a word and null ids: all
    stay. Rows of one id with other texts: each by its own text."""
    return neardup.one_of_each(docs, words=5, percent=80)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, texts with surrogates. Null text: stays null."""
    return pii.with_surrogates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece. Null text: one piece with the end id. Null ids and repeated rows: each is packed."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("toxicity", drop_toxic), ("language", identify_language), ("near_duplicates", drop_near_duplicates), ("personal_data", replace_personal_data), ("packing", pack)]

#: No SQL for trained models and tokenizers: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

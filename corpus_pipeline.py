"""A training corpus in five stages: language ID, near-dedup, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again for the next.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosewright.llm.common import Scratch, table
from prosewright.llm.langid import in_known_language, learn_from
from prosewright.llm.mixing import mixed_documents
from prosewright.llm.neardup import without_near_duplicates
from prosewright.llm.packing import pack
from prosewright.llm.repeats import without_repeats

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null ones too) and texts long enough to judge that hardly any learned language's n-grams cover."""
    return in_known_language(docs, learn_from(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Rows without a doc_id stay; of rows that repeat doc_id and text one stays.
    """
    return without_near_duplicates(docs, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes from each text what is covered by 100-byte strings that start earlier in the corpus.

    Null texts stay null, empty ones and those under 100 bytes as they are; rows equal in doc_id and text lose the same; an
    empty table gives no rows.
    """
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come to their targets, in training order.

    Null sources are one source; null and empty texts are taken once; an empty table gives no rows.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 1,024.  Null text is the empty text, which has only the end id; an empty table gives no rows."""
    return pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the learned language filter nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table is deleted when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages, each on all rows that its predecessor kept.

All stages but the last return the columns of ``documents``, extra ones included, whatever their names. Null and empty texts and
rows without an id pass through them: nothing toxic, personal or leaked is in them, they link with nothing, and they are packed as
one piece of the end id each. Texts of any length are read whole. Repeated rows are near duplicates of each other, so one stays.
Ties don't arise but in packing, where equal lengths may stand in any order. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from needlework.llm.common import drop_staged, stage_table, staged_so_far, table
from needlework.llm.decontaminate import drop_leaks
from needlework.llm.jaccard import keep_one
from needlework.llm.packing import CAPACITY, pack
from needlework.llm.pii import pii_redact
from needlework.llm.tokens import vocabulary_path
from needlework.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go; without labels none does."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more, the row of the smallest id stays."""
    return keep_one(docs, n=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, re-parameterised ones too; without items none does."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind, and n_chars follows; all rows stay."""
    return pii_redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(docs, vocabulary_path("word_bpe_49k.json"), CAPACITY, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Learnt scores, similarity components and token ids are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written as Parquet to the shared folder and read again.

    What a stage staged on its way, and the stage before it, is deleted once the stage is written.
    """
    docs, began = table(spark, sf_dir, "documents"), staged_so_far()
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        drop_staged(spark, began, but_last=True)
    return docs

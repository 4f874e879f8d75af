"""Top-k documents for a substring: most frequent first, then longer documents, then smaller ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.sources.shared import small_side

from .occurrence import tf_batch, tf_per_document


def ranking() -> list:
    return [F.desc("tf"), F.desc("doc_length"), F.asc("doc_id")]


def topk_documents(corpus: DataFrame, pattern: str, k: int) -> DataFrame:
    """(doc_id, tf, doc_length) of at most k documents, in order: a heap of k in each task, then one of k."""
    if k < 1:
        raise ValueError("k is at least 1")
    return tf_per_document(corpus, pattern).orderBy(*ranking()).limit(k)


def rank_within(frequencies: DataFrame, keys: list[str], k_max: int) -> DataFrame:
    """``frequencies`` with rank up to the literal bound ``k_max``, which lets tasks drop the rest before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*ranking())
    return frequencies.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k_max)


def topk_batch(corpus: DataFrame, patterns: DataFrame, k_max: int) -> DataFrame:
    """(pattern_id, rank, doc_id, tf, doc_length) for a table of (pattern_id, pattern, k); k above ``k_max`` is refused."""
    if patterns.where(F.col("k") > k_max).limit(1).count():
        raise ValueError("a pattern asks for more than k_max documents")
    found = rank_within(tf_batch(corpus, patterns), ["pattern_id"], k_max)
    return first_k(found, patterns)


def first_k(ranked: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, rank, doc_id, tf, doc_length) up to each pattern's own k."""
    wanted = small_side(patterns.select("pattern_id", "k"))
    return ranked.join(wanted, "pattern_id").where("rank <= k").select("pattern_id", "rank", "doc_id", "tf", "doc_length")

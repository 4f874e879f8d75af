"""Documents that arrive as a stream: frequencies of watched patterns are kept up to date, batch by batch.

An extension: collections of this kind are built once. A document's frequency never changes once it is there, so appending
is exact: every micro-batch writes the frequencies of its own documents under its batch id, and rankings are taken over all
of them. A batch that is run again overwrites its own folder, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from needlework.operators.occurrence import tf_batch
from needlework.operators.topk import first_k, rank_within
from needlework.sources.collections import corpus

FREQUENCIES = "pattern_id long, doc_id long, doc_length long, tf long, batch long"


def watch(stream: DataFrame, patterns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that files the frequencies of ``patterns`` (pattern_id, pattern) in each new document under ``path``."""

    def file(batch: DataFrame, batch_id: int) -> None:
        tf_batch(corpus(batch), patterns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(file).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(spark: SparkSession, patterns: DataFrame, path: str, k_max: int) -> DataFrame:
    """The ranking over all that has arrived: (pattern_id, rank, doc_id, tf, doc_length)."""
    found = spark.read.schema(FREQUENCIES).parquet(path).drop("batch")
    return first_k(rank_within(found, ["pattern_id"], k_max), patterns)

"""Timed workloads over an index, as the measuring harness of such engines runs them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.operators.ingest import sample_patterns
from needlework.operators.topk import topk_batch, topk_documents


@dataclass(frozen=True)
class Timing:
    m: float
    k: int
    queries: int
    mean_us: float


def k_schedule(n_docs: int) -> list[int]:
    """The values of k that tests go through: 20 to 100 by 20, or 1 to 10 (half the documents) in small collections."""
    return list(range(20, 101, 20)) if n_docs >= 100 else list(range(1, max(2, min(10, n_docs // 2) + 1)))


def run_patterns(corpus: DataFrame, patterns: list[str], k: int, batch: bool = True) -> Timing:
    """Mean microseconds a pattern, in one batch or one by one."""
    spark = corpus.sparkSession
    began = time.perf_counter()
    if batch:
        table = spark.createDataFrame([(i, p, k) for i, p in enumerate(patterns)], "pattern_id long, pattern string, k int")
        topk_batch(corpus, table, k).write.format("noop").mode("overwrite").save()
    else:
        for p in patterns:
            topk_documents(corpus, p, k).write.format("noop").mode("overwrite").save()
    spent = (time.perf_counter() - began) * 1e6
    return Timing(sum(map(len, patterns)) / max(1, len(patterns)), k, len(patterns), spent / max(1, len(patterns)))


def experiments(corpus: DataFrame, queries: int, n_docs: int, lengths: tuple[int, ...] = (6, 10), seed: int = 1) -> list[Timing]:
    """Random patterns of 6 and 10 characters at k = 10, and at k = 100 if there are more than 100 documents."""
    out = []
    for m in lengths:
        drawn = [r.pattern for r in sample_patterns(corpus, m, queries, seed).collect()]  # a workload of n patterns
        for k in (10, 100) if n_docs > 100 else (10,):
            out.append(run_patterns(corpus, drawn, k))
    return out


def append_results(timings: list[Timing], g: int, bits: float, corpus: DataFrame, path: str) -> None:
    """Add a line ``m k g bits microseconds`` for each timing to a folder of text results."""
    rows = corpus.sparkSession.createDataFrame([(float(t.m), t.k, g, bits, t.mean_us) for t in timings], "m double, k int, g int, bpc double, us double")
    rows.coalesce(1).write.mode("append").option("sep", " ").csv(path)


def hit_rate(patterns: DataFrame, lists: DataFrame) -> float:
    from needlework.operators.lists import answerable

    return answerable(patterns, lists).agg(F.avg(F.col("hit").cast("double"))).first()[0] or 0.0

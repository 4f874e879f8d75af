"""Connected components of a distributed link table by alternating large-star and small-star steps.

Links stay in tables of the shared folder; each step is an aggregation with map-side minima and a join. The minima of nodes with
very many links, which are few, are sent to all tasks, so the links of a hub stay where they are and are no unbounded group. The
steps turn every component into a star around its smallest node in a few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_classes, stage_table


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that isn't the smallest of its component; root is the smallest.

    Null ends and loops are ignored; repeated links count once; an empty table gives an empty result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    edges = stage_table(edges, "links")
    before = _signature(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large star: a node's larger neighbours are tied to the smallest among it and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_classes(both.where("v > u"), stage_table(least, "minima"), ["u"], "n", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage_table(large, "large_star")
        # small star: a node's smaller neighbours and itself are tied to the smallest of them
        least = stage_table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "minima")
        small = join_classes(large, least, ["u"], "n", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage_table(small, "small_star")
        after = _signature(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    if before[0]:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

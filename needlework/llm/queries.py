"""The registered queries of the corpus operators: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import held_out, table
from .decontaminate import benchmark_leaks
from .jaccard import jaccard_components
from .licenses import corpus_negatives, fit_licenses, license_scan
from .packing import CAPACITY, pack
from .pii import pii_report
from .quality import fit_quality, quality_scores
from .rollup import TokenLedger, count_tokens, surplus_copies
from .sharding import shard
from .tokens import vocabulary_path
from .toxicity import fit_toxicity, toxicity_scores


def _predicted(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _predicted(toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))), 0.5)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), CAPACITY, end_id=1)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan(docs, fit_licenses(corpus_negatives(docs, 1_000)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizer versions; texts with runs of line ends are revised to single ones, then surplus copies are
    taken back; all batches are committed twice, and the ledger is compacted."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    versions = {name: (vocabulary_path(f"{name}.tiktoken"), public_tokenizers.PATTERN) for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    ledger, counts, copies = TokenLedger(spark), count_tokens(docs, versions), surplus_copies(docs)
    revised = docs.where(F.col("doc_id").isNotNull() & F.contains("text", F.lit("\n\n"))).withColumn("text", F.regexp_replace("text", r"\n{2,}", "\n"))
    for _ in range(2):  # the second round finds all ids committed and changes nothing
        ledger.insert("all", counts)
        ledger.revise("line-ends", count_tokens(revised, versions))
        ledger.delete("copies", copies)
    ledger.compact()
    return ledger.totals()


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _predicted(quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels"))), 0.3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sharding": op2_sharding,
        "op3_decontamination": op3_decontamination,
        "op4_packing": op4_packing,
        "op5_pii": op5_pii,
        "op6_ann": op6_ann,
        "op7_licenses": op7_licenses,
        "op8_token_counts": op8_token_counts,
        "op9_jaccard": op9_jaccard,
        "op10_quality": op10_quality,
        "pipeline": pipeline,
    }


#: Links of all pairs that share a shingle, and what they reach: fine on small tables.
_JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 90 * (m + n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id))::BIGINT AS component_id FROM s LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) ON x = doc_id
"""


def oracle_sql() -> dict[str, str]:
    """Only the join is expressible: the others learn, search approximately, or need token ids, offsets or hashes that SQL lacks."""
    return {"op9_jaccard": _JACCARD_SQL}

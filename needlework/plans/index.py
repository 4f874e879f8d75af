"""The index as tables: build, save, load, and answer patterns from it.

Beside the stored lists an index holds its documents in blocks and, for every substring of ``POSTED`` characters, the blocks
that have it. A pattern that no list answers is searched for only in the blocks that hold all its substrings, so a rare
pattern reads a few blocks of a large collection; only shorter patterns read all of them.

An index can be built part by part: what answers from lists needs ``topk_lists``, what searches needs ``corpus`` and ``postings``.
``phrases`` are needed for lists of phrase strings; elsewhere they answer nothing, and an index without them parses its corpus if asked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.functions import codes
from needlework.functions.text import check_pattern, grams, occurrences
from needlework.operators import ingest, lists, phrases
from needlework.operators.topk import ranking
from needlework.sources.collections import shuffle_partitions
from needlework.sources.shared import shared_folder, small_side

PARTS = ("corpus", "postings", "phrases", "topk_lists", "meta")

#: Characters of a posted substring.
POSTED = 3
#: Bytes of text in a block, about.
BLOCK_BYTES = 64 << 20


@dataclass
class TopkIndex:
    corpus: DataFrame | None  # doc_id, text, doc_length; a partition a block
    postings: DataFrame | None  # gram, block; sorted by gram
    phrases: DataFrame | None
    topk_lists: DataFrame | None
    meta: DataFrame

    @classmethod
    def build(
        cls, corpus: DataFrame, path: str | None = None, g: int = 32, gram: int | None = 4, scope: str = "document", block_bytes: int = BLOCK_BYTES, parts: Iterable[str] = PARTS
    ) -> TopkIndex:
        """Write the tables of a corpus below ``path`` (a new shared folder, if not given) and load them.

        Lists are kept for frequent substrings of ``gram`` characters, or for frequent phrase strings if it is None. ``parts`` can be
        fewer where others are below ``path`` already or aren't needed; postings are those of the corpus there, lists of phrase
        strings take it and the phrases there.
        """
        if g < 1:
            raise ValueError("g is at least 1")
        spark = corpus.sparkSession
        path = path or shared_folder(spark, "index")
        stats = ingest.corpus_stats(corpus)
        size = stats.first()
        blocks = max(1, -(-size.n // block_bytes))
        if "corpus" in parts:
            _blocked(corpus, blocks, block_bytes).write.mode("overwrite").partitionBy("block").parquet(f"{path}/corpus")
        if "postings" in parts:
            posted = _posted(_corpus(spark, path)).distinct()
            posted.repartitionByRange(shuffle_partitions(posted), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/postings")
        if "phrases" in parts:
            phrases.lz78_phrases(_corpus(spark, path), scope).write.mode("overwrite").parquet(f"{path}/phrases")
        if "topk_lists" in parts:
            if gram is None:
                known = spark.read.schema(phrases.PHRASES).parquet(f"{path}/phrases")
                stored = lists.build_phrase_lists(_corpus(spark, path), known, g, size.n_docs)
            else:
                stored = lists.build_gram_lists(corpus, gram, g, size.n_docs)
            stored.write.mode("overwrite").parquet(f"{path}/topk_lists")
        if "corpus" in saved_parts(spark, path):
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/corpus/block=*")
            blocks = max(1, len(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)))
        meta = spark.createDataFrame([size], stats.schema).withColumns({"g": F.lit(g), "gram": F.lit(gram).cast("int"), "scope": F.lit(scope), "blocks": F.lit(blocks)})
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")  # one row
        return cls.load(spark, path)

    def save(self, path: str) -> None:
        for part in PARTS:
            own = getattr(self, part)
            if own is not None:
                out = (own.sortWithinPartitions("block") if part == "corpus" else own).write.mode("overwrite")
                (out.partitionBy("block") if part == "corpus" else out).parquet(f"{path}/{part}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopkIndex:
        held = saved_parts(spark, path)
        own = {part: spark.read.parquet(f"{path}/{part}") if part in held else None for part in PARTS if part != "corpus"}
        return cls(_corpus(spark, path) if "corpus" in held else None, **own)

    def parsed(self) -> DataFrame:
        """The phrases: stored ones, or those of the stored corpus."""
        return self.phrases if self.phrases is not None else phrases.lz78_phrases(self.corpus, self.meta.first().scope)

    def totals(self) -> DataFrame:
        """One row: documents, phrases with the root, stored lists, and their share of the nodes in thousandths."""
        counted = lambda df, name: df.agg(F.count("*").alias(name))
        one = self.meta.select("n_docs", "n", "g").crossJoin(counted(self.parsed(), "p")).crossJoin(counted(self.topk_lists, "n_lists"))  # one row each
        nodes = F.col("p") + 1
        return one.select("n_docs", "n", F.col("g").cast("long").alias("g"), nodes.alias("n_nodes"), "n_lists", F.floor(F.col("n_lists") * 1000 / nodes).alias("marked_permille"))

    def candidate_blocks(self, patterns: DataFrame) -> DataFrame:
        """(pattern_id, pattern, block): the blocks that hold every posted substring of a pattern; all blocks for short patterns."""
        asked = patterns.select("pattern_id", "pattern", F.array_distinct(grams(F.col("pattern"), POSTED)).alias("grams"))
        long_ones = asked.where(F.size("grams") > 0).select("pattern_id", "pattern", F.size("grams").alias("needed"), F.explode("grams").alias("gram"))
        met = self.postings.join(small_side(long_ones), "gram")
        held = met.groupBy("pattern_id", "pattern", "needed", "block").agg(F.count("*").alias("n")).where("n = needed").select("pattern_id", "pattern", "block")
        blocks = self.corpus.select("block").distinct()
        short = asked.where((F.size("grams") == 0) & (F.length("pattern") > 0)).select("pattern_id", "pattern")
        return held.unionByName(short.crossJoin(blocks).select("pattern_id", "pattern", "block"))  # what short patterns have to read

    def search(self, patterns: DataFrame) -> DataFrame:
        """(pattern_id, doc_id, doc_length, tf) from the candidate blocks of each pattern; other blocks aren't read."""
        wanted = self.candidate_blocks(patterns)
        rows = self.corpus.join(small_side(wanted), "block").where(F.contains("text", F.col("pattern")))
        return rows.select("pattern_id", "doc_id", "doc_length", occurrences(F.col("text"), F.col("pattern")).alias("tf")).where("tf > 0")

    def topk(self, pattern: str, k: int) -> DataFrame:
        """(doc_id, tf, doc_length) in order: from a stored list if one answers, by search otherwise."""
        check_pattern(pattern)
        spark = self.corpus.sparkSession
        stored = self.topk_lists.where(F.col("pattern") == pattern).select("docs", "is_complete").first()
        if stored and (stored.is_complete or len(stored.docs) >= k):
            rows = [(d.rank, d.doc_id, d.tf, d.doc_length) for d in stored.docs[:k]]
            schema = "rank int, doc_id long, tf long, doc_length long"
            return spark.createDataFrame(rows, schema).orderBy("rank").drop("rank")
        asked = spark.createDataFrame([(0, pattern)], "pattern_id long, pattern string")
        return self.search(asked).select("doc_id", "tf", "doc_length").orderBy(*ranking()).limit(k)

    def topk_batch(self, patterns: DataFrame, k_max: int) -> DataFrame:
        return lists.routed_topk(self.corpus, patterns, self.topk_lists, k_max, self.search)

    def bits_per_character(self, path: str) -> float:
        """Bytes of the saved index times 8 over the characters of the corpus with separators."""
        spark = self.corpus.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        return size * 8 / self.meta.first().n


def saved_parts(spark: SparkSession, path: str) -> list[str]:
    """The parts below ``path`` that were written to the end."""
    marks = {part: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/_SUCCESS") for part in PARTS}
    return [part for part, mark in marks.items() if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)]


def _blocked(corpus: DataFrame, blocks: int, block_bytes: int) -> DataFrame:
    """The corpus with ``block``: ranges of ids, a task each, are cut into blocks by bytes, so a task writes many small blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() * (blocks + 1), 0  # no range has more blocks than all have
        for b in batches:
            ends = before + np.cumsum(b.column("doc_length").to_numpy() + 1)
            block = first + np.concatenate([[before], ends])[:-1] // block_bytes
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block, pa.int64())], [*b.schema.names, "block"])

    own = corpus.select("doc_id", "text", "doc_length")
    ranges = own.repartitionByRange(min(blocks, shuffle_partitions(corpus)), "doc_id").sortWithinPartitions("doc_id")
    return ranges.mapInArrow(run, "doc_id long, text string, doc_length long, block long")


def _posted(corpus: DataFrame) -> DataFrame:
    """(gram, block): the substrings of POSTED characters of each block, once for each task that reads the block."""
    bits = 21 * np.arange(POSTED - 1, -1, -1)  # a code point has up to 21 bits

    def out(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate(held))
        names = codes.strings(found[:, None] >> bits & ((1 << 21) - 1))
        return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(found), block), pa.int64())], ["gram", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, points = -1, [], np.arange(codes.CODE_POINTS)
        for b in batches:
            for part in codes.slices(b, "texts"):
                for own, some in codes.runs(part, "block"):
                    if own != block and held:
                        yield out(block, held)
                        held = []
                    block = own
                    held.append(np.unique(codes.cut(some.column("texts"), POSTED, points, 1 << 21)[0]))
                    if len(held) == 64:
                        held = [np.unique(np.concatenate(held))]
        if held:
            yield out(block, held)

    return corpus.select(F.array("text").alias("texts"), "block").mapInArrow(run, "gram string, block long")


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, text string, doc_length long, block long").parquet(f"{path}/corpus")

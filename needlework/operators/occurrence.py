"""Occurrences of patterns in documents: counts, positions, documents that hold them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needlework.functions.text import SEPARATOR, check_pattern, has, occurrences
from needlework.sources.shared import shared_folder

#: Above so many patterns one automaton pass over the texts replaces a pass for each pattern.
SCAN_PATTERNS = 64
#: Pattern sets of up to this many are sent to all executors; larger ones are dealt with in blocks.
PATTERN_BLOCK = 100_000


def tf_per_document(corpus: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, doc_length, tf) of the documents that hold the pattern; the scan gets the containment test first."""
    return corpus.where(has(F.col("text"), pattern)).select("doc_id", "doc_length", occurrences(F.col("text"), pattern).alias("tf")).where("tf > 0")


def count_occurrences(corpus: DataFrame, pattern: str) -> DataFrame:
    return tf_per_document(corpus, pattern).agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("occurrences"))


def document_frequency(corpus: DataFrame, pattern: str) -> DataFrame:
    return corpus.where(has(F.col("text"), pattern)).agg(F.count("*").alias("n_docs"))


def document_listing(corpus: DataFrame, pattern: str) -> DataFrame:
    return corpus.where(has(F.col("text"), pattern)).select("doc_id")


def pattern_exists(corpus: DataFrame, pattern: str) -> DataFrame:
    return corpus.where(has(F.col("text"), pattern)).limit(1).agg((F.count("*") > 0).cast("int").alias("found"))


def locate_positions(corpus: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, pos) of every occurrence; pos counts characters from 0."""
    check_pattern(pattern)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, places = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                at = t.find(pattern)
                while at >= 0:
                    ids.append(i)
                    places.append(at)
                    at = t.find(pattern, at + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64())], ["doc_id", "pos"])

    return corpus.where(has(F.col("text"), pattern)).select("doc_id", "text").mapInArrow(find, "doc_id long, pos long")


def tf_scan(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, doc_id, doc_length, tf) for a small table of patterns: the texts are scanned once, nothing is shuffled."""
    rows = patterns.where((F.length("pattern") > 0) & ~F.contains("pattern", F.lit(SEPARATOR))).select("pattern_id", "pattern")
    held = corpus.join(F.broadcast(rows), F.contains(corpus.text, rows.pattern))
    return held.select("pattern_id", "doc_id", "doc_length", occurrences(F.col("text"), F.col("pattern")).alias("tf")).where("tf > 0")


def tf_automaton(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """As :func:`tf_scan` for many patterns: an automaton finds all of them in one pass over each text, block by block."""
    spark = corpus.sparkSession
    out = T.StructType([T.StructField("pattern_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("doc_length", T.LongType()), T.StructField("tf", T.LongType())])

    def scan(words: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: dict[str, list[int]] = {}
            for i, w in shared.value:
                ids.setdefault(w, []).append(i)
            machine = ahocorasick.Automaton()
            for w in ids:
                machine.add_word(w, w)
            machine.make_automaton()
            for b in batches:
                cols: tuple[list, list, list, list] = ([], [], [], [])
                for doc, size, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_length", "text")), strict=True):
                    counts: dict[str, int] = {}
                    for _, w in machine.iter(t):
                        counts[w] = counts.get(w, 0) + 1
                    for w, n in counts.items():
                        for i in ids[w]:
                            for c, v in zip(cols, (i, doc, size, n), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [f.name for f in out.fields])

        return corpus.select("doc_id", "doc_length", "text").mapInArrow(run, out)

    usable = patterns.where((F.length("pattern") > 0) & ~F.contains("pattern", F.lit(SEPARATOR))).select("pattern_id", "pattern")
    blocks = -(-usable.count() // PATTERN_BLOCK)
    if not blocks:
        return spark.createDataFrame([], out)
    # a block at a time is on the driver, about PATTERN_BLOCK patterns; of several, each is searched for before the next is read
    dealt = usable.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
    words = lambda k: [(r.pattern_id, r.pattern) for r in dealt.where(F.col("block") == k).select("pattern_id", "pattern").toLocalIterator()]
    if blocks == 1:
        return scan(words(0))
    path = shared_folder(spark, "frequencies")
    for k in range(blocks):
        scan(words(k)).write.parquet(f"{path}/block={k}")
    return spark.read.schema(out).parquet(*[f"{path}/block={k}" for k in range(blocks)])


def tf_batch(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """Frequencies of a table of patterns (pattern_id, pattern), by the cheaper of the two ways."""
    few = patterns.limit(SCAN_PATTERNS + 1).count() <= SCAN_PATTERNS
    return tf_scan(corpus, patterns) if few else tf_automaton(corpus, patterns)

"""Stored answers: top-k lists of frequent patterns, and the choice between a stored answer and a search.

Which patterns get a list follows from one number g: those that occur more than g times, each with as many documents as
the least power of two whose g-fold exceeds its occurrences. A list that holds all documents of its pattern is complete and
answers every k; another one answers up to its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.functions import codes
from needlework.functions.text import grams, list_budget
from needlework.sources.shared import BROADCAST_ROWS, small_side, staged

from .occurrence import tf_batch
from .topk import first_k, rank_within, ranking

LISTS = "pattern string, occ long, n_docs long, is_complete boolean, k_star long, docs array<struct<rank:int,doc_id:long,tf:long,doc_length:long>>"


def gram_frequencies(corpus: DataFrame, m: int, wanted: DataFrame | None = None) -> DataFrame:
    """(pattern, doc_id, doc_length, tf) of all substrings of m characters, or of those in ``wanted`` (pattern).

    Texts are dealt out by document before they are cut, a byte or so for each substring, so that substrings are counted where they are.
    """
    each = corpus.where(F.char_length("text") >= m).repartition("doc_id").select("doc_id", "doc_length", F.explode(grams(F.col("text"), m)).alias("pattern"))
    if wanted is not None:
        each = each.join(small_side(wanted.select("pattern")), "pattern", "left_semi")
    return each.groupBy("pattern", "doc_id", "doc_length").agg(F.count("*").alias("tf"))


def frequent_patterns(frequencies: DataFrame, g: int) -> DataFrame:
    """(pattern, occ, n_docs) of the patterns that occur more than g times."""
    return frequencies.groupBy("pattern").agg(F.sum("tf").cast("long").alias("occ"), F.count("*").alias("n_docs")).where(F.col("occ") > g)


def budgets(frequent: DataFrame, g: int, n_docs: int) -> DataFrame:
    """(pattern, occ, n_docs, is_complete, k_star)."""
    k = list_budget(F.col("occ"), g, F.lit(n_docs).cast("long"))
    return frequent.withColumn("is_complete", F.col("n_docs") <= k).withColumn("k_star", F.when(F.col("is_complete"), F.col("n_docs")).otherwise(k))


def listed(frequencies: DataFrame, frequent: DataFrame, key: str = "pattern") -> DataFrame:
    """(pattern, rank, doc_id, tf, doc_length): the first k_star documents of each pattern."""
    w = Window.partitionBy(key).orderBy(*ranking())
    rows = frequencies.join(small_side(frequent.select(key, "k_star")), key)
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= k_star").select(key, "rank", "doc_id", "tf", "doc_length")


def packed(rows: DataFrame, frequent: DataFrame, key: str = "pattern") -> DataFrame:
    """topk_lists: a row for each pattern with its documents as an array in order; arrays hold k_star documents at most."""
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "tf", "doc_length"))).alias("docs"))
    return frequent.join(one, key).select("pattern", "occ", "n_docs", "is_complete", "k_star", "docs")


def _stored(found: DataFrame, g: int, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """(frequent patterns, their topk_lists) of staged frequencies, which are counted once and read twice."""
    frequent = staged(budgets(frequent_patterns(found, g), g, n_docs), "frequent")
    return frequent, packed(listed(found, frequent), frequent)


def _dealt(corpus: DataFrame, m: int) -> DataFrame:
    """(doc_id, doc_length, texts), dealt out by document and staged; rows that agree in doc_id and doc_length are one document."""
    own = corpus.where(F.char_length("text") >= m).select("doc_id", "doc_length", "text")
    if own.groupBy("doc_id", "doc_length").count().where("count > 1").isEmpty():
        return staged(own.repartition("doc_id").select("doc_id", "doc_length", F.array("text").alias("texts")), "texts")
    return staged(own.groupBy("doc_id", "doc_length").agg(F.collect_list("text").alias("texts")), "texts")


def _symbols(dealt: DataFrame) -> np.ndarray:
    """The code points of all texts, in order; Unicode bounds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(codes.CODE_POINTS, bool)
        for b in batches:
            for part in codes.slices(b, "texts"):
                seen[codes.points(part.column("texts").flatten())] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int64())], ["symbol"])

    return np.array(sorted(r.symbol for r in dealt.select("texts").mapInArrow(run, "symbol long").distinct().collect()), np.int64)


def _histogram(dealt: DataFrame, m: int, alphabet: np.ndarray) -> DataFrame:
    """(code, tf, n): how many documents hold a substring so often; tasks sum up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit, held, size = codes.ranks(alphabet), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held[0]], ["code", "tf", "n"])

        for b in batches:
            for part in codes.slices(b, "texts"):
                code, _, tf = codes.counted(part.column("texts"), m, digit, len(alphabet))
                held.append(codes.histogram(code, tf, np.ones(len(code), np.int64)))
                size += len(held[-1][0])
                if size > codes.HELD:
                    held = [codes.histogram(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > codes.HELD // 2:
                        yield out()
                        held, size = [], 0
        if held:
            held = [codes.histogram(*map(np.concatenate, zip(*held, strict=True)))]
            yield out()

    return dealt.select("texts").mapInArrow(run, "code long, tf long, n long").repartition("code").groupBy("code", "tf").agg(F.sum("n").alias("n"))


def _frequent_codes(histogram: DataFrame, m: int, alphabet: np.ndarray, g: int, n_docs: int) -> DataFrame:
    """(code, pattern, occ, n_docs, is_complete, k_star, least_tf): no document below least_tf is among the first k_star."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = codes.strings(codes.digits(b.column("code").to_numpy(), m, alphabet))
            yield pa.RecordBatch.from_arrays([b.column("code"), names, *b.columns[1:]], ["code", "pattern", *b.schema.names[1:]])

    w = Window.partitionBy("code")
    each = histogram.withColumns({"occ": F.sum(F.col("tf") * F.col("n")).over(w), "n_docs": F.sum("n").over(w), "above": F.sum("n").over(w.orderBy(F.desc("tf")))})
    enough = F.max(F.when(F.col("above") >= F.col("k_star"), F.col("tf"))).alias("least_tf")
    rows = budgets(each.where(F.col("occ") > g), g, n_docs).groupBy("code", "occ", "n_docs", "is_complete", "k_star").agg(enough)
    return rows.mapInArrow(named, "code long, pattern string, occ long, n_docs long, is_complete boolean, k_star long, least_tf long")


def _code_frequencies(dealt: DataFrame, m: int, alphabet: np.ndarray, frequent: DataFrame) -> DataFrame:
    """(code, doc_id, doc_length, tf) of the documents that can be in a list: tf is at least the code's least_tf."""
    bounds = frequent.select("code", "least_tf")
    sent = None
    if bounds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = bounds.toArrow()  # two numbers a frequent substring, a million of them at most
        known, least = rows["code"].to_numpy(), rows["least_tf"].to_numpy()
        order = np.argsort(known)
        sent = dealt.sparkSession.sparkContext.broadcast((known[order], least[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit = codes.ranks(alphabet)
        for b in batches:
            for part in codes.slices(b, "texts"):
                code, row, tf = codes.counted(part.column("texts"), m, digit, len(alphabet))
                if sent is not None:
                    known, least = sent.value
                    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    keep = (known[at] == code) & (tf >= least[at]) if len(known) else np.zeros(len(code), bool)
                    code, row, tf = code[keep], row[keep], tf[keep]
                own = [part.column(c).take(pa.array(row)) for c in ("doc_id", "doc_length")]
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), *own, pa.array(tf, pa.int64())], ["code", "doc_id", "doc_length", "tf"])

    found = dealt.mapInArrow(run, "code long, doc_id long, doc_length long, tf long")
    return found if sent is not None else found.join(bounds, "code").where("tf >= least_tf").drop("least_tf")


def build_gram_lists(corpus: DataFrame, m: int, g: int, n_docs: int) -> DataFrame:
    """topk_lists of all frequent substrings of m characters.

    Substrings are numbers where their codes fit. A first pass counts by substring and tf, which gives each list its least tf;
    a second one counts again and lets through only the documents from there on, so that most pairs are never shuffled.
    """
    dealt = _dealt(corpus, m)
    alphabet = _symbols(dealt)
    if not codes.fits(len(alphabet), m):
        return _stored(staged(gram_frequencies(corpus, m), "gram_frequencies"), g, n_docs)[1]
    frequent = staged(_frequent_codes(_histogram(dealt, m, alphabet), m, alphabet, g, n_docs), "frequent")
    return packed(listed(_code_frequencies(dealt, m, alphabet, frequent), frequent, "code"), frequent, "code")


def build_phrase_lists(corpus: DataFrame, phrases: DataFrame, g: int, n_docs: int) -> DataFrame:
    """topk_lists of all phrase strings, of whatever length, that occur more than g times.

    Level by level of length: a string that occurs more than g times has a prefix that does, and phrase strings are closed
    under prefixes. So a level asks only for phrase strings whose prefix survived the level before, and only their places are
    counted; the last level is the one without a survivor. Every level is staged, and its lists are built from its counts.
    """
    spark = corpus.sparkSession
    strings = staged(phrases.where("not is_terminal").select(F.col("ptext").alias("pattern")).distinct(), "phrase_strings")
    out, known, m = spark.createDataFrame([], LISTS), None, 1
    while True:
        wanted = strings.where(F.char_length("pattern") == m)
        if known is not None:
            wanted = wanted.join(small_side(known.select(F.col("pattern").alias("shorter"))), F.left("pattern", F.lit(m - 1)) == F.col("shorter"), "left_semi")
        known, level = _stored(staged(gram_frequencies(corpus, m, staged(wanted, "wanted")), "level_frequencies"), g, n_docs)
        if not known.limit(1).count():
            return out
        out, m = out.unionByName(level), m + 1


def answerable(patterns: DataFrame, lists: DataFrame) -> DataFrame:
    """``patterns`` (pattern_id, pattern, k) with the stored documents of those that a list answers."""
    held = patterns.join(lists.select("pattern", "docs", "is_complete"), "pattern", "left")
    return held.withColumn("hit", F.coalesce(F.col("is_complete") | (F.size("docs") >= F.col("k")), F.lit(False)))


def from_lists(patterns: DataFrame, lists: DataFrame) -> DataFrame:
    """(pattern_id, rank, doc_id, tf, doc_length) of the patterns that stored lists answer: the first k of each list."""
    rows = answerable(patterns, lists).where("hit").select("pattern_id", F.explode(F.slice("docs", F.lit(1), F.col("k"))).alias("d"))
    return rows.select("pattern_id", F.col("d.rank").alias("rank"), F.col("d.doc_id").alias("doc_id"), F.col("d.tf").alias("tf"), F.col("d.doc_length").alias("doc_length"))


def misses(patterns: DataFrame, lists: DataFrame) -> DataFrame:
    """The patterns that have to be searched for."""
    hits = answerable(patterns, lists).where("hit").select("pattern_id")
    return patterns.join(hits, "pattern_id", "left_anti")


def routed_topk(corpus: DataFrame, patterns: DataFrame, lists: DataFrame, k_max: int, search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Top-k of all patterns: from lists where they answer, by ``search`` (a scan if not given) otherwise; both give the same rows."""
    rest = staged(misses(patterns, lists), "misses")
    searched = rank_within((search or (lambda asked: tf_batch(corpus, asked)))(rest), ["pattern_id"], k_max)
    return from_lists(patterns, lists).unionByName(first_k(searched, rest))

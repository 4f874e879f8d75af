"""What a collection is made of: symbols, lengths, offsets, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.sources.collections import shuffle_partitions
from needlework.sources.shared import staged

#: Slots of a node over which symbols are spread by frequency.
SLOTS = 16


def symbol_histogram(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(symbol, freq) over all texts; counted inside tasks first, so the shuffle holds an alphabet a task."""
    return corpus.select(F.explode(F.split(text, "")).alias("symbol")).where("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("freq"))


def alphabet_size(corpus: DataFrame, text: str = "text") -> DataFrame:
    return symbol_histogram(corpus, text).agg(F.count("*").alias("sigma"))


def symbol_priority(histogram: DataFrame) -> DataFrame:
    """Symbols by falling frequency and the slot of each: slots are filled to and fro, so frequent symbols stay apart."""
    ranked = histogram.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("freq"), "symbol")) - 1).cast("long"))  # an alphabet
    way, turn = F.pmod("rank", F.lit(SLOTS)), F.floor(F.col("rank") / SLOTS)
    return ranked.withColumn("slot", F.when(turn % 2 == 0, way).otherwise(SLOTS - 1 - way).cast("long"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: documents, bytes with separators, bits for an offset and for a document number."""
    one = corpus.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.col("doc_length") + 1), F.lit(0)).cast("long").alias("n"), F.max("doc_length").alias("longest"))
    bits = lambda c: F.ceil(F.log2(F.greatest(F.col(c), F.lit(1)).cast("double"))).cast("int")
    return one.withColumns({"n_bits": bits("n"), "doc_bits": bits("n_docs")})


def doc_offsets(corpus: DataFrame, slices: int | None = None) -> DataFrame:
    """(doc_id, doc_start, doc_end) in the concatenation by id, one separator after each document; ends are exclusive.

    Running sums are taken inside slices of the id order, staged once, and shifted by the sums of the slices before.
    """
    sized = corpus.select("doc_id", F.char_length("text").cast("long").alias("size")).repartitionByRange(slices or shuffle_partitions(corpus), "doc_id").withColumn("slice", F.spark_partition_id())
    sized = staged(sized, "sizes")
    within = sized.withColumn("upto", F.sum(F.col("size") + 1).over(Window.partitionBy("slice").orderBy("doc_id")))
    sums = sized.groupBy("slice").agg(F.sum(F.col("size") + 1).alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    placed = within.join(F.broadcast(before), "slice")
    end = F.col("before") + F.col("upto")
    return placed.select("doc_id", (end - F.col("size") - 1).alias("doc_start"), end.alias("doc_end"))


def position_to_document(offsets: DataFrame, positions: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(text_pos, doc_id): the document that covers a position of the concatenation.

    A range join by blocks: a document goes to the blocks that it touches, a position to its own, and the two meet by equality.
    """
    spans = offsets.withColumn("block", F.explode(F.sequence(F.floor(F.col("doc_start") / block), F.floor((F.col("doc_end") - 1) / block))))
    asked = positions.withColumn("block", F.floor(F.col("text_pos") / block))
    return asked.join(spans, "block").where("text_pos >= doc_start and text_pos < doc_end").select("text_pos", "doc_id")


def substrings(corpus: DataFrame, start: int, m: int) -> DataFrame:
    """(doc_id, slice): m characters from place ``start`` (from 0) of every document that reaches so far."""
    return corpus.where(F.char_length("text") >= start + m).select("doc_id", F.substring("text", start + 1, m).alias("slice"))


def _draw(width: int, *of: str | int) -> Column:
    """A number below 16^width from a digest of the arguments, the same in every engine."""
    parts = [F.lit(str(x)) if isinstance(x, int) else F.col(x).cast("string") for x in of]
    return F.conv(F.left(F.md5(F.concat_ws(":", *parts)), F.lit(width)), 16, 10).cast("long")


def sample_patterns(corpus: DataFrame, m: int, n: int, seed: int = 1) -> DataFrame:
    """n patterns of m characters from places drawn by a digest of id and draw, each text as often as it is long.

    Windows with the separator or of one repeated character are left out, as they say nothing about the text.
    """
    long_enough = corpus.where(F.char_length("text") > m)
    total = long_enough.agg(F.sum(F.char_length("text") - m)).first()[0] or 0
    # a few more draws than asked for, since some windows are refused
    draws = F.ceil((F.char_length("text") - m) * F.lit(4 * n) / F.lit(max(total, 4 * n))).cast("int")
    drawn = long_enough.select("doc_id", "text", F.explode(F.sequence(F.lit(1), draws)).alias("draw"))
    place = F.pmod(_draw(8, "doc_id", "draw", seed), F.char_length("text") - m).cast("int")
    picked = drawn.select("doc_id", place.cast("long").alias("pos"), F.substr("text", place + 1, F.lit(m)).alias("pattern"), _draw(12, "draw", "doc_id", seed + 1).alias("h"))
    told = ~F.contains("pattern", F.lit("\x01")) & (F.size(F.array_distinct(F.split("pattern", ""))) > 1)
    return picked.where(told).orderBy("h", "doc_id", "pos").limit(n).select("doc_id", "pos", "pattern")

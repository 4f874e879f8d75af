"""Readers: tables, collections of files, single-file collections, pattern files, configurations."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.functions.text import ascii_lower, drop_last, list_mode, single_file_mode

from .shared import staged

PATTERN_LENGTHS = (3, 99)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, doc_length) of a table; doc_length in bytes. Null texts are no documents."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.octet_length(text).cast("long").alias("doc_length")).where("text is not null")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, *order: str | Column, parts: int | None = None, name: str = "doc_no") -> DataFrame:
    """``rows`` with ``name``, the 0-based ordinal by ``order``, in ``parts`` ranges (as many as shuffles have, if not given).

    Rows are staged in sorted ranges, each with its place in its range; the counts of the ranges before shift the places. So no
    task sorts all rows, and ranges are drawn once only, as bounds sampled twice might differ.
    """
    placed = rows.repartitionByRange(parts or shuffle_partitions(rows), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed, "ranges").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    in_range = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + in_range).drop("_part", "_at", "_before")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as readers report it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def read_file_list(spark: SparkSession, list_file: str, lower: bool = False, drop_last_byte: bool = True) -> DataFrame:
    """A collection given by a file of paths, one a line; files of up to one byte are skipped; ids follow the list.

    A file that is listed twice is two documents. Names are taken as they are: they hold no wildcards.
    """
    paths = [_qualified(spark, r.value) for r in spark.read.text(list_file).collect() if r.value.strip()]  # names only: readers get them from the driver
    if not paths:
        return spark.createDataFrame([], "doc_id long, text string, doc_length long")
    files = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in dict.fromkeys(paths)]).where("length > 1")
    order = spark.createDataFrame(list(enumerate(paths)), "place long, path string")
    clean = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"[\x00-\x01\x80-\xff]", " ")
    if lower:
        clean = ascii_lower(clean)
    if drop_last_byte:
        clean = drop_last(clean)
    placed = files.join(order, "path").select("place", clean.alias("text"), F.col("length").alias("doc_length"))
    return numbered(placed, "place").select(F.col("doc_no").alias("doc_id"), "text", "doc_length")


def read_single_file(spark: SparkSession, path: str, delimiter: str, lower: bool = False) -> DataFrame:
    """A collection in one file, documents apart by a delimiter; the file's last byte is left out.

    The reader cuts the file at delimiters, split by split. A piece begins a document, but an empty one stands for a further
    delimiter in a row: a newline at the end of the document before, or nothing at the end of the file.
    """
    pieces = spark.read.option("lineSep", delimiter).text(path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    pieces = staged(numbered(pieces, "_start", "_row", name="_no").drop("_start", "_row"), "pieces")
    shape = pieces.agg(F.count("*").alias("n"), F.sum(F.octet_length("value").cast("long")).alias("bytes")).first()
    if not shape.n:
        return spark.createDataFrame([], "doc_id long, text string, doc_length long")
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = own.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(own).getLength()
    closed = size >= shape.bytes + shape.n * len(delimiter.encode())  # the last byte ends a delimiter
    last = F.col("_no") == shape.n - 1
    value = F.col("value") if closed else F.when(last, drop_last(F.col("value"))).otherwise(F.col("value"))
    rows = pieces.select("_no", value.alias("value"), last.alias("last")).withColumn("opens", (F.col("_no") == 0) | (F.col("value") != ""))
    # the number of openings up to a piece is its document's: counted in slices of the order, shifted by the slices before
    width = max(1, -(-shape.n // (4 * shuffle_partitions(pieces))))
    rows = rows.withColumn("slice", F.floor(F.col("_no") / width))
    opened = rows.groupBy("slice").agg(F.sum(F.col("opens").cast("long")).alias("n"))
    before = opened.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a slice
    within = F.sum(F.col("opens").cast("long")).over(Window.partitionBy("slice").orderBy("_no"))
    placed = rows.withColumn("within", within).join(F.broadcast(before), "slice").withColumn("doc_id", F.col("before") + F.col("within") - 1)
    newlines = F.sum((~F.col("opens") & ~F.col("last")).cast("int")).cast("int")
    docs = placed.groupBy("doc_id").agg(F.max("value").alias("piece"), newlines.alias("runs"))
    text = F.concat(single_file_mode(F.col("piece"), lower), F.repeat(F.lit("\n"), F.col("runs")))
    return docs.select("doc_id", text.alias("text")).withColumn("doc_length", F.octet_length("text").cast("long"))


def patterns_of(lines: DataFrame, column: str = "value", lower: bool = False, most_spaces: int | None = None) -> DataFrame:
    """Lines that serve as patterns: 3 to 99 bytes long, and at most so many white-space characters, if asked."""
    lo, hi = PATTERN_LENGTHS
    kept = lines.select(F.col(column).alias("pattern")).where(F.octet_length("pattern").between(lo, hi))
    if most_spaces is not None:
        kept = kept.where(F.regexp_count("pattern", F.lit(r"\s")) <= most_spaces)
    return kept.withColumn("pattern", list_mode(F.col("pattern"), True)) if lower else kept


def read_patterns(spark: SparkSession, path: str, lower: bool = False, most_spaces: int | None = None) -> DataFrame:
    return patterns_of(spark.read.text(path), "value", lower, most_spaces)


@dataclass(frozen=True)
class Settings:
    """The parameters of a collection, as its configuration file names them."""

    g: int = 32
    input_file: str = ""
    files_in_list: bool = False
    store: str = ""
    results: str = ""
    lowercase: bool = False
    delimiter: str = "\n"
    patterns_from_file: bool = False
    repetitions: int = 100
    max_pattern: int = 10
    test: bool = False

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        """From a file in any store that Spark reads."""
        return cls.parse("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # a configuration

    @classmethod
    def parse(cls, content: str) -> Settings:
        ini = configparser.ConfigParser(strict=False, inline_comment_prefixes=(";", "#"))
        ini.read_string(content)
        top, every = ini["TOPK"], ini["GLOBALS"] if ini.has_section("GLOBALS") else {}
        flag = lambda section, key: str(section.get(key, "0")).strip() not in ("", "0")
        mark = str(top.get("boundSymbol", "\n")).strip()
        return cls(
            g=int(top.get("g", "32")),
            input_file=top.get("inputFile", "").strip(),
            files_in_list=flag(top, "filesInList"),
            store=top.get("dirStore", "").strip(),
            results=top.get("dirResult", "").strip(),
            lowercase=flag(top, "lowercase"),
            delimiter=chr(int(mark)) if mark.isdigit() and len(mark) > 1 else (mark or "\n"),
            patterns_from_file=flag(top, "pattFromFile"),
            repetitions=int(every.get("N_REP", "100")),
            max_pattern=int(every.get("MAX_M", "10")),
            test=flag(every, "TEST"),
        )

"""Helpers shared by the corpus operators: shared-folder tables, ids, samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of narrow rows (an id or a hash each) that is ever broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000

#: Rows of one Arrow batch at most: texts are long, and a batch of them is held several times between JVM and Python.
ARROW_ROWS = 1_000
_ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dir: str | None = None


def release_memory() -> None:
    """Hand freed memory of this Python process back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def returns_memory(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that hands freed memory back when its task ends: idle Python workers live on beside the JVM."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        release_memory()

    return run


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batch size to what long texts allow; a lower setting stays.

    The setting is read when a plan runs, which is after the operators return, so it stays lowered in the session.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ARROW_KEY)) <= ARROW_ROWS:
        conf.set(_ARROW_KEY, str(ARROW_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder of our own, on a local master only: elsewhere executors can't see it."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="needlework-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


#: After so many staged tables the driver hands freed memory back: operators plan many jobs, and a session runs many operators.
RELEASE_EVERY = 8

#: Folders of the tables that this process staged, in order.
_staged: list[str] = []


def staged_so_far() -> int:
    return len(_staged)


def drop_staged(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete the tables staged after the first ``since``, but for the last one if so wanted. Frames over them can't be read any more."""
    kept = _staged[-1:] if but_last and len(_staged) > since else []
    for path in _staged[since : len(_staged) - len(kept)]:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    _staged[since:] = kept


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/needlework/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _staged.append(path)
    if len(_staged) % RELEASE_EVERY == 0:
        release_memory()
        spark._jvm.System.gc()  # also lets Spark drop broadcasts and shuffles that nothing refers to any more
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the ids that no model learns labels from."""
    return (F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5) == 0


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow staged table for broadcast if it is small enough; leave it to a shuffle otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``classes``, a staged table of one row for each key and the number of rows that have it.

    Keys of very many rows are few (at most 100,000, since each has over a 100,000th of ``total``), so they are sent to all
    tasks; the others are no hot keys and are shuffled.
    """
    many = max(500, total // 100_000)
    large = F.broadcast(classes.where(F.col(size) > many).drop(size))
    small = rows.join(large.select(*keys), keys, "left_anti").join(classes.where(F.col(size) <= many).drop(size), keys, how)
    return rows.join(large, keys).unionByName(small)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of labelled rows that may be learnt from, at most about ``bound`` of them.

    The rows are chosen by a hash of the id, so the choice is the same in every run and at every partitioning. The
    bound is a parameter of the classifiers; scoring always covers all rows. Held-out ids never take part. A doc_id
    that is labelled twice counts with its largest label; null ids and labels are left out.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    total = known.count()
    if total > bound:
        # a hash threshold keeps the fraction without a global sort
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * bound / total))
    known = stage_table(known, "labelled")
    return text_batches(docs).select("doc_id", "text").join(F.broadcast(known), "doc_id")

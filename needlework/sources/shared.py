"""The folder that driver and executors share, and tables staged in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of narrow rows that is ever broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000

_own: str | None = None


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder of our own, on a local master only: elsewhere executors can't see it."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="needlework-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_base(spark)}/needlework/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage cut, no executor needed to keep it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows; left to a shuffle otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df

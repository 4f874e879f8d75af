"""Token counts: additive totals by source, language and tokenizer version, maintained from signed deltas.

A ledger is a folder with one sub-folder for each committed batch. A batch holds signed rows: an insert adds a document's
count under a tokenizer version, a delete takes back what the ledger holds for it, and a revision takes the old count back
and adds the new one. Beside the rows lies their rollup, so totals are the sum of small tables. A batch is staged, moved
into place by a rename that refuses a taken name, and known by its id: of writers of one id the first one counts, the others
change nothing, and a batch whose job died leaves no trace in the totals.

Compaction keeps a ledger quick: it sums the rows of all batches up to now by document, sorted by id, and their rollups into
one, under a generation that names the batches it holds. Readers take the newest generation and the batches that came after it,
so totals are maintained and not summed anew from the first batch on.

Defined results: null texts count as no tokens and no characters; texts of any length are counted whole; null sources and
languages are groups of their own; documents are known by their id, and repeated rows of one batch add up under it, so a delete
takes all of them back; null ids are counted but can't be taken back; other columns are ignored whatever their names; empty
batches commit and change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_classes, returns_memory, shared_dir, stage_table, text_batches
from .tokens import BytePairs

GROUP = ("source", "lang", "tokenizer")
ROWS = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, chars long"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per document and tokenizer version: its tokens and characters. ``tokenizers``: version -> (rank file, pattern)."""
    out = T.StructType([T.StructField(c, T.LongType() if c in ("doc_id", "docs", "tokens", "chars") else T.StringType()) for c in ("doc_id", *GROUP, "docs", "tokens", "chars")])

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {version: BytePairs(*where) for version, where in tokenizers.items()}
        for b in batches:
            texts = b.column("text").to_pylist()
            chars = pa.array([len(t or "") for t in texts], pa.int64())
            for version, counter in own.items():
                tokens = pa.array([counter.count(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([version] * len(b), pa.string()), pa.array([1] * len(b), pa.int64()), tokens, chars], [f.name for f in out.fields])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, out)


class TokenLedger:
    """Signed batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/needlework/ledger-{uuid.uuid4().hex}").rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _own(self, batch: str) -> str:
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        return f"{self.path}/batches/{batch}"

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def batches(self) -> list[str]:
        return self._names("batches")

    def _publish(self, staged: str, place: str) -> bool:
        """Move a staged folder to a place that nobody has taken; False, and the folder goes, if somebody has."""
        jvm, target = self.spark._jvm, self._path(place)
        self._fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._path(staged)), self._fs.makeQualified(target), none)  # refuses a taken name
        except Py4JJavaError:
            self._fs.delete(self._path(staged), True)
            if self._fs.exists(target):
                return False
            raise
        # stores that only check and then move can put a late writer's folder inside the first one's: it is not part of it
        inside = self._path(f"{place}/{staged.rsplit('/', 1)[-1]}")
        if self._fs.exists(inside):
            self._fs.delete(inside, True)
            return False
        return True

    def _generation(self) -> tuple[str | None, set[str]]:
        """The newest generation, and the batches that it holds."""
        names = self._names("generations")
        if not names:
            return None, set()
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/generations/{names[-1]}/batches")
        return names[-1], {r.batch for r in held.collect()}  # names only

    def _read(self, what: str, schema: str, of: tuple[str | None, set[str], list[str]] | None = None) -> DataFrame:
        """Signed rows or rollups of a generation, the batches that it holds, and the batches there are (now, if not given)."""
        generation, held, batches = of or (*self._generation(), self.batches())
        paths = [f"{self.path}/batches/{b}/{what}" for b in batches if b not in held]
        paths += [f"{self.path}/generations/{generation}/{what}"] if generation else []
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add signed rows under a batch id. False, and nothing changes, if that id has been committed."""
        own = self._own(batch)
        if self._fs.exists(self._path(own)):
            return False
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.select("doc_id", *GROUP, "docs", "tokens", "chars").write.parquet(f"{staged}/rows")
        own_rows = self.spark.read.schema(ROWS).parquet(f"{staged}/rows")
        self._summed(own_rows).coalesce(1).write.parquet(f"{staged}/totals")
        return self._publish(staged, own)

    @staticmethod
    def _summed(rows: DataFrame, *keys: str) -> DataFrame:
        """Net sums by the keys and groups, without those that come to nothing."""
        return rows.groupBy(*keys, *GROUP).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")]).where("docs <> 0 or tokens <> 0 or chars <> 0")

    def compact(self, drop: bool = False) -> bool:
        """A new generation of all batches that are committed by now. False if another writer made one meanwhile, or none is due.

        ``drop`` deletes the batches' own rows, for times when nobody reads the generation before.
        """
        generation, held = self._generation()
        names = self.batches()
        now = (generation, held, names)
        if set(names) <= held:
            return False
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        net = self._summed(self._read("rows", ROWS, now), "doc_id")
        net.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{staged}/rows")
        self._summed(self._read("totals", TOTALS, now)).coalesce(1).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(b,) for b in names], "batch string").coalesce(1).write.parquet(f"{staged}/batches")
        if not self._publish(staged, f"{self.path}/generations/{int(generation or 0) + 1:09d}"):
            return False
        for b in names if drop else ():  # a batch's folder stays, as its id is taken; its rows are in the generation
            for what in ("rows", "totals"):
                self._fs.delete(self._path(f"{self._own(b)}/{what}"), True)
        return True

    def held(self, ids: DataFrame) -> DataFrame:
        """What the ledger holds now for the doc_ids of ``ids``."""
        return self._summed(self._read("rows", ROWS).join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")

    def insert(self, batch: str, counts: DataFrame) -> bool:
        return self.commit(batch, counts)

    def delete(self, batch: str, ids: DataFrame) -> bool:
        held = self.held(ids)
        return self.commit(batch, held.withColumns({c: -F.col(c) for c in ("docs", "tokens", "chars")}))

    def revise(self, batch: str, counts: DataFrame) -> bool:
        """Replace the counts of the documents in ``counts`` under the tokenizer versions that it holds."""
        keys = counts.select("doc_id", "tokenizer").distinct()
        old = self.held(keys).join(keys, ["doc_id", "tokenizer"], "left_semi").withColumns({c: -F.col(c) for c in ("docs", "tokens", "chars")})
        return self.commit(batch, counts.select("doc_id", *GROUP, "docs", "tokens", "chars").unionByName(old))

    def totals(self) -> DataFrame:
        """docs, tokens and chars by source, language and tokenizer version, over all committed batches."""
        return self._summed(self._read("totals", TOTALS))


def surplus_copies(docs: DataFrame) -> DataFrame:
    """doc_id of every document whose text another document with a smaller id has too."""
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("m"), F.xxhash64("text").alias("h"))
    known = stage_table(known, "text_hashes")
    first = stage_table(known.groupBy("m", "h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copied")
    return join_classes(known, first, ["m", "h"], "n", known.count()).where("doc_id > first").select("doc_id").distinct()

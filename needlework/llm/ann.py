"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first, as widely as calibration asks for.

Nearness is the inner product. Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm of all rows, so
that the largest inner product is the smallest distance and k-means cells fit. The tree is fitted on a bounded sample;
every row is put into a leaf. A query walks the tree through a priority queue of nodes by distance and visits leaves in
that order. How many leaves, is calibrated: for a bounded set of queries the true neighbours are found by brute force over
all rows, and visits widen until the wanted share of them lies in the visited leaves (all leaves, if need be).

Rows and queries meet by bins of neighbouring leaves. A query's first leaves give the score that rows of its further leaves
have to reach, and a bin gives the k nearest rows of all its visited leaves together. Large leaves are cut into parts, and so are the queries of much visited bins, so a vector
that a third of all rows share is no hot key. Scores are sums in double precision over the original components, in order.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than the most frequent one (the shorter at a tie); rows of equal vec_id count once as an answer, with their best
score; null ids take no part; ties go to the smaller vec_id; fewer candidates than k give shorter lists; an empty table or
one without queries gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import returns_memory, stage_table

PART_ROWS = 4_096

#: A query's first leaves give the score that rows of its other leaves have to reach.
FIRST_LEAVES = 3


@dataclass
class Tree:
    """Nodes by number; inner nodes have children and their centres, leaves a leaf number."""

    top: float  # the largest norm
    children: dict[int, np.ndarray] = field(default_factory=dict)
    centres: dict[int, np.ndarray] = field(default_factory=dict)
    leaf: dict[int, int] = field(default_factory=dict)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0))])

    def lifted_query(self, q: np.ndarray) -> np.ndarray:
        return np.append(q * (self.top / max(math.sqrt(float(q @ q)), 1e-300)), 0.0)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, by the nearest child at each level."""
        out = np.zeros(len(x), np.int32)
        lifted = self.lifted(x)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node in self.leaf:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[node]
            near = ((c * c).sum(1) - 2 * lifted[rows] @ c.T).argmin(1)
            todo += [(int(child), rows[near == k]) for k, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order."""
        lifted = self.lifted_query(q)
        heap: list[tuple[float, int]] = [(0.0, 0)]
        out: list[int] = []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if node in self.leaf:
                out.append(self.leaf[node])
                continue
            far = ((self.centres[node] - lifted) ** 2).sum(1)
            for k, child in enumerate(self.children[node]):
                heapq.heappush(heap, (float(far[k]), int(child)))
        return out


def _kmeans(x: np.ndarray, k: int, r: np.random.Generator, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[r.choice(len(x), k, replace=False)].copy()
    of = np.zeros(len(x), int)
    for _ in range(steps):
        of = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        for c in range(k):
            own = x[of == c]
            centres[c] = own.mean(0) if len(own) else x[r.integers(len(x))]
    of = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
    return centres, of


def fit_tree(sample: np.ndarray, top: float, leaf_points: int, branching: int = 8, seed: int = 11) -> Tree:
    """Cut the sample into cells again and again until they hold at most ``leaf_points`` of its rows."""
    tree, r = Tree(top), np.random.default_rng(seed)
    x = tree.lifted(sample)
    todo, nodes = [(0, np.arange(len(x)))], 1
    while todo:
        node, rows = todo.pop()
        parts: list[np.ndarray] = []
        if len(rows) > leaf_points:
            centres, of = _kmeans(x[rows], min(branching, len(rows)), r)
            parts = [rows[of == c] for c in range(len(centres))]
        if sum(len(p) > 0 for p in parts) < 2:  # small enough, or all alike
            tree.leaf[node] = len(tree.leaf)
            continue
        kept = [c for c, p in enumerate(parts) if len(p)]
        tree.centres[node] = centres[kept]
        tree.children[node] = np.arange(nodes, nodes + len(kept))
        todo += [(nodes + i, parts[c]) for i, c in enumerate(kept)]
        nodes += len(kept)
    return tree


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, component after component, the same for equal vectors wherever they stand."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _few_of_each(rows: np.ndarray, row_ids: np.ndarray, most: int) -> np.ndarray:
    """Of equal vectors the rows of the ``most`` smallest ids, each id once: no answer can hold more of them."""
    if not len(rows):
        return np.zeros(0, np.int64)
    by_id = np.argsort(row_ids, kind="stable")
    whole = np.ascontiguousarray(rows[by_id]).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    of = np.unique(whole, return_inverse=True)[1]
    order = np.argsort(of, kind="stable")
    of, ids = of[order], row_ids[by_id][order]
    again = np.append(False, (of[1:] == of[:-1]) & (ids[1:] == ids[:-1]))
    order, of = order[~again], of[~again]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    return by_id[order[place < most]]


def top_pairs(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k nearest rows of each query, its own row left out, ties to the smaller id.

    ``bounds`` are scores below which a query has no use for a row.
    """
    kept = _few_of_each(rows, row_ids, k + 1)
    rows, row_ids = rows[kept], row_ids[kept]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 256):
        q, ids = queries[at : at + 256], query_ids[at : at + 256]
        low = np.full(len(q), -np.inf) if bounds is None else bounds[at : at + 256]
        near = q @ rows.T
        near[ids[:, None] == row_ids[None, :]] = -np.inf
        if len(rows) > k:
            least = np.maximum(np.partition(near, -k, axis=1)[:, -k], low)
            # the matrix product may differ in its last digits from the sum in order
            i, j = np.nonzero(near >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        else:
            i, j = np.nonzero(near > -np.inf)
        ok = near[i, j] > -np.inf
        i, j = i[ok], j[ok]
        score = exact_scores(q[i], rows[j])
        ok = score >= low[i]
        i, j, score = i[ok], j[ok], score[ok]
        order = np.lexsort((row_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, np.arange(len(q)))
        keep = np.arange(len(i)) - first[i] < k
        out.append((ids[i[keep]], row_ids[j[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the rows that take part, and their length (0 if there is none)."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), good.alias("good")).where("good").drop("good")
    sizes = sorted(kept.groupBy(F.size("v").alias("d")).count().collect(), key=lambda r: (-r["count"], r.d))
    return (kept.where(F.size("v") == sizes[0].d), sizes[0].d) if sizes else (kept, 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class AnnIndex:
    tree: Tree
    visits: int
    recall: float  # on the calibration queries
    rows: DataFrame  # vec_id, v (bytes), leaf
    dim: int


def build_index(vectors: DataFrame, k: int = 20, target: float = 0.97, leaf_rows: int = 500, sample_rows: int = 40_000, calibration: int = 128) -> AnnIndex | None:
    """Fit, fill and calibrate. ``sample_rows`` (of 64 components; fewer longer ones) and ``calibration`` bound what the
    driver sees; all rows are indexed.
    """
    usable_rows, dim = usable(vectors)
    if not dim:
        return None
    sample_rows = max(1_000, min(sample_rows, 64 * sample_rows // dim))
    spark = vectors.sparkSession
    shape = usable_rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top")).first()
    by_hash = lambda bound: usable_rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / shape.n))).orderBy("vec_id").limit(2 * bound)
    sample = np.array([r.v for r in by_hash(sample_rows).select("v").toLocalIterator()], float)
    if not len(sample):
        sample = np.array([r.v for r in usable_rows.orderBy("vec_id").limit(1).collect()], float)
    tree = fit_tree(sample, shape.top, max(4, leaf_rows * len(sample) // shape.n))
    shared = spark.sparkContext.broadcast(tree)

    @returns_memory
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(_matrix(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([row.tobytes() for row in x], pa.binary()), pa.array(shared.value.assign(x) if len(x) else [], pa.int32())], ["vec_id", "v", "leaf"])

    rows = stage_table(usable_rows.mapInArrow(fill, "vec_id long, v binary, leaf int"), "leaves")

    # calibration: true neighbours of some queries among all rows, and where in its walk each query meets them
    tests = by_hash(calibration).select("vec_id", "v").toPandas().drop_duplicates("vec_id")
    if not len(tests):
        tests = usable_rows.orderBy("vec_id").limit(1).toPandas()
    asked = spark.sparkContext.broadcast((np.stack(tests["v"].to_numpy()).astype(float), tests["vec_id"].to_numpy()))

    @returns_memory
    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids = asked.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column("v").to_pylist())).reshape(-1, dim)
            row_ids, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            a, c, s = top_pairs(q, ids, x, row_ids, k)
            at = np.argsort(row_ids, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s), pa.array(leaf[at[np.searchsorted(row_ids, c, sorter=at)]])], ["query_id", "vec_id", "score", "leaf"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = rows.mapInArrow(truth, "query_id long, vec_id long, score double, leaf int").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).toPandas()
    leaves = len(tree.leaf)
    met = np.zeros(leaves + 1)
    for query_id, own in best.groupby("query_id"):
        q = tests["v"][tests["vec_id"] == query_id].iloc[0]
        place = {leaf: i for i, leaf in enumerate(tree.visits(np.asarray(q, float), leaves))}
        for leaf in own["leaf"]:
            met[place[leaf] + 1] += 1
    recall = np.cumsum(met) / max(1, met.sum())
    visits = int(np.argmax(recall >= target)) if met.sum() else leaves
    return AnnIndex(tree, max(1, visits), float(recall[max(1, visits)]), rows, dim)


def _bins(index: AnnIndex) -> dict[int, tuple[int, int]]:
    """leaf -> (bin, parts): neighbouring leaves share a bin of about ``PART_ROWS`` rows, a larger leaf is a bin of several parts."""
    counts = sorted((r.leaf, r["count"]) for r in index.rows.groupBy("leaf").count().collect())  # a row a leaf, bounded by the sample
    out: dict[int, tuple[int, int]] = {}
    number, held = 0, 0
    for leaf, n in counts:
        if held and held + n > PART_ROWS:
            number, held = number + 1, 0
        out[leaf] = (number, max(1, -(-n // PART_ROWS)))
        held += n
    return out


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, index: AnnIndex | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    index = index or build_index(vectors, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bins = _bins(index)
    shared, visits = spark.sparkContext.broadcast((index.tree, bins)), index.visits
    kinds = {"query_id": pa.int64(), "q": pa.binary(), "first": pa.bool_(), "bin": pa.int32(), "leaves": pa.list_(pa.int32())}

    @returns_memory
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, where = shared.value
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))
        for b in batches:
            out: list[tuple] = []
            for query_id, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                met: dict[tuple[bool, int], list[int]] = {}
                for i, leaf in enumerate(tree.visits(np.frombuffer(v), visits)):
                    if leaf in where:
                        met.setdefault((i < FIRST_LEAVES, where[leaf][0]), []).append(leaf)
                out += [(query_id, v, first, number, leaves) for (first, number), leaves in met.items()]
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    asked = index.rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").dropDuplicates(["vec_id"])
    walks = stage_table(asked.mapInArrow(walk, "query_id long, q binary, first boolean, bin int, leaves array<int>"), "walks")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda pairs: pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    near = stage_table(best(_meetings(index, bins, walks.where("first").withColumn("bound", F.lit(-math.inf)), k)), "near")
    bounds = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(-math.inf)).alias("bound"))
    rest = walks.where("not first").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-math.inf)))
    found = near.drop("rank").unionByName(_meetings(index, bins, rest, k))
    return best(found).select("query_id", "rank", "vec_id", "score")


def _meetings(index: AnnIndex, bins: dict[int, tuple[int, int]], walks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest rows of each bin that reach the bound, for ``walks`` (query_id, q, bin, leaves, bound)."""
    spark, dim = walks.sparkSession, index.dim
    plan = spark.createDataFrame([(leaf, b, parts) for leaf, (b, parts) in bins.items()], "leaf int, bin int, parts int")
    parts = {b: p for b, p in bins.values()}
    lots = {r.bin: -(-r["count"] // PART_ROWS) for r in walks.groupBy("bin").count().collect()}  # a row a bin
    deal = F.broadcast(spark.createDataFrame([(b, parts[b], n) for b, n in lots.items()], "bin int, parts int, lots int"))
    rows = index.rows.join(F.broadcast(plan.select("leaf", "bin")), "leaf").join(deal, "bin").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    queries = walks.join(deal, "bin").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            x, ids, leaf = np.frombuffer(b"".join(left["v"])).reshape(-1, dim), left["vec_id"].to_numpy(), left["leaf"].to_numpy()
            q, asked, bound = np.frombuffer(b"".join(right["q"])).reshape(-1, dim), right["query_id"].to_numpy(), right["bound"].to_numpy()
            wanted = np.concatenate([np.asarray(leaves) for leaves in right["leaves"]])
            asker = np.repeat(np.arange(len(right)), [len(leaves) for leaves in right["leaves"]])
            for one in np.unique(wanted):
                at, own = asker[wanted == one], leaf == one
                if own.any():
                    for c, v in zip((a, b, s), top_pairs(q[at], asked[at], x[own], ids[own], k, bound[at]), strict=True):
                        c.append(v)
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        return pd.DataFrame({"query_id": a[keep], "vec_id": b[keep], "score": s[keep]})

    keys = ["bin", "part", "lot"]
    rows, queries = rows.select(*keys, "leaf", "vec_id", "v"), queries.select(*keys, "query_id", "q", "leaves", "bound")
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")

"""Quality: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated probabilities.

Every unit (a word in lower case, a run of signs, and the shape of either) has a fixed sparse random index vector, drawn
from a hash of its name. A unit's word vector is the sum of the index vectors of its neighbours in the sample. Documents
are the frequency-weighted means of their units' vectors beside a few length and repetition measures; unknown words are
pooled by shape. The network is trained by plain gradient steps, and a temperature fitted on rows kept from training makes
its outputs probabilities.

Defined results: null and empty texts are scored from the empty pool; texts of any length are pooled whole; rows with equal
ids are scored each on its own; units of equal frequency are taken in order of their spelling; ids may have any type; other
columns are ignored whatever their names; an empty table gives an empty result; without labels of both classes every score
is the share of good labels (1 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, returns_memory, stage_table, text_batches

DIM, NONZERO, WINDOW = 96, 6, 2

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def shape(token: str) -> str:
    """A coarse class: case and size of words, numbers, the sign of runs."""
    if token.isalpha():
        size = "1" if len(token) < 3 else "2" if len(token) < 8 else "3" if len(token) < 16 else "4"
        return ("<U" if token.isupper() and len(token) > 1 else "<T" if token[0].isupper() else "<l" if token.islower() else "<m") + size
    if token.isdigit():
        return f"<d{min(len(token), 4)}"
    return f"<s{token[0]}{min(len(token), 3)}"


def index_vector(unit: str) -> np.ndarray:
    """Sparse ternary vector from a hash of the name, the same in every process."""
    r = np.random.default_rng(xxhash.xxh3_64_intdigest(unit))
    v = np.zeros(DIM, np.float32)
    v[r.choice(DIM, NONZERO, replace=False)] = r.choice([-1.0, 1.0], NONZERO)
    return v


@dataclass
class QualityModel:
    units: dict[str, int]
    vectors: np.ndarray  # a row for each unit
    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    scale: np.ndarray
    temperature: float
    prior: float

    def pool(self, text: str | None) -> np.ndarray:
        return pool(text, self.units, self.vectors)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(_logits((x - self.mean) / self.scale, self.layers) / self.temperature, -30, 30)))


def pool(text: str | None, units: dict[str, int], vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the words, mean vector of the shapes, and length and repetition measures."""
    counts = Counter(tokens(text)) if text else Counter()
    out = np.zeros(2 * DIM + 6, np.float32)
    total = sum(counts.values())
    if total:
        words, shapes = [], Counter()
        for t, n in counts.items():
            if (i := units.get(t.lower())) is not None:
                words.append((i, n))
            shapes[shape(t)] += n
        if words:
            ids, n = np.array(words).T
            out[:DIM] = n.astype(np.float32) @ vectors[ids] / total
        kinds = [(units[s], n) for s, n in shapes.items() if s in units]
        if kinds:
            ids, n = np.array(kinds).T
            out[DIM : 2 * DIM] = n.astype(np.float32) @ vectors[ids] / total
        lines = [x for x in text.split("\n") if x]
        out[2 * DIM :] = math.log1p(total), len(counts) / total, counts.most_common(1)[0][1] / total, len(set(lines)) / max(1, len(lines)), math.log1p(len(text) / total), math.log1p(len(lines))
    return out


def _logits(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    (w1, b1), (w2, b2) = layers
    return (np.maximum(x @ w1 + b1, 0) @ w2 + b2)[:, 0]


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 120, decay: float = 1e-3, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two layers, Adam, log loss."""
    r = np.random.default_rng(seed)
    params = [r.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, math.sqrt(1 / hidden), (hidden, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    batch = min(256, len(x))
    for _ in range(epochs):
        order = r.permutation(len(x))
        for at in range(0, len(x) - batch + 1, batch):
            xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
            h = np.maximum(xb @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip((h @ params[2] + params[3])[:, 0], -30, 30)))
            g = ((p - yb) / batch)[:, None]
            back = (g @ params[2].T) * (h > 0)
            grads = [xb.T @ back + decay * params[0], back.sum(0), h.T @ g + decay * params[2], g.sum(0)]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                params[k] = params[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return [(params[0], params[1]), (params[2], params[3])]


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that gives the least log loss, by golden sections on a log scale."""
    loss = lambda t: float(np.mean(np.logaddexp(0, -(2 * y - 1) * z / math.exp(t))))
    lo, hi, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def _unit_counts(sample: DataFrame) -> DataFrame:
    @returns_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for b in batches:
            for t in b.column("text"):
                if t := t.as_py():
                    own = set(tokens(t))
                    found.update({x.lower() for x in own} | {shape(x) for x in own})
                    if len(found) > 150_000:
                        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["u", "n"])
                        found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["u", "n"])

    return sample.select("text").mapInArrow(count, "u string, n long").groupBy("u").agg(F.sum("n").alias("n"))


def _context_sums(sample: DataFrame, units: dict[str, int]) -> np.ndarray:
    """Random indexing over the sample: for each unit the sum of its neighbours' index vectors. One matrix a task."""
    index = np.stack([index_vector(u) for u in units]) if units else np.zeros((0, DIM), np.float32)
    shared = sample.sparkSession.sparkContext.broadcast((units, index))

    @returns_memory
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vec = shared.value
        out, size = np.zeros((len(known), DIM), np.float64), 0
        for b in batches:
            for t in b.column("text"):
                if not (t := t.as_py()):
                    continue
                found = tokens(t)
                words = np.array([known.get(x.lower(), -1) for x in found], np.int64)
                kinds = np.array([known.get(shape(x), -1) for x in found], np.int64)
                for d in range(1, WINDOW + 1):
                    for a, c in ((words[:-d], words[d:]), (words[d:], words[:-d]), (kinds[:-d], kinds[d:]), (kinds[d:], kinds[:-d])):
                        ok = (a >= 0) & (c >= 0)
                        pairs, n = np.unique(a[ok] * len(known) + c[ok], return_counts=True)
                        np.add.at(out, pairs // len(known), vec[pairs % len(known)] * n[:, None])
                size += 1
        if size:
            rows = np.flatnonzero(np.abs(out).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(out[rows]), pa.list_(pa.float64()))], ["i", "v"])

    parts = sample.select("text").mapInArrow(add, "i long, v array<double>")
    summed = parts.groupBy("i").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(DIM)])
    found = summed.toPandas()  # a row of DIM numbers for each of the bounded units
    out = np.zeros((len(units), DIM), np.float64)
    if len(found):
        out[found["i"].to_numpy()] = found[[f"v{k}" for k in range(DIM)]].to_numpy()
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = 12_000, vocabulary: int = 4_000) -> QualityModel:
    """Learn from at most about ``bound`` labelled rows outside the held-out fifth.

    ``vocabulary`` bounds the units: the most frequent ones that at least 3 of the rows hold. Other words are pooled by shape.
    """
    sample = stage_table(labelled_sample(docs, labels, "quality", bound).select("doc_id", "text", F.col("y").cast("int").alias("y")), "quality_sample")
    found = _unit_counts(sample).where(F.col("n") >= 3).orderBy(F.desc("n"), "u").limit(vocabulary).collect()
    units = {r.u: i for i, r in enumerate(found)}
    vectors = _context_sums(sample, units)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)
    own = np.stack([index_vector(u) for u in units]) if units else np.zeros((0, DIM), np.float32)
    vectors = vectors + own / math.sqrt(NONZERO)  # a unit's own index vector keeps units with like neighbours apart
    shared = sample.sparkSession.sparkContext.broadcast((units, vectors))

    @returns_memory
    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pool(t.as_py(), *shared.value).astype(np.float32) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    out = T.StructType([sample.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType()))])
    rows = sample.mapInArrow(pooled, out).orderBy("doc_id").toPandas()  # vectors of the bounded sample
    y = rows["y"].to_numpy(float) if len(rows) else np.zeros(0)
    prior = float(y.mean()) if len(y) else 1.0
    if len(y) < 10 or prior in (0.0, 1.0):
        return QualityModel(units, vectors, [], np.zeros(1), np.ones(1), 1.0, prior)
    x = np.stack(rows["x"].to_numpy()).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    kept = np.arange(len(x)) % 5 == 0  # for the temperature only
    layers = train_network(x[~kept], y[~kept])
    temperature = fit_temperature(_logits(x[kept], layers), y[kept])
    return QualityModel(units, vectors, layers, mean, scale, max(temperature, 0.2), prior)


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1, the probability of good quality) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                x = np.stack([own.pool(t.as_py()) for t in part.column("text")]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.scores(x), pa.float64())], ["doc_id", "score"])

    return text_batches(docs).select("doc_id", "text").mapInArrow(run, out)

"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

The lexicon is learnt: beginnings of words (and whole words) that stand in clearly more toxic than clean labelled
documents, weighted by their log odds. Texts are folded first: lower case, look-alike letters of other scripts and digits
or signs between letters become the letters they stand for. A hit inside an exception phrase (given, or learnt as a word
pair that clean documents use) doesn't count. The sum of the weights, plain and per square root of the words, goes through
a logistic curve fitted on the same bounded sample.

Defined results: null and empty texts score as texts without hits; texts of any length are folded and matched whole, in time
in proportion to their length; rows with equal ids are scored each on its own; where several entries begin at one place the
heaviest counts, and features of equal evidence are taken in order of their spelling; other columns are ignored whatever their
names; an empty table gives an empty result; without any toxic label every score is the curve's floor, below one half.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, returns_memory, stage_table, text_batches

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ɡ": "g", "ո": "n", "ս": "u",
    }
)
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})

_OBFUSCATED = re.compile(r"[^\W\d_](?:[013457@$]+[^\W\d_]+)+|(?<!\S)[1450@$]+[^\W\d_]+(?:[013457@$]+[^\W\d_]+)*")
_OTHER_SCRIPT = re.compile("[\u0250-\u02af\u0370-\u052f\u0531-\u058f]")
#: Full-width, mathematical and circled letters, and characters without width.
_STYLED = re.compile("[\u2100-\u214f\u2460-\u24ff\uff00-\uffef\U0001d400-\U0001d7ff\u200b-\u200f\u2060\ufeff\u00ad]")
_NO_WIDTH = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_GAPS = re.compile(r"[^\w]+|_+")

#: Phrases in which a lexicon word is harmless, before any are learnt.
EXCEPTIONS = ("trash can", "clown fish", "kill time", "killer whale")

PREFIXES = (4, 5, 6, 7, 8)


def fold(text: str) -> str:
    """Lower case, look-alikes resolved, words apart by single spaces, a space at both ends."""
    if not text.isascii() and _STYLED.search(text):
        text = unicodedata.normalize("NFKC", _NO_WIDTH.sub("", text))
    low = text.lower()
    if not low.isascii() and _OTHER_SCRIPT.search(low):
        low = low.translate(HOMOGLYPHS)
    low = _OBFUSCATED.sub(lambda m: m[0].translate(SUBSTITUTES), low)
    return f" {_GAPS.sub(' ', low).strip()} "


def features(folded: str) -> set[str]:
    """Whole words, closed by a space, and their beginnings; each opens with a space."""
    words = set(folded.split())
    out = {f" {w} " for w in words if 2 <= len(w) <= 32}
    for n in PREFIXES:
        out |= {f" {w[:n]}" for w in words if len(w) > n}
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-3.0, 1.0, 1.0)
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for w, weight in self.weights.items():
                self._machine.add_word(w, (len(w), weight))
            for phrase in self.exceptions:
                self._machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> tuple[float, int]:
        """Sum of weights outside exception phrases, the best entry for each word; number of words."""
        words = max(1, folded.count(" ") - 1)
        machine = self.machine()
        if not len(machine):
            return 0.0, words
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(folded):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        if not free:
            return sum(best.values()), words
        # hits and exceptions by place: a hit is free if an exception that began no later reaches over it
        free.sort()
        total, reach, at = 0.0, -1, 0
        for start, weight in sorted(best.items()):
            while at < len(free) and free[at][0] <= start:
                reach = max(reach, free[at][1])
                at += 1
            if start >= reach:
                total += weight
        return total, words

    def inputs(self, text: str | None) -> tuple[float, float]:
        total, words = self.hits(fold(text)) if text else (0.0, 1)
        return math.log1p(total), math.log1p(total / math.sqrt(words))

    def score(self, text: str | None) -> float:
        a, b = self.inputs(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, floor: bool = True) -> tuple[float, ...]:
    """Newton steps for a small logistic regression; slopes are kept from going below 0 if ``floor``."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    keep = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + keep, x1.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    if floor:
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def _g2(a: float, n: float, b: float, m: float) -> float:
    """Log-likelihood ratio of a of n against b of m."""
    p = (a + b) / (n + m)
    part = lambda k, of, q: (k * math.log(k / of / q) if k else 0.0) + ((of - k) * math.log((1 - k / of) / (1 - q)) if of > k else 0.0)
    return 2 * (part(a, n, p) + part(b, m, p)) if 0 < p < 1 else 0.0


def _counted(sample: DataFrame, y: int, known: frozenset[str] | None, entries: frozenset[str] | None = None) -> DataFrame:
    """Documents of class ``y`` that hold each feature; only ``known`` ones, and word pairs around ``entries``, if given."""
    longest = max(map(len, entries), default=0) if entries else 0

    def hit(word: str) -> bool:
        """Is there an entry for the word, or for a beginning of it?"""
        spaced = f" {word} "
        return any(spaced[:k] in entries for k in range(2, min(len(spaced), longest) + 1))

    @returns_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for b in batches:
            for t in b.column("text"):
                if t := t.as_py():
                    folded = fold(t)
                    own = features(folded)
                    if entries is not None:
                        words = folded.split()
                        hits = {w for w in set(words) if hit(w)}
                        own = {f"{u} {v}" for u, v in zip(words, words[1:], strict=False) if u in hits or v in hits} if hits else set()
                    found.update(own if known is None else own & known)
                    if len(found) > 150_000:  # partial counts add up later
                        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["f", "n"])
                        found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["f", "n"])

    return sample.where(F.col("y") == y).select("text").mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 20_000, lexicon_size: int = 2_000, min_evidence: float = 20.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Learn lexicon, exceptions and curve from at most about ``bound`` labelled rows outside the held-out fifth.

    ``lexicon_size`` bounds the lexicon and the learnt exceptions, and 50 times as many features, the most frequent in toxic
    rows, are candidates; ``min_evidence`` is the least log-likelihood ratio of an entry.
    """
    sample = stage_table(labelled_sample(docs, labels, "toxic", bound).select("text", F.col("y").cast("int").alias("y")), "toxicity_sample")
    size = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n, m = size.get(1, 0), size.get(0, 0)
    if not n:
        return ToxicityModel({}, exceptions)
    # what too few toxic documents hold can't reach the evidence even if no clean one holds it
    least = next((k for k in range(2, n + 1) if _g2(k, n, 0, max(m, 1)) >= min_evidence), n)
    toxic = {r.f: r.n for r in _counted(sample, 1, None).where(F.col("n") >= least).orderBy(F.desc("n"), "f").limit(50 * lexicon_size).collect()}
    clean = {r.f: r.n for r in _counted(sample, 0, frozenset(toxic)).collect()} if m else {}
    entries = {}
    for f, a in toxic.items():
        b = clean.get(f, 0)
        weight = math.log((a + 0.5) / (n + 1)) - math.log((b + 0.5) / (m + 1))
        if weight >= 2.0 and _g2(a, n, b, max(m, 1)) >= min_evidence:
            entries[f] = weight
    chosen: dict[str, float] = {}
    for f, weight in sorted(entries.items(), key=lambda x: (len(x[0]), x[0])):  # an entry stands for its longer forms unless they are clearly worse
        if not any(f[:k] in chosen and chosen[f[:k]] >= weight - 1.0 for k in range(3, len(f))):
            chosen[f] = weight
    chosen = dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size])

    stems = frozenset(chosen)
    around = {r.f: r.n for r in _counted(sample, 0, None, stems).where(F.col("n") >= 3).orderBy(F.desc("n"), "f").limit(lexicon_size).collect()} if m and stems else {}
    if around:
        also = {r.f: r.n for r in _counted(sample, 1, frozenset(around), stems).collect()}
        exceptions = (*exceptions, *(f for f, b in sorted(around.items()) if b / m > 4 * (also.get(f, 0) + 0.5) / n))
    model = ToxicityModel(chosen, tuple(dict.fromkeys(exceptions)))

    @returns_memory
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.inputs(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([c for _, c in x], pa.float64()), b.column("y")], ["a", "b", "y"])

    rows = sample.select("text", "y").mapInArrow(inputs, "a double, b double, y int").toPandas()  # three numbers a row of the bounded sample
    model.curve = fit_logistic(rows[["a", "b"]].to_numpy(), rows["y"].to_numpy(float))
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.score(t.as_py()) for t in b.column("text")], pa.float64())], ["doc_id", "score"])

    return text_batches(docs).select("doc_id", "text").mapInArrow(run, out)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(text):
        own = shared.value
        return text.map(lambda t: own.score(t if isinstance(t, str) else None))

    return text_batches(docs).where(score("text") < threshold)

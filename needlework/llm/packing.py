"""Best-fit packing: a configuration linear program over the length histogram decides how sequences are filled.

Documents become token ids, an end id is added, and only what is longer than a sequence is cut. What has to be packed is
then a histogram of at most ``capacity`` lengths, however many documents there are. The program

    least number of sequences such that every length is covered, over all fillings of one sequence

is solved on the driver by multiplicative weights. A length's price is its share of a sequence times the weight of its class
of lengths (weights are interpolated between classes). Each round prices fillings by a bounded knapsack dynamic program over
all lengths; the demand at these prices, divided by the dearest filling, bounds the program's value from below, and the best
such bound is kept. The fillings within a slack of the dearest one are mixed so that they cover the classes as evenly as they
can; weights of classes that stay behind rise, those of classes that are ahead fall, and the weights of the rounds are averaged.
Then the program is rounded: rounds go on over what is left, and each uses the fillings at its prices whole times, a share of
each length's rest at a time. The last rest is packed best fit, longest first, in runs of equal sequences. The result says how
many sequences it takes and the lower bound, so the gap is known.

Pieces get their places by rank: a filling used x times takes x ranks of each of its lengths, so a piece needs only its rank
among its equals. Ranks are counted in bounded groups, so a length that a third of all pieces share is no hot key.

Defined results: a null or empty text is one piece of the end id; a very long text is cut into pieces of the capacity, and no
text is too long; repeated rows are packed each on its own, and equal lengths in whatever order; null ids are kept; other columns
are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import returns_memory, stage_table, text_batches
from .tokens import WordBpe

CAPACITY = 4096

_log = logging.getLogger(__name__)

#: Rows of one rank group at most, about, in large inputs; smaller ones have groups of a 512th of their rows, 500 at least.
GROUP_ROWS = 20_000


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, on request) of every piece."""
    fields = [docs.schema["doc_id"], *[T.StructField(c, T.LongType() if c != "piece" else T.IntegerType()) for c in ("piece", "start", "length", "ids_crc32")]]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids

    @returns_memory
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(tokenizer_path)
        for b in batches:
            take, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, t in enumerate(b.column("text")):
                ids = np.append(bpe.encode(t.as_py()), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    take.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int64))
            columns = [b.column("doc_id").take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(kept, pa.list_(pa.int64()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return text_batches(docs).select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


class Knapsack:
    """Fillings of greatest price for every room, by dynamic programming over the bounded ``counts`` of each length.

    A length that fits several times is taken in lots of 1, 2, 4, ..., so that each lot is one vector step.
    """

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths = lengths
        self.lots: list[tuple[int, int, int]] = []  # (length's place, how many, size)
        for i, (n, most) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
            most, lot = min(int(most), capacity // n), 1
            while most > 0:
                lot = min(lot, most)
                self.lots.append((i, lot, n * lot))
                most -= lot
                lot *= 2
        self.best = np.zeros(capacity + 1)
        self.took = np.zeros((len(self.lots), capacity + 1), bool)
        for row, (i, lot, size) in zip(self.took, self.lots, strict=True):
            value = self.best[:-size] + prices[i] * lot
            np.greater(value, self.best[size:], out=row[size:])
            np.copyto(self.best[size:], value, where=row[size:])

    def fillings(self, rooms: np.ndarray) -> np.ndarray:
        """How many of each length the dearest filling of each room has, a row a room."""
        out, room = np.zeros((len(rooms), len(self.lengths)), np.int16), rooms.copy()
        for row, (i, lot, size) in zip(self.took[::-1], self.lots[::-1], strict=True):
            if len(at := np.flatnonzero(row.take(room))):
                out[at, i] += lot
                room[at] -= size
        return out


def price(lengths: np.ndarray, gains: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest filling of one sequence."""
    one = Knapsack(lengths, gains, counts, capacity).fillings(np.array([capacity]))[0]
    return {int(lengths[i]): int(one[i]) for i in np.flatnonzero(one)}


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of (length, how many): (filling, times), in runs of sequences that are alike."""
    room: list[tuple[int, int]] = []  # (free, run), sorted
    runs: list[tuple[dict[int, int], int]] = []

    def add(filling: dict[int, int], length: int, k: int, free: int, times: int) -> None:
        runs.append((filling | {length: k}, times))
        if free:
            insort(room, (free, len(runs) - 1))

    for length, n in sorted(items, reverse=True):
        while n:
            at = bisect_left(room, (length, -1))
            if at == len(room):
                free, filling, times = capacity, {}, n
            else:
                free, run = room.pop(at)
                filling, times = runs[run]
                runs[run] = (filling, 0)
            each = free // length  # the fullest sequence goes on being the best until it is full
            whole = min(times, n // each)
            if whole:
                add(filling, length, each, free - each * length, whole)
                n -= whole * each
            if whole < times and 0 < n < each:
                add(filling, length, n, free - n * length, 1)
                n, whole = 0, whole + 1
            if whole < times and filling:  # what was not needed stays as it was
                runs.append((filling, times - whole))
                insort(room, (free, len(runs) - 1))
    return [(f, x) for f, x in runs if x]


#: Classes of lengths that have a weight; rounds that learn the weights, the more the fewer lengths there are; rounds of use at most.
CLASSES, LEARN, USE = 32, (30, 300), (60, 300)
#: Lengths times rounds, about.
EFFORT = 60_000
#: Fillings are used if their price is within this of the dearest one's.
SLACK = 0.02


@dataclass
class Solution:
    """Fillings with whole numbers of uses that take all of a histogram, and the least number of sequences that any packing needs."""

    fillings: list[tuple[dict[int, int], int]]
    bound: float

    @property
    def sequences(self) -> int:
        return sum(x for _, x in self.fillings)

    @property
    def gap(self) -> float:
        return self.sequences / self.bound - 1 if self.bound else 0.0


def configurations(counts: np.ndarray, capacity: int, rate: float = 0.1, slack: float = SLACK, classes: int = CLASSES) -> Solution:
    """Solve the configuration program of a histogram (``counts`` by length) by multiplicative weights, and round it.

    ``rate`` is the step of the weights: with 0 they stay at 1 and prices in proportion to lengths.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(np.int64)
    m = len(lengths)
    if not m:
        return Solution([], 0.0)
    learn, use = (min(most, max(least, EFFORT // m)) for least, most in (LEARN, USE))
    share = 20 / use  # of what is left of a length, each round uses so much for a filling
    # classes of about equal volume
    volume = np.cumsum(lengths * need)
    of = np.unique(np.minimum((volume - lengths * need / 2) * classes // volume[-1], classes - 1), return_inverse=True)[1]
    classes = int(of.max()) + 1
    demand = np.bincount(of, need, classes)
    centre = np.bincount(of, need * lengths, classes) / demand
    member = np.zeros((m, classes))
    member[np.arange(m), of] = 1
    prices = lambda logs: lengths / capacity * np.exp(np.interp(lengths, centre, logs))
    step = lambda logs, gain, by: logs - by * (np.clip(gain, 0, 3) - 1)

    logs, bound, covered = np.zeros(classes), 0.0, np.zeros(m)
    average = logs
    for t in range(learn):
        y = prices(logs)
        solved = Knapsack(lengths, y, need, capacity)
        top = solved.best[capacity]
        bound = max(bound, float(need @ y) / top)
        # a filling for each class, around its length that is covered least, and the dearest one
        order = np.lexsort((covered, of))
        first = order[np.searchsorted(of[order], np.arange(classes))]
        found = solved.fillings(np.append(capacity - lengths[first], capacity)).astype(np.int64)
        found[np.arange(classes), first] += 1
        found = found[(found <= need).all(1) & (found @ y >= (1 - 2 * slack) * top)]
        held = found @ member / demand
        uses = np.ones(len(found))
        for _ in range(30):  # even out what the classes get
            uses *= (held @ (1 / np.maximum(uses @ held, 1e-9))) / np.maximum(held.sum(1), 1e-12)
        uses /= (uses @ (found @ y)) / (need @ y)
        covered += found.T @ uses / need
        logs = step(logs, uses @ held, rate / math.sqrt(t + 1))
        average = average + (logs - average) * min(1.0, 2 / (t + 2))

    logs, left = average, need.copy()
    used: dict[bytes, list] = {}
    for t in range(use):
        if lengths @ left <= capacity:
            break
        y = prices(logs)
        solved = Knapsack(lengths, y, left, capacity)
        top = solved.best[capacity]
        if not t:
            bound = max(bound, float(need @ y) / top)
        start, open_ = left.copy(), np.flatnonzero(left)
        # a filling around each length, of those that are dear enough, the dearest first
        value = y[open_] + solved.best[capacity - lengths[open_]]
        order = np.argsort(-value, kind="stable")
        open_ = open_[order[value[order] >= (1 - slack) * top]]
        found = solved.fillings(capacity - lengths[open_])
        found[np.arange(len(open_)), open_] += 1
        for i in range(len(open_)):
            at = np.flatnonzero(found[i])
            k = found[i][at].astype(np.int64)
            # a share of the rest of the length that the filling was made for
            times = min(int((left[at] // k).min()), -(-math.ceil(start[open_[i]] * share) // int(found[i][open_[i]])))
            if times > 0:
                left[at] -= times * k
                key = at.tobytes() + k.tobytes()
                used.setdefault(key, [dict(zip(lengths[at].tolist(), k.tolist(), strict=True)), 0])[1] += times
        if (left == start).all():
            break
        rest = np.bincount(of, start, classes)
        gain = np.bincount(of, start - left, classes) / np.maximum(rest, 1) / max(1e-12, ((start - left) @ y) / (start @ y))
        logs = step(logs, np.where(rest > 0, gain, 1), 0.3 * rate)
    fillings = [(f, x) for f, x in used.values()]
    fillings += best_fit([(int(n), int(k)) for n, k in zip(lengths, left, strict=True) if k], capacity)
    return Solution(fillings, max(bound, float(lengths @ need) / capacity))


@dataclass
class Packing:
    """Where the r-th piece of each length goes: runs of (length, first rank, first sequence, offset, times).

    A run of ``times`` sequences holds several pieces of a length side by side: ranks go through the sequences first.
    """

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    times: np.ndarray
    sequences: int
    bound: float

    def __post_init__(self) -> None:
        order = np.lexsort((self.first, self.length))
        for f in ("length", "first", "sequence", "offset", "times"):
            setattr(self, f, getattr(self, f)[order])
        self._key = self.length * (1 << 44) + self.first

    @property
    def gap(self) -> float:
        """How far the packing may be above the least number of sequences."""
        return self.sequences / self.bound - 1 if self.bound else 0.0

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._key, length * (1 << 44) + rank, side="right") - 1
        side, run = np.divmod(rank - self.first[at], self.times[at])
        return self.sequence[at] + run, self.offset[at] + side * length


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, rate: float = 0.1) -> Packing:
    """Solve the program for a length histogram, rounded to whole sequences; a row for each length of each filling."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    full, counts[capacity] = int(counts[capacity]), 0
    solved = configurations(counts, capacity, rate)
    rows: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = {}
    sequence = 0
    for filling, times in [({capacity: 1}, full)] * (full > 0) + solved.fillings:
        offset = 0
        for n, k in sorted(filling.items(), reverse=True):
            rows.append((n, rank.get(n, 0), sequence, offset, times))
            rank[n] = rank.get(n, 0) + times * k
            offset += n * k
        sequence += times
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Packing(*columns, sequence, solved.bound + full)


def ranked(pieces: DataFrame, histogram: dict[int, int], group_rows: int | None = None) -> DataFrame:
    """``pieces`` (staged, with ``row_no``) with ``rank``: gapless from 0 among equal lengths, without a group of more than about ``group_rows``.

    Frequent lengths are dealt into groups by a hash of the row number, which tells repeated rows apart, and the groups'
    exact counts turn ranks inside a group into ranks among all. There are at most ``capacity`` + 100,000 groups; beyond
    100,000 times ``GROUP_ROWS`` pieces groups grow.
    """
    spark, total = pieces.sparkSession, sum(histogram.values())
    group_rows = max(group_rows or min(GROUP_ROWS, max(500, total // 512)), total // 100_000)
    groups = spark.createDataFrame([(n, -(-k // group_rows)) for n, k in histogram.items()], "length long, groups long")
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("row_no"), "groups")).drop("groups")
    starts = []
    at: dict[int, int] = {}
    for r in sorted(salted.groupBy("length", "salt").count().toLocalIterator()):
        starts.append((r.length, r.salt, at.get(r.length, 0)))
        at[r.length] = at.get(r.length, 0) + r["count"]
    w = Window.partitionBy("length", "salt").orderBy("row_no")
    numbered = salted.withColumn("rank", F.row_number().over(w) - 1)
    starts_df = spark.createDataFrame(starts, "length long, salt long, first long")
    return numbered.join(F.broadcast(starts_df), ["length", "salt"]).withColumn("rank", F.col("first") + F.col("rank")).drop("salt", "first")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id and offset; see the module for the method.

    ``ids`` are returned on request, so that sequences can be written out by grouping on sequence_id.
    """
    pieces = stage_table(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids).withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = plan_packing(histogram, capacity)
    _log.info("%d sequences, at least %.1f are needed: gap %.4f", plan.sequences, plan.bound, plan.gap)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    names = [c for c in pieces.columns if c != "row_no"]
    out = T.StructType([*(pieces.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @returns_memory
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = shared.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked(pieces, histogram).select(*names, "rank").mapInArrow(place, out)

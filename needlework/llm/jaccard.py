"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds its distinct word shingles. Two documents link when den * intersection >= num * union. Links are
found for classes of equal sets only, and what is returned is each document's component, so copies are never expanded.

1. Order. Shingles are ordered rare first: by a level from bounded sketches of all words and shingles, then by hash. The
   level matters for speed only; any fixed order gives the same links.
2. Index. The first s - ceil(t s) + 1 shingles of a set of size s are its prefix; two linked sets share one. Each entry
   (shingle, set, size) goes to the shingle's list. Lists are cut where sizes lie too far apart to link.
3. Families. Every list of two or more sets hands its sets to the family of its first set, so each pair that shares a
   prefix shingle meets in a family. First only a parity bitmap of each set travels, about two bits a shingle: where two
   bitmaps differ in more bits than the sets' difference may have elements, the pair can't link, and sets without any
   possible partner leave the family. Then the shingles of the rest travel, once for each family that is left.
4. Join inside a family: an index over the family's own rare-first order whose lists are blocks of positions; blocks that
   lie too far back for the required overlap are skipped (index-level skipping). Sets that are in one component already
   are not compared again, and known distances to a highly similar set decide others by the triangle inequality without
   looking at shingles (answer-level skipping, incremental answers). Only links that join components are returned.
5. Large families are cut into parts. Parts are joined by themselves first; afterwards only sets outside the family's
   main component meet the sets of other parts.

Defined results: null texts and texts without words have an empty set, no links, and are their own component; texts with
fewer words than a shingle are one shingle; texts of any length give all their shingles; repeated rows and equal ids are one
node, which has the links of all its texts; rows without an id take the smallest id among equal sets, null if there is none,
and link no other sets; lists, families and links don't depend on the order of rows; other columns are ignored whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, join_classes, maybe_broadcast, returns_memory, stage_table, text_batches
from .components import connected_components

SKETCH_BITS = 18
CELLS = 1 << SKETCH_BITS
#: Level of shingles that are expected once; levels below tell rarer ones apart, down to 2^-RARE.
RARE = 28
#: Lists that may be longer than this are led by an aggregation and a join instead of a window.
LONG_LIST = 1 << 14

_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None, memory: _WordHashes) -> np.ndarray:
    """Hashes of the words of a text in A-Z lower case, cut at ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(memory.__getitem__, found), np.uint64, len(found))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles in order of place; of the whole sequence if it has fewer words."""
    n = min(n, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _MULTIPLIERS[k]
    return _mixed(out)


def shingle_set(text: str | None, n: int, memory: _WordHashes) -> np.ndarray:
    return np.unique(shingles(word_hashes(text, memory), n))


@dataclass
class Order:
    """What the sketches say: how frequent words are, how far shingles exceed the mean, and whether lists may be long."""

    word_log: np.ndarray
    shingle_level: np.ndarray
    long_list: np.ndarray
    log_total: float

    def levels(self, words: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """A small number for each shingle, about the logarithm of its expected or seen frequency; 0 is rare."""
        n = min(n, len(words))
        logs = self.word_log[(words >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        # expected count if words met at random, in powers of two
        expected = np.full(len(hashes), self.log_total, np.float32)
        for k in range(n):
            expected += logs[k : len(words) - n + 1 + k]
        by_words = np.clip(np.ceil(expected / math.log(2)) + RARE, 0, 63).astype(np.uint8)
        return np.maximum(by_words, self.shingle_level[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])


def corpus_order(docs: DataFrame, n: int) -> Order:
    """Count all words and shingles of all documents into two tables of fixed size."""

    @returns_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, cells = _WordHashes(), np.zeros(2 * CELLS, np.int64)
        shift = np.uint64(64 - SKETCH_BITS)
        for b in batches:
            held: list[np.ndarray] = []
            for t in b.column("text"):
                words = word_hashes(t.as_py(), memory)
                if len(words):
                    held += [(words >> shift).astype(np.int32), (np.unique(shingles(words, n)) >> shift).astype(np.int32) + CELLS]
                if len(held) >= 1000:
                    cells += np.bincount(np.concatenate(held), minlength=2 * CELLS)
                    held = []
            if held:
                cells += np.bincount(np.concatenate(held), minlength=2 * CELLS)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    summed = text_batches(docs).select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = summed.toPandas()  # 2 * CELLS rows at most
    cells = np.zeros(2 * CELLS, np.float64)
    cells[found["cell"].to_numpy()] = found["n"].to_numpy()
    words, seen = cells[:CELLS], cells[CELLS:]
    mean = seen.sum() / CELLS
    above = seen - mean
    level = np.where(above > 6 * math.sqrt(mean) + 16, np.clip(np.ceil(np.log2(np.maximum(above, 1))) + RARE, 0, 63), 0)
    return Order(np.log(np.maximum(words, 1) / max(words.sum(), 1)).astype(np.float32), level.astype(np.uint8), seen > LONG_LIST, math.log(max(seen.sum(), 1)))


def prefix_size(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """For each of 2^b cells, at least 64 and one a shingle, whether an odd number of shingles falls into it."""
    cells = max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possible_partners(sizes: np.ndarray, bitmaps: list[bytes], num: int, den: int) -> np.ndarray:
    """Which sets of a family may link with another one: sizes and bitmaps of some pair allow it."""
    out = np.zeros(len(sizes), bool)
    widths = np.array([len(b) for b in bitmaps])
    rows = {w: np.flatnonzero(widths == w) for w in np.unique(widths)}
    bits = {w: np.frombuffer(b"".join(bitmaps[i] for i in at), np.uint64).reshape(len(at), -1) for w, at in rows.items()}
    for wide, at in rows.items():
        for narrow, other in rows.items():
            if narrow > wide or sizes[other].max() * den < num * sizes[at].min():
                continue
            mine = bits[wide]
            while mine.shape[1] > bits[narrow].shape[1]:  # a coarser bitmap is the exclusive or of the halves
                mine = mine[:, : mine.shape[1] // 2] ^ mine[:, mine.shape[1] // 2 :]
            for k, i in enumerate(at.tolist()):
                small, large = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
                near = np.flatnonzero((small * den >= num * large) & (other != i))
                if len(near):
                    differ = np.bitwise_count(bits[narrow][near] ^ mine[k]).sum(1, dtype=np.int64)
                    ok = near[differ * (den + num) <= (den - num) * (sizes[i] + sizes[other[near]])]
                    out[other[ok]] = True
                    out[i] |= len(ok) > 0
    return out


def signatures(docs: DataFrame, n: int, num: int, den: int, order: Order) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and its prefix, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    out = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("fp1", T.LongType()),
            T.StructField("fp2", T.LongType()),
            T.StructField("prefix", T.ArrayType(T.LongType())),
            T.StructField("long_list", T.ArrayType(T.BooleanType())),
            T.StructField("bitmap", T.BinaryType()),
        ]
    )

    @returns_memory
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = shared.value, _WordHashes()
        for b in batches:
            sizes, fp1, fp2, prefixes, hot, bitmaps = [], [], [], [], [], []
            for t in b.column("text"):
                words = word_hashes(t.as_py(), memory)
                hashes, first = np.unique(placed := shingles(words, n), return_index=True)
                size = len(hashes)
                sizes.append(size)
                if not size:
                    fp1.append(None)
                    fp2.append(None)
                    prefixes.append(np.zeros(0, np.int64))
                    hot.append(np.zeros(0, bool))
                    bitmaps.append(b"")
                    continue
                fp1.append(int(hashes.sum(dtype=np.uint64).view(np.int64)))
                fp2.append(int(np.bitwise_xor.reduce(_mixed(hashes * _MULTIPLIERS[-1])).view(np.int64)))
                rank = np.argsort(own.levels(words, placed, n)[first], kind="stable")[: prefix_size(size, num, den)]
                chosen = hashes[rank]
                prefixes.append(chosen.view(np.int64))
                hot.append(own.long_list[(chosen >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])
                bitmaps.append(parity_bitmap(hashes))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.bool_())), pa.array(bitmaps, pa.binary())],
                [f.name for f in out.fields],
            )

    return text_batches(docs).select("doc_id", "text").mapInArrow(sign, out)


class _Components:
    """Labels of sets with relabelling; families are bounded, so this stays cheap."""

    def __init__(self, labels: np.ndarray):
        self.of = labels.copy()

    def join(self, a: int, b: int) -> bool:
        x, y = self.of[a], self.of[b]
        if x == y:
            return False
        self.of[self.of == max(x, y)] = min(x, y)
        return True


def family_links(sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None, block: int = 8, max_anchors: int = 8) -> list[tuple[int, int]]:
    """Pairs (i, j) of ``sets`` that link and join two components; ``labels`` are components known before."""
    n = len(sets)
    comp = _Components(np.arange(n) if labels is None else labels)
    if n == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if comp.of[0] != comp.of[1] and den * both >= num * (len(a) + len(b) - both) else []
    sizes = np.array([len(s) for s in sets])
    # the family's own order: rare first, so that prefixes hold what few of its sets share
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    alone = int((df == 1).sum())  # ranks below have one holder
    flat = rank[ids]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(n):
        flat[starts[i] : starts[i + 1]].sort()
    mark = np.zeros(len(df), bool)

    def overlaps(a: int, others: np.ndarray) -> np.ndarray:
        own = flat[starts[a] : starts[a + 1]]
        mark[own] = True
        ends = np.cumsum(sizes[others])
        at = np.arange(ends[-1]) + np.repeat(starts[others] - (ends - sizes[others]), sizes[others])
        out = np.add.reduceat(mark[flat[at]].astype(np.int64), ends - sizes[others])
        mark[own] = False
        return out

    limit = 1 - num / den
    anchors: list[np.ndarray] = []  # distances of all sets to a set with computed answers
    anchored: set[int] = set()
    index: dict[int, dict[int, list[int]]] = {}
    links = []
    for a in np.lexsort((np.arange(n), sizes)).tolist():
        size = int(sizes[a])
        if not size:
            continue
        prefix = flat[starts[a] : starts[a] + prefix_size(size, num, den)].tolist()
        # |A| + |B| - 2 overlap <= (den - num) / (den + num) * (|A| + |B|), and |B| <= |A| here
        slack = (den - num) * 2 * size // (den + num)
        found: set[int] = set()
        for pos, e in enumerate(prefix):
            if e < alone or e not in index:
                continue
            for k, entries in index[e].items():
                if k * block + pos <= slack:
                    found.update(entries)
        if found:
            others = np.fromiter(found, np.int64, len(found))
            others = others[(sizes[others] * den >= num * size) & (comp.of[others] != comp.of[a])]
            for dist in anchors:
                if not len(others):
                    break
                near = others[dist[others] + dist[a] <= limit - 1e-9]
                for b in near.tolist():
                    if comp.join(a, b):
                        links.append((a, b))
                others = others[(np.abs(dist[others] - dist[a]) <= limit + 1e-9) & (comp.of[others] != comp.of[a])]
            if len(others):
                both = overlaps(a, others)
                hit = others[den * both >= num * (size + sizes[others] - both)]
                for b in hit.tolist():
                    if comp.join(a, b):
                        links.append((a, b))
                if len(hit) and len(anchors) < max_anchors and n > 16 and not any(int(b) in anchored for b in hit):
                    r = int(hit[0])  # its answers become known to all
                    every = np.flatnonzero(sizes > 0)
                    both = overlaps(r, every)
                    dist = np.ones(n)
                    dist[every] = 1 - both / (sizes[r] + sizes[every] - both)
                    anchors.append(dist)
                    anchored.update(np.flatnonzero(dist <= limit).tolist())
        for pos, e in enumerate(prefix):
            if e >= alone:
                index.setdefault(e, {}).setdefault(pos // block, []).append(a)
    return links


def _lists(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, member, size) of every list that holds two or more sets of like size; a leader is a member too."""
    w = Window.partitionBy("w").orderBy("size", "rep")
    before = F.lag("size").over(w)
    short = entries.where("not hot").withColumn("first", F.when(before.isNull() | (before * den < F.col("size") * num), F.col("rep")))
    short = short.withColumn("leader", F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    followed = F.lead("rep").over(w).isNotNull() & F.lead("first").over(w).isNull()
    led = short.withColumn("followed", followed).where("leader <> rep or followed").select("leader", F.col("rep").alias("member"), "size")
    hot = entries.where("hot").select("w", "rep", "size")
    least = hot.groupBy("w").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    return led.unionByName(hot.join(least, "w").select("leader", F.col("rep").alias("member"), "size")).distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """The columns of each run of rows that are equal in the first ``keys`` columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        marks = np.zeros(len(b) - 1, bool)
        for c in b.columns[:keys]:
            marks |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        ends = [0, *(np.flatnonzero(marks) + 1).tolist(), len(b)]
        for lo, hi in zip(ends, ends[1:], strict=False):
            key = tuple(c[lo].as_py() for c in b.columns[:keys])
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays(list(c)) for c in zip(*(p.columns for p in parts), strict=True)] if len(parts) > 1 else parts[0].columns


def _with_partners(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (leader, member, size, bitmap) of sets that may link with another one of their family, without bitmaps."""

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for leader, member, size, bitmap in _groups(batches, 1):
            ok = pa.array(possible_partners(size.to_numpy(), bitmap.to_pylist(), num, den))
            if ok.true_count:
                kept.append(pa.RecordBatch.from_arrays([leader, member, size], ["leader", "member", "size"]).filter(ok))
            if len(kept) >= 1000:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept = []
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    dealt = rows.select("leader", "member", "size", "bitmap").repartition("leader").sortWithinPartitions("leader")
    return dealt.mapInArrow(run, "leader long, member long, size long")


def _link_groups(rows: DataFrame, part: str, num: int, den: int) -> DataFrame:
    """Links inside each group (leader, part) of ``rows`` (node, label, shingles); groups are bounded by the caller."""

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for _, _, node, label, sets in _groups(batches, 2):
            nodes, first = np.unique(node.to_numpy(), return_index=True)
            if len(nodes) > 1:
                labels = np.unique(label.to_numpy()[first], return_inverse=True)[1]
                for i, j in family_links([np.frombuffer(sets[k].as_py(), np.uint64) for k in first.tolist()], num, den, labels):
                    a.append(int(nodes[i]))
                    b.append(int(nodes[j]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = rows.select("leader", part, "node", "label", "shingles").repartition("leader", part).sortWithinPartitions("leader", part)
    return dealt.mapInArrow(run, "a long, b long")


def jaccard_classes(docs: DataFrame, signed: DataFrame, n: int, num: int, den: int, part_sets: int, part_shingles: int) -> DataFrame:
    """Components of the classes of equal sets, each known by its smallest id; ``signed`` are the signatures of ``docs``."""
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"))
    reps = signed.join(classes.withColumnRenamed("rep", "doc_id"), ["fp1", "fp2", "doc_id"])
    entries = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), F.explode(F.arrays_zip("prefix", "long_list")).alias("e"))
    entries = entries.select(F.col("e.prefix").alias("w"), "rep", "size", F.col("e.long_list").alias("hot"))
    members = stage_table(_lists(entries, num, den), "members")
    large = F.ceil(F.greatest(F.count("*") / part_sets, F.sum("size") / part_shingles)).cast("int")
    parts = stage_table(members.groupBy("leader").agg(large.alias("parts")).where("parts > 1"), "parts")
    held_back = maybe_broadcast(parts)
    marked = members.join(signed.select(F.col("doc_id").alias("member"), "bitmap"), "member").join(held_back.select("leader"), "leader", "left_anti")
    families = stage_table(_with_partners(marked, num, den).unionByName(members.join(held_back.select("leader"), "leader", "left_semi").select("leader", "member", "size")), "families")

    # the sets of all that is left in some family, from their texts
    wanted = stage_table(families.select(F.col("member").alias("doc_id")).distinct(), "wanted")
    node = T.StructType([docs.schema["doc_id"], T.StructField("shingles", T.BinaryType())])

    @returns_memory
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingle_set(t.as_py(), n, memory).tobytes() for t in b.column("text")], pa.binary())], ["doc_id", "shingles"])

    texts = docs.select("doc_id", "text").join(maybe_broadcast(wanted, BROADCAST_ROWS), "doc_id", "left_semi")
    held = stage_table(texts.mapInArrow(sets, node).select(F.col("doc_id").alias("node"), "shingles"), "sets")
    cut = families.join(held_back, "leader", "left").withColumn("part", F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1))).cast("int"))
    rows = cut.join(held, held.node == cut.member).select("leader", "part", "node", F.col("node").alias("label"), "shingles")
    links = stage_table(_link_groups(rows, "part", num, den), "family_links")

    if parts.limit(1).count():
        known = connected_components(links)
        large = cut.where("parts > 1").join(known.withColumnRenamed("node", "member"), "member", "left").withColumn("label", F.coalesce("root", "member")).drop("root")
        # the main component of a family is the one that most of its sets are in
        main = large.groupBy("leader", "label").count().groupBy("leader").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("n"))
        main = main.select("leader", F.col("m.label").alias("main"), (F.col("n") - F.col("m.count")).alias("rest"), F.ceil(F.col("n") / part_sets).cast("int").alias("blocks"))
        large = large.join(main.where("rest > 0"), "leader").withColumn("outside", F.col("label") != F.col("main"))
        every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        pair = lambda i, j: F.concat_ws(":", i, j)
        mine = F.concat(F.lit("m"), F.pmod(F.xxhash64("member", F.lit(1)), F.col("blocks")))
        with_main = F.transform(every("parts"), lambda i: pair(i.cast("string"), F.col("mine")))
        with_rest = F.transform(every("blocks"), lambda j: pair(F.least(F.col("mine"), F.concat(F.lit("m"), j)), F.greatest(F.col("mine"), F.concat(F.lit("m"), j))))
        for_main = F.transform(every("blocks"), lambda j: pair(F.col("part").cast("string"), F.concat(F.lit("m"), j)))
        large = large.withColumn("mine", mine).withColumn("cell", F.explode(F.when(F.col("outside"), F.concat(with_main, with_rest)).otherwise(for_main)))
        more = large.join(held, held.node == large.member).select("leader", "cell", "node", "label", "shingles")
        links = links.unionByName(stage_table(_link_groups(more, "cell", num, den), "cross_links"))
    return connected_components(links)


def _by_row(docs: DataFrame) -> DataFrame:
    """Staged ``docs`` with ``row_no``, unique and rising with the id, rows without an id last."""
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    placed = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_no", F.monotonically_increasing_id())
    return stage_table(placed, "rows")


def _several_texts(signed: DataFrame) -> bool:
    """Has some id different sets?"""
    sets = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp1").alias("a"), F.max("fp1").alias("b"), F.min("n_shingles").alias("m"), F.max("n_shingles").alias("n"))
    return bool(sets.where("a <> b or m <> n").limit(1).count())


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10, part_sets: int = 4_000, part_shingles: int = 3_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id reachable by links of num/den and more.

    ``part_sets`` and ``part_shingles`` bound what one task holds of a family.
    """
    if not 0 < num <= den or not 1 <= n < 63:
        raise ValueError("0 < num <= den and 1 <= n < 63 are asked for")
    order = corpus_order(docs, n)
    signed = stage_table(signatures(docs, n, num, den, order), "signed")
    if not _several_texts(signed):
        return _components_of(docs, signed, n, num, den, part_sets, part_shingles)
    # every row is a node of its own first; then the rows of one id are tied together
    rows = _by_row(docs.select("doc_id", "text"))
    own = rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row_no")).alias("doc_id"), "text")
    by_row = _components_of(own, stage_table(signatures(own, n, num, den, order), "signed"), n, num, den, part_sets, part_shingles)
    by_row = stage_table(by_row.select(F.col("doc_id").alias("row_no"), "n_shingles", F.col("component_id").alias("root")), "by_row")
    unnamed = by_row.where("row_no is null").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_shingles", "root")
    found = stage_table(rows.select("row_no", "doc_id").join(by_row, "row_no").select("doc_id", "n_shingles", "root").unionByName(unnamed), "rows_found")
    first = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("root").alias("first"), F.count("*").alias("k"))
    ties = join_classes(found.where("doc_id is not null").select("doc_id", "root"), stage_table(first, "first_roots"), ["doc_id"], "k", found.count()).where("root <> first")
    tied = connected_components(ties.select(F.col("root").alias("a"), F.col("first").alias("b")).distinct())
    tied = stage_table(found.where("root is not null").select("root").distinct().join(tied.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("root", F.coalesce("top", "root").alias("top")), "tied")
    tops = found.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).join(tied, "root")
    ids = tops.groupBy("top").agg(F.min("least").alias("component_id"))
    classes = stage_table(tops.join(ids, "top").select("root", "k", "component_id"), "root_ids")
    return join_classes(found, classes, ["root"], "k", found.count(), "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _components_of(docs: DataFrame, signed: DataFrame, n: int, num: int, den: int, part_sets: int, part_shingles: int) -> DataFrame:
    found = jaccard_classes(docs, signed, n, num, den, part_sets, part_shingles)
    keys = ["fp1", "fp2"]
    full, empty = signed.where("n_shingles > 0").drop("prefix", "long_list", "bitmap"), signed.where("n_shingles = 0")
    classes = full.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = stage_table(classes.join(found, classes.rep == found.node, "left").select(*keys, "n", F.coalesce("root", "rep").alias("class_id")), "classes")
    mapped = join_classes(full, classes, keys, "n", signed.count(), "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id"))
    return mapped.unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each group of rows that links connect: that of the smallest id. All columns stay.

    A row is dropped only for a row that stays: equal rows, rows of one id and rows without an id are told apart by their place,
    so texts that share nothing but an id all stay. Texts without words link with nothing and stay. Ids are whole numbers.
    """
    ids = stage_table(docs.select("doc_id"), "ids")
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType) and not ids.where("doc_id is null").limit(1).count()
    if whole and not ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        found = stage_table(jaccard_components(docs, n, num, den), "components")
        gone = stage_table(found.where("doc_id <> component_id").select("doc_id"), "gone")
        return docs.join(maybe_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
    number = f"row_{uuid.uuid4().hex}"  # no column of the documents has this name
    rows = _by_row(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("kept"), "doc_id", "text")).withColumnRenamed("row_no", number)
    found = jaccard_components(rows.select(F.col(number).alias("doc_id"), "text"), n, num, den)
    gone = stage_table(found.where("doc_id <> component_id").select(F.col("doc_id").alias(number)), "gone")
    return rows.join(maybe_broadcast(gone), number, "left_anti").select("kept.*")

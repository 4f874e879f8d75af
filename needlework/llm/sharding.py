"""Sharding by histogram sort: count bytes below candidate boundaries, refine them, then exchange once.

Rows are ordered by a 63-bit key: the CRC-32 of the text, then 31 bits of a hash of the id. Equal texts are neighbours in
this order, and a large group of copies can still be split inside. The key space is cut into 2^bits ranges; one job counts
rows and bytes of each range exactly. Ranges that hold too many rows, or within which a splitter falls farther than the
tolerance from its target, are cut again, until every splitter meets the tolerance and no range is large. A range that is a
single key (repeated rows, or copies without an id) is cut by a hash of the row numbers, which the staged rows carry. The
driver holds counts of ranges only, never rows. The ranges are then dealt out in one exchange, numbered inside each range, and
the exact counts turn those numbers into gapless slots, so no task ever sorts a whole shard.

Law ``bytes``: the sizes of the shards are near equal: each splitter lies within ``tolerance`` of a shard of its target, or at
an end of the row that covers the target, as a row can't be cut.

Defined results: a null text counts as no bytes (size 1, CRC-32 0); null ids are placed by their text and row; texts of any
length are one row each, and one larger than a shard's share makes its shard larger; repeated rows get slots of their own, and
rows that are equal in the order may stand either way; an empty table gives an empty result; extra columns are carried along
when ``keep`` names them, whatever their names, except those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stage_table

KEY_BITS = 63
_ID_BITS = 31

#: Ranges cut again in one round are listed in a plan; more than this many are dealt with over several rounds.
MAX_RECUT = 2048

#: Parts that a single key is cut into at most.
MAX_PARTS = 4096

RESULT = ("doc_id", "size", "text_crc32", "shard", "slot")


def shard_key(text_crc: Column, doc_id: Column) -> Column:
    low = F.xxhash64(doc_id).bitwiseAND(F.lit((1 << _ID_BITS) - 1))
    return F.shiftleft(text_crc.cast("long"), _ID_BITS).bitwiseOR(low)


#: A range of keys: prefix, bits of the prefix, part of a single key.
Leaf = tuple[int, int, int]


class _Histogram:
    """Exact rows and bytes of ranges of the key."""

    def __init__(self, keyed: DataFrame, bits: int):
        self.keyed = keyed
        self.parts: dict[int, int] = {}  # of single keys that are cut
        self.leaves: dict[Leaf, tuple[int, int]] = self._count(keyed, bits)

    @staticmethod
    def _count(keyed: DataFrame, bits: int) -> dict[Leaf, tuple[int, int]]:
        p = F.shiftright("key", KEY_BITS - bits).alias("p")
        return {(r.p, bits, 0): (r.n, r.b) for r in keyed.groupBy(p).agg(F.count("*").alias("n"), F.sum("size").alias("b")).toLocalIterator()}

    def ordered(self) -> list[tuple[Leaf, int, int]]:
        """(leaf, rows, bytes) in key order."""
        return sorted(((k, n, b) for k, (n, b) in self.leaves.items()), key=lambda x: (x[0][0] << (KEY_BITS - x[0][1]), x[0][2]))

    def can_cut(self, leaf: Leaf) -> bool:
        return leaf[1] < KEY_BITS or (leaf[0] not in self.parts and self.leaves[leaf][0] > 1)

    def recut(self, leaves: list[Leaf], step: int) -> None:
        for depth in sorted({b for _, b, _ in leaves}):
            own = [p for p, b, _ in leaves if b == depth][:MAX_RECUT]
            inside = self.keyed.where(F.shiftright("key", KEY_BITS - depth).isin(own))
            if depth < KEY_BITS:
                found = self._count(inside, min(KEY_BITS, depth + step))
            else:
                self.parts |= {p: min(MAX_PARTS, self.leaves[p, depth, 0][0]) for p in own}
                part = _part(self.keyed, self.parts)
                rows = inside.groupBy(F.col("key").alias("p"), part.alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).toLocalIterator()
                found = {(r.p, depth, r.part): (r.n, r.b) for r in rows}
            for p in own:
                del self.leaves[p, depth, 0]
            self.leaves |= found


def _part(rows: DataFrame, parts: dict[int, int]) -> Column:
    """The part of a row whose key is cut, 0 for all others; few keys are."""
    out = F.lit(0)
    by_number: dict[int, list[int]] = {}
    for key, n in parts.items():
        by_number.setdefault(n, []).append(key)
    for n, keys in sorted(by_number.items()):
        out = F.when(F.col("key").isin(sorted(keys)), F.pmod(F.xxhash64("row_no"), F.lit(n)).cast("int")).otherwise(out)
    return out


def _plan(hist: _Histogram, shards: int, tolerance: float, rows_per_range: int, step: int) -> list[tuple[Leaf, int, int, int]]:
    """Refine until done; returns (leaf, shard, slot of its first row, rows)."""
    while True:
        ordered = hist.ordered()
        total = sum(x[2] for x in ordered)
        share = total / shards
        cuts, again, below, k = [], set(), 0, 1
        for i, (leaf, _, b) in enumerate(ordered):
            while k < shards and below + b >= k * share:
                target = k * share
                after = target - below > below + b - target
                if min(target - below, below + b - target) > tolerance * share and hist.can_cut(leaf):
                    again.add(leaf)
                cuts.append(i + after)
                k += 1
            below += b
        again |= {leaf for leaf, n, _ in ordered if n > rows_per_range and hist.can_cut(leaf)}
        if not again:
            break
        hist.recut(sorted(again), step)
    out, shard, slot = [], 0, 0
    for i, (leaf, n, _) in enumerate(ordered):
        while shard < len(cuts) and i >= cuts[shard]:
            shard, slot = shard + 1, 0
        out.append((leaf, shard, slot, n))
        slot += n
    return out


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, bits: int = 12, rows_per_range: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deal ``docs`` into ``shards`` of near equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot and the columns named in ``keep``.
    ``rows_per_range`` bounds how many rows a range, and so a window group, may hold (default: a 1024th of the rows, at
    least 500 and at most 100,000); a single key shared by over ``MAX_PARTS`` times as many is the only exception.
    """
    if not 1 <= shards <= 4096:
        raise ValueError("shards must be 1 to 4096")
    if taken := {c.lower() for c in keep} & set(RESULT):
        raise ValueError(f"the result has columns of its own with these names: {sorted(taken)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    base = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *kept)
    # what the rounds read is staged, so the texts are read once, and row numbers stay what they are
    base = stage_table(base.withColumns({"key": shard_key(F.col("text_crc32"), F.col("doc_id")), "row_no": F.monotonically_increasing_id()}), "keyed")
    hist = _Histogram(base.select("key", "size", "row_no"), bits)
    rows = sum(n for n, _ in hist.leaves.values())
    limit = rows_per_range or min(100_000, max(500, rows // 1024))
    if rows // (1 << bits) > limit:  # far more rows than ranges: begin with finer ones
        hist = _Histogram(hist.keyed, min(20, (rows // limit).bit_length()))
    plan = _plan(hist, shards, tolerance, limit, step=8)
    depths = sorted({leaf[1] for leaf, *_ in plan})
    if not plan:
        return _result(base.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).where(F.lit(False)), keep)

    columns = (("leaf_bits", T.IntegerType()), ("leaf", T.LongType()), ("part", T.IntegerType()), ("shard", T.IntegerType()), ("first_slot", T.LongType()))
    leaves = docs.sparkSession.createDataFrame([(b, p, part, s, slot) for (p, b, part), s, slot, _ in plan], T.StructType([T.StructField(*c) for c in columns]))
    # A row's range is the deepest cut that covers it. A range cut again at one depth has rows at deeper ones only,
    # so the prefixes that were cut again say which depth holds.
    present = {d: {p >> (b - d) for (p, b, _), *_ in plan if b > d} for d in depths}
    bits_of: Column = F.lit(depths[-1])
    for d in reversed(depths[:-1]):
        deeper = F.shiftright("key", KEY_BITS - d).isin(sorted(present[d]))
        bits_of = F.when(deeper, bits_of).otherwise(F.lit(d))
    placed = base.withColumn("leaf_bits", bits_of).withColumn("part", _part(base, hist.parts))
    placed = placed.withColumn("leaf", F.expr(f"shiftright(key, {KEY_BITS} - leaf_bits)"))
    # ranges are bounded: 2^20 to begin with, and some hundreds cut again
    placed = placed.join(F.broadcast(leaves), ["leaf_bits", "leaf", "part"])
    w = Window.partitionBy("leaf_bits", "leaf", "part").orderBy("key", "doc_id", "size", "row_no")
    return _result(placed.withColumn("slot", F.col("first_slot") + F.row_number().over(w) - 1), keep)


def _result(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return df.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", *[F.col("kept")[c].alias(c) for c in keep])

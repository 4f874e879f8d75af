"""LZ78 phrases and what they tell about occurrences.

Two scopes. ``collection`` keeps one dictionary over all documents in order of their ids: phrase ids count from 1 through the
whole collection, and preorders, neighbours and subtrees are those of one trie. It is sequential by nature, so the parse is
one task. ``document`` begins a new dictionary with every document: documents are parsed side by side, phrase ids count from
1 in each, and a phrase is known by (doc_id, phrase_id). Frequencies and rankings are the same under either scope, which is
why nothing else in the engine depends on the parse.

A document ends with a terminal phrase, whose string ends with the separator. Documents without an id have no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.functions.text import SEPARATOR, check_pattern, occurrences
from needlework.sources.collections import numbered
from needlework.sources.shared import small_side

PHRASES = "phrase_id long, parent_id long, symbol string, doc_id long, start_pos long, ptext string, is_terminal boolean"
SCOPES = ("document", "collection")

_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
_NAMES = [column.split()[0] for column in PHRASES.split(", ")]


class _Parser:
    """A dictionary as edges: (phrase, symbol) in one number leads to the phrase that is longer by that symbol."""

    def __init__(self) -> None:
        self.edges: dict[int, int] = {}
        self.count = 0

    def cut(self, text: str) -> Iterator[tuple[int, int | None, str, int, str, bool]]:
        """Longest known phrase plus one symbol, again and again; the end of the text takes the separator as its symbol."""
        edges, start, node = self.edges, 0, 0
        for at, symbol in enumerate(text):
            edge = node << 21 | ord(symbol)
            after = edges.get(edge)
            if after is not None:
                node = after
                continue
            self.count += 1
            edges[edge] = self.count
            yield self.count, node or None, symbol, start, text[start : at + 1], False
            start, node = at + 1, 0
        self.count += 1
        yield self.count, node or None, SEPARATOR, start, text[start:] + SEPARATOR, True


def _within(scope: str) -> list[str]:
    """The columns inside which phrase ids, ranks and neighbours live."""
    if scope not in SCOPES:
        raise ValueError("scope is document or collection")
    return [] if scope == "collection" else ["doc_id"]


def lz78_phrases(corpus: DataFrame, scope: str = "document") -> DataFrame:
    """The phrase table of a corpus; the root has no row, and phrases right below it have no parent_id."""
    one = not _within(scope)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser()
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not one:
                    parser = _Parser()
                for i, parent, symbol, at, phrase, end in parser.cut(text):
                    rows.append((i, parent, symbol, doc, at, phrase, end))
                    if len(rows) == 50_000:  # a long document fills many batches
                        yield _batch(rows)
                        rows = []
        yield _batch(rows)

    source = corpus.where("text is not null and doc_id is not null").select("doc_id", "text")
    return (source.coalesce(1).sortWithinPartitions("doc_id") if one else source).mapInArrow(parse, PHRASES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _NAMES)


def by_place() -> Window:
    return Window.partitionBy("doc_id").orderBy("phrase_id")


def parse_stats(phrases: DataFrame) -> DataFrame:
    """(doc_id, n_symbols): the phrases of a document spell it out, and the separator."""
    return phrases.groupBy("doc_id").agg(F.sum(F.char_length("ptext")).cast("long").alias("n_symbols"))


def _ranked(phrases: DataFrame, scope: str, name: str, string: Column) -> DataFrame:
    """Phrases with ``name``, their rank from 1 by ``string``; of equal ones the newest comes first."""
    keyed = phrases.withColumn("_string", string)
    if not _within(scope):  # ranges of the order are numbered side by side
        return numbered(keyed, F.col("_string"), F.desc("phrase_id"), name=name).withColumn(name, F.col(name) + 1).drop("_string")
    w = Window.partitionBy(*_within(scope)).orderBy("_string", F.desc("phrase_id"))
    return keyed.withColumn(name, F.row_number().over(w).cast("long")).drop("_string")


def preorder(phrases: DataFrame, scope: str = "document") -> DataFrame:
    """Rank of every phrase in preorder of the trie: by bytes, the separator lowest, newest first; the root would be 0."""
    return _ranked(phrases, scope, "preorder", F.col("ptext"))


def reverse_order(phrases: DataFrame, scope: str = "document") -> DataFrame:
    """Rank of every phrase by its reversed string; terminal ones hang right below the root by their separator."""
    return _ranked(phrases, scope, "rev_rank", F.when(F.col("is_terminal"), F.lit(SEPARATOR)).otherwise(F.reverse("ptext")))


def trie_listing(phrases: DataFrame, scope: str = "document") -> DataFrame:
    return preorder(phrases, scope).select("doc_id", "preorder", "phrase_id", "parent_id", "symbol", F.char_length("ptext").cast("long").alias("depth"))


def doc_array(phrases: DataFrame, scope: str = "document") -> DataFrame:
    """(preorder, doc_id, phrase_id): which document each node of the phrase trie belongs to."""
    return preorder(phrases, scope).select("preorder", "doc_id", "phrase_id")


def reversed_phrases(phrases: DataFrame) -> DataFrame:
    return phrases.where("not is_terminal").select("doc_id", "phrase_id", F.reverse("ptext").alias("rtext"))


def lookup_exact(phrases: DataFrame, pattern: str) -> DataFrame:
    return phrases.where((F.col("ptext") == check_pattern(pattern)) & ~F.col("is_terminal")).select("phrase_id", "doc_id")


def ending_with(phrases: DataFrame, pattern: str) -> DataFrame:
    """Phrases that end with the pattern; terminal ones end with the separator and never do."""
    return phrases.where(F.endswith("ptext", F.lit(check_pattern(pattern)))).select("phrase_id", "doc_id")


def adjacent(phrases: DataFrame, scope: str = "document") -> DataFrame:
    """(doc_id, phrase_id, next_id) of neighbours, by an equi-join on the running id; in a collection over ends of documents too."""
    keys = [*_within(scope), "phrase_id"]
    after = phrases.select(*_within(scope), F.col("phrase_id").alias("next_id"), (F.col("phrase_id") - 1).alias("phrase_id"))
    return phrases.select("doc_id", "phrase_id").join(after, keys).select("doc_id", "phrase_id", "next_id")


def next_phrase(phrases: DataFrame) -> DataFrame:
    """(doc_id, phrase_id, next_id): the phrase that follows in the document, null behind the last."""
    return phrases.select("doc_id", "phrase_id", F.lead("phrase_id").over(by_place()).alias("next_id"))


def subtree_size(phrases: DataFrame, prefix: str, scope: str = "document") -> DataFrame:
    """How many phrases lie below the node of ``prefix``, itself included: of each document, or of the collection in one row."""
    below = phrases.where(F.startswith("ptext", F.lit(check_pattern(prefix))))
    return below.groupBy(*_within(scope)).agg(F.count("*").alias("n_phrases"))


def rightmost_leaf(phrases: DataFrame, prefix: str, scope: str = "document") -> DataFrame:
    """The greatest preorder below the node of ``prefix``."""
    below = preorder(phrases, scope).where(F.startswith("ptext", F.lit(check_pattern(prefix))))
    return below.groupBy(*_within(scope)).agg(F.max("preorder").alias("last_preorder"))


def fictitious_nodes(phrases: DataFrame, scope: str = "document") -> DataFrame:
    """Nodes of the trie of reversed phrases that are no phrase: those that end a unary path of such nodes, and the extra ones on it.

    A fictitious node is extra if its only child is fictitious too. Phrases are prefixes of no other string than their own
    reversed extensions, so all nodes are the distinct prefixes of reversed phrases.
    """
    within = _within(scope)
    real = phrases.where("not is_terminal").select(*within, F.reverse("ptext").alias("r")).distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.char_length("r")), lambda n: F.left(F.col("r"), n))
    nodes = real.select(*within, (F.col("r")).alias("whole"), F.explode(prefixes).alias("r"))
    nodes = nodes.groupBy(*within, "r").agg(F.max((F.col("whole") == F.col("r")).cast("int")).alias("real"))
    parents = nodes.select(*within, F.left("r", F.char_length("r") - 1).alias("r"), "real").groupBy(*within, "r").agg(F.count("*").alias("children"), F.sum(1 - F.col("real")).alias("fictitious"))
    unreal = nodes.where("real = 0").join(parents, [*within, "r"])
    extra = (F.col("children") == 1) & (F.col("fictitious") == 1)
    return unreal.groupBy(*within).agg(F.count(F.when(~extra, 1)).alias("n_fictitious"), F.count(F.when(extra, 1)).alias("n_extra"))


def pattern_factors(phrases: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, phrase_id, i, j): the substring i..j of the pattern (from 1) is a whole phrase."""
    m = len(check_pattern(pattern))
    parts = phrases.sparkSession.createDataFrame([(i + 1, j, pattern[i:j]) for i in range(m) for j in range(i + 1, m + 1)], "i int, j int, ptext string")
    return phrases.where("not is_terminal").select("doc_id", "phrase_id", "ptext").join(small_side(parts), "ptext").select("doc_id", "phrase_id", "i", "j")


def occurrence_counts(phrases: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, occ1, occ2, occ3): occurrences inside one phrase, across one boundary, across more, in one pass over the phrases."""
    m = len(check_pattern(pattern))
    leads = [F.coalesce(F.lead("ptext", i).over(by_place()), F.lit("")) for i in range(1, max(2, m))]
    inside = F.when(F.contains("ptext", F.lit(pattern)), occurrences(F.col("ptext"), pattern)).otherwise(F.lit(0).cast("long"))
    wide = phrases.select("doc_id", inside.alias("inside"), "ptext", leads[0].alias("after"), F.concat(*leads).alias("rest"))
    two, more = F.lit(0).cast("long"), F.lit(0).cast("long")
    for cut in range(1, m):  # an occurrence begins in a phrase that ends with the head, and what follows begins with the tail
        head, tail = pattern[:cut], pattern[cut:]
        hit, reach = F.endswith("ptext", F.lit(head)) & F.startswith("rest", F.lit(tail)), F.char_length("after") >= len(tail)
        two, more = two + (hit & reach).cast("long"), more + (hit & ~reach).cast("long")
    each = wide.select("doc_id", F.col("inside").alias("occ1"), two.alias("occ2"), more.alias("occ3")).where("occ1 > 0 or occ2 > 0 or occ3 > 0")
    return each.groupBy("doc_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("occ1", "occ2", "occ3")])


def occ_type1(phrases: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, occ) of occurrences inside one phrase."""
    inside = occurrences(F.col("ptext"), pattern)
    return phrases.where(F.contains("ptext", F.lit(pattern))).groupBy("doc_id").agg(F.sum(inside).cast("long").alias("occ"))


def _of_type(phrases: DataFrame, pattern: str, column: str) -> DataFrame:
    return occurrence_counts(phrases, pattern).where(F.col(column) > 0).select("doc_id", F.col(column).alias("occ"))


def occ_type2(phrases: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, occ) of occurrences across exactly one phrase boundary."""
    return _of_type(phrases, pattern, "occ2")


def occ_type3(phrases: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, occ) of occurrences across two or more phrase boundaries."""
    return _of_type(phrases, pattern, "occ3")


def occ_all_types(phrases: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, tf): the three disjoint kinds added up are all occurrences."""
    return occurrence_counts(phrases, pattern).select("doc_id", (F.col("occ1") + F.col("occ2") + F.col("occ3")).alias("tf"))


def occurrence_types(phrases: DataFrame, positions: DataFrame, m: int) -> DataFrame:
    """(doc_id, occ_type, occ) of located positions by the phrase starts in (pos, pos + m - 1]: none, one, or more."""
    starts = phrases.select("doc_id", "start_pos")
    met = positions.join(starts, (positions.doc_id == starts.doc_id) & (starts.start_pos > positions.pos) & (starts.start_pos <= positions.pos + m - 1), "left")
    each = met.groupBy(positions.doc_id, positions.pos).agg(F.count("start_pos").alias("n"))
    return each.select("doc_id", (F.least(F.col("n"), F.lit(2)) + 1).cast("int").alias("occ_type")).groupBy("doc_id", "occ_type").agg(F.count("*").alias("occ"))


def grid(phrases: DataFrame, scope: str = "document") -> DataFrame:
    """Points of the range structure: (doc_id, phrase_id, rev_rank, next_id, next_preorder) of phrases that another one follows in their document."""
    keys = ["doc_id", "phrase_id"]
    ranks = preorder(phrases, scope).select("doc_id", F.col("phrase_id").alias("next_id"), F.col("preorder").alias("next_preorder"))
    own = reverse_order(phrases, scope).select(*keys, "rev_rank").join(next_phrase(phrases).where("next_id is not null"), keys)
    return own.join(ranks, ["doc_id", "next_id"]).select(*keys, "rev_rank", "next_id", "next_preorder")


def grid_range(points: DataFrame, a: int, b: int, c: int, d: int) -> DataFrame:
    """The points with rev_rank from a to b and next_preorder from c to d."""
    return points.where(F.col("rev_rank").between(a, b) & F.col("next_preorder").between(c, d))


def range_report(phrases: DataFrame, head: str, tail: str) -> DataFrame:
    """(doc_id, phrase_id, next_id): a phrase that ends in ``head`` followed by one that begins with ``tail``.

    The phrases that end in a string are a range of reverse ranks, and those that begin with one a range of preorders, so this is
    a box of the grid. Both sides are filtered before they meet, and no ranks are needed.
    """
    rows = phrases.where(F.endswith("ptext", F.lit(check_pattern(head)))).select("doc_id", "phrase_id", (F.col("phrase_id") + 1).alias("next_id"))
    cols = phrases.where(F.startswith("ptext", F.lit(check_pattern(tail)))).select("doc_id", F.col("phrase_id").alias("next_id"))
    return rows.join(cols, ["doc_id", "next_id"]).select("doc_id", "phrase_id", "next_id")


def range_exists(phrases: DataFrame, head: str) -> DataFrame:
    """Phrases whose predecessor ends with ``head``, as a semi-join on the running id."""
    before = phrases.where(F.endswith("ptext", F.lit(check_pattern(head)))).select("doc_id", (F.col("phrase_id") + 1).alias("phrase_id"))
    return phrases.join(before, ["doc_id", "phrase_id"], "left_semi").select("phrase_id", "doc_id")


def phrase_to_document(phrases: DataFrame, ids: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(phrase_id, doc_id): the document whose phrases include the id, under the collection scope, where ids rise through all documents.

    An as-of join on ranges of ids: a document goes to the blocks of ids that it touches, an id to its own, and they meet by equality.
    """
    spans = phrases.groupBy("doc_id").agg(F.min("phrase_id").alias("lo"), F.max("phrase_id").alias("hi"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    asked = ids.select("phrase_id", F.floor(F.col("phrase_id") / block).alias("block"))
    return asked.join(spans, "block").where("phrase_id between lo and hi").select("phrase_id", "doc_id")

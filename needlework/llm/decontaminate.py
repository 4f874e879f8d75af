"""Benchmark decontamination by templates: numbers, names and units become typed placeholders before windows are compared.

Texts become tokens: lower-case words, with numbers, capitalised words inside a sentence and units after numbers marked as
slots. A slot stands in windows by its type only, so a question with other numbers or names has the same windows. Windows
of all documents meet the benchmark's windows in a hash join. A document leaks an item if it holds enough of the item's
windows and its slots are filled consistently: one value of the item always answers to one value of the document, and the
other way round. Windows are also met with their names as lower-case words, so a copy in another case is found; either form
counts. Windows of fewer than two literal tokens even so are met verbatim, with the values of their slots; enough are 0.6 of
all windows, or of those that are templates. Consistency is asked of one occurrence at a time: of each alignment (place in the document less place in
the item), of overlapping bands of alignments no wider than the item, and of the whole document. Where an item's window
matches at several places, the alignment with the most windows speaks for it. One consistent occurrence is enough.

Everything is DataFrame functions. The benchmark's windows are broadcast behind a check of their number. Beyond it a sieve of
bits is broadcast, which drops nearly all windows of the documents that no item has, and what passes is shuffled and compared
exactly; windows that very many documents hold are split by the adaptive join. Documents are read again only for the rows that
hold enough windows.

Defined results: null and empty texts leak nothing; null and empty items are not looked for; items shorter than a window are
looked for whole, and those of fewer than ``MIN_TOKENS`` tokens leak only into documents that hold no other token; texts of any
length are read whole; of alignments, bands and places that are equally good the smallest or an equal one speaks, which changes
no decision; repeated rows give one row of result, rows without an id are told apart by their text; an empty table gives an
empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, maybe_broadcast, stage_table

WINDOW, MIN_TOKENS = 5, 4

#: Windows of a benchmark that are broadcast at most; more of them are sieved for and shuffled.
BROADCAST_WINDOWS = BROADCAST_ROWS

#: Bits of the sieve, as a power of two: 64 of them are one of the rows that are broadcast.
SIEVE_BITS = 25

UNITS = "km|cm|mm|m|kg|g|mg|lbs?|oz|mph|kmh|miles?|met(?:er|re)s?|feet|foot|inch(?:es)?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|lit(?:er|re)s?"


def tokens(text: Column) -> Column:
    """Lower-case tokens; slots begin with a control character: 1 names, 2 numbers, 3 units."""
    clean = F.regexp_replace(text, r"[\x01-\x03]", " ")
    named = F.regexp_replace(clean, r"(?<=[\p{L}\p{N},;:)] )(\p{Lu}\p{Ll}+)", "\x01$1")
    whole = F.regexp_replace(named, r"(?<=\d)[.,](?=\d)", "")
    numbered = F.regexp_replace(whole, r"(?<![\p{L}\d])\d+(?![\d])", "\x02$0")
    numbered = F.regexp_replace(numbered, r"(\x02\d+) ?%", "$1 \x03percent")
    numbered = F.regexp_replace(numbered, r"[$€£] ?(?=\x02)", " \x03currency ")
    numbered = F.regexp_replace(numbered, rf"(?i)(\x02\d+) ?\x01?({UNITS})(?![\p{{L}}\p{{N}}])", "$1 \x03$2")
    marked = F.when(text.rlike(r"\d"), numbered).otherwise(named)
    return F.filter(F.split(F.lower(marked), r"[^\p{L}\p{M}\p{N}\x01-\x03]+"), lambda t: t != "")


def _template(found: Column) -> Column:
    """A hash for each token; slots give their type."""
    return F.transform(found, lambda t: F.when(F.ascii(t) > 3, F.xxhash64(t)).otherwise(F.ascii(t).cast("long")))


def _literal(t: Column) -> Column:
    """A token as it stands, without its mark."""
    return F.when(F.ascii(t) > 3, t).otherwise(F.substring(t, 2, 1 << 30))


def _unnamed(t: Column) -> Column:
    """A token without the mark of a name; other marks stay."""
    return F.when(F.ascii(t) == 1, _literal(t)).otherwise(t)


def _nameless(found: Column) -> Column:
    """As :func:`_template`, but names count as the words they are: case doesn't matter."""
    return F.transform(found, lambda t: F.when(F.ascii(t) > 3, F.xxhash64(t)).when(F.ascii(t) == 1, F.xxhash64(_literal(t))).otherwise(F.ascii(t).cast("long")))


def _verbatim(found: Column) -> Column:
    """A hash for each token; slots give their values."""
    return F.transform(found, lambda t: F.xxhash64(_literal(t)))


def _windows(rows: DataFrame, keys: list[str], sizes: list[int], forms: list[str]) -> DataFrame:
    """(keys, m, pos, window) of every window of each size in ``sizes``; ``forms`` are arrays of hashes, a repeated form counts once."""

    def hashes(m: int) -> Column:
        last = F.size(forms[0]) - m
        hashed = lambda form: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(form, i + 1, m)))
        at = [hashed(form) for form in forms]
        own = [at[0], *(F.when(reduce(Column.__or__, [F.col(form) == F.col(x) for x in forms[:k]]), F.array().cast("array<bigint>")).otherwise(at[k]) for k, form in enumerate(forms) if k)]
        # too short an item is met only by a document of its own length
        return F.when((last >= 0) if m >= MIN_TOKENS else (last == 0), F.concat(*own)).otherwise(F.array().cast("array<bigint>"))

    if len(sizes) == 1:  # the usual case
        m = sizes[0]
        found = rows.select(*keys, (F.size(forms[0]) - m + 1).alias("count"), F.posexplode(hashes(m)).alias("pos", "window"))
        return found.select(*keys, (F.col("pos") % F.col("count")).alias("pos"), "window", F.lit(m).alias("m"))
    # one pass over the rows for all sizes
    told = lambda m: F.transform(hashes(m), lambda w, i: F.struct(F.pmod(i, F.size(forms[0]) - m + 1).alias("pos"), w.alias("window"), F.lit(m).alias("m")))
    return rows.select(*keys, F.inline(F.concat(*map(told, sizes)))).select(*keys, "pos", "window", "m")


def _literals(form: str) -> Column:
    """How many tokens of the window at ``pos`` are no slots."""
    return F.size(F.filter(F.slice(form, F.col("pos") + 1, F.col("m")), lambda x: (x < 1) | (x > 3)))


def row_key() -> Column:
    """Tells rows apart by id and text, in 128 bits; equal rows are one."""
    own = F.col("doc_id").cast("string")
    return F.md5(F.concat_ws(":", F.coalesce(F.char_length(own), F.lit(-1)).cast("string"), F.coalesce(own, F.lit("")), F.col("text")))


def _occurrences(met: DataFrame) -> DataFrame:
    """(row_key, item_id, band, item_pos, pos, m, typed): for each band of alignments, one match of each of the item's windows.

    Bands are single alignments, ranges of them as wide as the item that overlap by half, so that inserted and dropped words
    split no occurrence, and the whole document; items without slots need the last only.
    """
    shift, half = F.col("pos") - F.col("item_pos"), F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    at = F.floor(F.col("shift") / half)
    band = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("at"))
    whole = band(2, F.lit(0))
    bands = F.when(F.col("slotted"), F.array(band(0, F.col("shift")), band(1, at), band(1, at - 1), whole)).otherwise(F.array(whole))
    rows = met.select("row_key", "item_id", "item_pos", "m", "n", "slotted", "typed", shift.alias("shift")).distinct()
    support = rows.groupBy("row_key", "item_id", "shift").agg(F.count("*").alias("support"))
    rows = rows.join(support, ["row_key", "item_id", "shift"]).withColumn("band", F.explode(bands))
    best = rows.groupBy("row_key", "item_id", "band", "item_pos", "m", "typed").agg(F.max(F.struct("support", "shift")).alias("best"))
    return stage_table(best.select("row_key", "item_id", "band", "item_pos", (F.col("item_pos") + F.col("best.shift")).alias("pos"), "m", "typed"), "placed")


def _meet(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The windows ``found`` in documents that are ``wanted``, with the columns of both; ``wanted`` is a staged table."""
    if wanted.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        return found.join(F.broadcast(wanted), ["m", "window"])
    bit = F.pmod(F.col("window"), F.lit(1 << SIEVE_BITS))
    word, place = F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int")
    held = wanted.select(word, place.alias("place")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    sieved = found.withColumn("word", word).join(F.broadcast(stage_table(held, "sieve")), "word").where(F.getbit("bits", place) == 1)
    return sieved.drop("word", "bits").join(wanted, ["m", "window"])


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = 0.6, min_consistent: float = 0.8) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, item_windows, matched_windows, slots, slots_consistent, row_key."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0).withColumn("h", _template(F.col("t"))).distinct()
    items = stage_table(items, "items")
    sizes = sorted(r.m for r in items.select(F.least(F.size("h"), F.lit(window)).alias("m")).distinct().collect())
    full = items.select("item_id", "h", _nameless(F.col("t")).alias("p"), _verbatim(F.col("t")).alias("v"))
    # each item has windows of one size only; windows of hardly more than slots say nothing as templates: they are met as words or verbatim
    own = F.col("m") == F.least(F.size("h"), F.lit(window))
    wide = lambda form: _windows(full.withColumn("form", F.col(form)), ["item_id", "h", "p"], sizes or [window], ["form"]).where(own)
    typed, worded = _literals("h") >= 2, _literals("p") >= 2
    wanted = wide("h").where(typed).unionByName(wide("p").where(worded)).withColumn("verbatim", F.lit(False)).unionByName(wide("v").where(~worded).withColumn("verbatim", F.lit(True)))
    slotted = F.exists("h", lambda x: (x >= 1) & (x <= 3))
    wanted = wanted.select("item_id", "m", F.size("h").alias("n"), slotted.alias("slotted"), F.col("pos").alias("item_pos"), "window", typed.alias("typed"), "verbatim")
    wanted = stage_table(wanted.distinct(), "item_windows")
    count = lambda which=True: F.count_distinct(F.when(which, F.col("item_pos")))
    total = stage_table(wanted.groupBy("item_id").agg(count(F.lit(True)).alias("all_windows"), count(F.col("typed")).alias("typed_windows")), "item_totals")
    forms = ["h", "p", *(["v"] if wanted.where("verbatim").limit(1).count() else [])]
    # an item with other values meets its templates only, so they count by themselves too
    found = [count(F.lit(True)).alias("met_windows"), count(F.col("typed")).alias("met_typed")]
    by_all = F.col("met_windows") >= F.col("all_windows") * min_coverage
    covered = by_all | ((F.col("typed_windows") > 0) & (F.col("met_typed") >= F.col("typed_windows") * min_coverage))

    read = docs.where("text is not null").select("doc_id", row_key().alias("row_key"), tokens(F.col("text")).alias("t"))
    read = read.select("doc_id", "row_key", _template(F.col("t")).alias("h"), _nameless(F.col("t")).alias("p"), _verbatim(F.col("t")).alias("v"))
    met = _meet(_windows(read, ["doc_id", "row_key"], sizes or [window], forms), wanted.drop("verbatim"))
    met = stage_table(met.select("doc_id", "row_key", "item_id", "item_pos", "pos", "m", "n", "slotted", "typed"), "met")
    enough = met.groupBy("doc_id", "row_key", "item_id").agg(*found).join(total, "item_id").where(covered)
    enough = stage_table(enough.select("doc_id", "row_key", "item_id"), "enough")

    placed = _occurrences(met.join(enough.select("row_key", "item_id"), ["row_key", "item_id"], "left_semi"))
    held_windows = placed.groupBy("row_key", "item_id", "band").agg(*found).join(total, "item_id").where(covered)
    asked_of = lambda whole, part: F.when(by_all, F.col(whole)).otherwise(F.col(part))
    held_windows = held_windows.select("row_key", "item_id", "band", asked_of("met_windows", "met_typed").alias("matched_windows"), asked_of("all_windows", "typed_windows").alias("item_windows"))
    held_windows = stage_table(held_windows, "occurrences")

    # slots inside matched windows: what the item has there and what the document has
    place = ["row_key", "item_id", "band"]
    slots = items.select("item_id", F.posexplode("t").alias("slot_pos", "item_value")).where(F.ascii("item_value") <= 3).withColumn("item_value", _unnamed(F.col("item_value")))
    asked = placed.join(held_windows.select(*place), place, "left_semi").join(slots, "item_id").where("slot_pos >= item_pos and slot_pos < item_pos + m")
    asked = stage_table(asked.select(*place, "item_value", (F.col("pos") + F.col("slot_pos") - F.col("item_pos")).alias("at")).distinct(), "slots")
    held = docs.where("text is not null").withColumn("row_key", row_key()).join(maybe_broadcast(asked.select("row_key").distinct()), "row_key", "left_semi").select("row_key", tokens(F.col("text")).alias("t")).dropDuplicates(["row_key"])
    filled = asked.join(held, "row_key").select(*place, "item_value", _unnamed(F.element_at("t", F.col("at") + 1)).alias("value")).distinct()
    forth = filled.groupBy(*place, "item_value").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    back = filled.groupBy(*place, "value").agg(F.count("*").alias("k"))
    agreed = forth.join(back, [*place, "value"], "left").groupBy(*place).agg(F.count("*").alias("slots"), F.avg(((F.col("n") == 1) & (F.col("k") == 1)).cast("double")).alias("slots_consistent"))
    judged = held_windows.join(agreed, place, "left").withColumn("slots", F.coalesce("slots", F.lit(0))).withColumn("slots_consistent", F.coalesce("slots_consistent", F.lit(1.0)))
    judged = judged.where(F.col("slots_consistent") >= min_consistent).groupBy("row_key", "item_id").agg(F.max(F.struct("matched_windows", "slots_consistent", "slots", "item_windows")).alias("best"))
    out = enough.join(judged, ["row_key", "item_id"])
    return out.select("doc_id", "item_id", "best.item_windows", "best.matched_windows", "best.slots", "best.slots_consistent", "row_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = 0.6, min_consistent: float = 0.8) -> DataFrame:
    """``docs`` without the rows that leak any item; all columns stay."""
    leaked = f"leaked_{uuid.uuid4().hex}"  # no column of the documents has this name
    found = stage_table(benchmark_leaks(docs, benchmark, window, min_coverage, min_consistent).select(F.col("row_key").alias(leaked)).distinct(), "leaks")
    return docs.join(maybe_broadcast(found), row_key() == F.col(leaked), "left_anti")

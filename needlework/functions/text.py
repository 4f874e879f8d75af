"""Column functions on texts and patterns: quoting, overlapping counts, normalisers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends a document inside phrase strings; it can't occur in normalised text.
SEPARATOR = "\x01"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_pattern(pattern: str) -> str:
    if not pattern:
        raise ValueError("an empty pattern occurs everywhere")
    if SEPARATOR in pattern:
        raise ValueError("a pattern can't span documents")
    return pattern


def quote(pattern: str) -> str:
    """The pattern as a regular expression that matches nothing but itself."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", pattern)


def quoted(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"([^\p{L}\p{N}\s])", r"\\$1")


def occurrences(text: Column, pattern: str | Column) -> Column:
    """How often the pattern occurs, overlapping occurrences included: a look-ahead matches once at each position."""
    if isinstance(pattern, str):
        ahead = F.lit(f"(?={quote(check_pattern(pattern))})")
    else:
        ahead = F.concat(F.lit("(?="), quoted(pattern), F.lit(")"))
    return F.regexp_count(text, ahead).cast("long")


def has(text: Column, pattern: str | Column) -> Column:
    return F.contains(text, F.lit(check_pattern(pattern)) if isinstance(pattern, str) else pattern)


def grams(text: Column, m: int) -> Column:
    """All substrings of m characters, in order of place, in one linear pass; a match takes a whole character, so none begins inside a surrogate pair."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{int(m)}}}))."), F.lit(1))


def ascii_lower(text: Column) -> Column:
    """A to Z only, as C's tolower does for bytes."""
    return F.translate(text, _UPPER, _UPPER.lower())


def latin(text: Column) -> Column:
    """The UTF-8 bytes as characters, so that character functions work on bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def list_mode(text: Column, lower: bool = False) -> Column:
    """Normaliser of collections of files: bytes of 128 and more, and those up to the separator, become spaces."""
    out = F.regexp_replace(latin(text), r"[\x00-\x01\x80-\xff]", " ")
    return ascii_lower(out) if lower else out


def single_file_mode(text: Column, lower: bool = False) -> Column:
    """Normaliser of single-file collections: bytes up to the separator become newlines, all others stay."""
    out = F.regexp_replace(text, r"[\x00-\x01]", "\n")
    return ascii_lower(out) if lower else out


def drop_last(text: Column) -> Column:
    """Without the last character, which the terminator replaces in collections of files."""
    return F.left(text, F.greatest(F.char_length(text) - 1, F.lit(0)))


def documents_of(text: Column, delimiter: str) -> Column:
    """The documents of a single-file collection: a run of r delimiters is r - 1 newlines and one boundary; the last one closes."""
    d = quote(delimiter)
    runs = F.regexp_replace(text, f"{d}(?={d})", "\n")
    return F.split(F.regexp_replace(runs, rf"{d}\z", ""), d)


def list_budget(occurrences: Column, g: int, n_docs: Column) -> Column:
    """How many documents a stored list keeps: the least power of two whose g-fold exceeds the occurrences, at most all."""
    return F.least(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.floor(occurrences / g)))), n_docs).cast("long")

"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are always kept once their validator accepts them. Further
kinds (iban, ssn, secret) are proposed by patterns too, confirmed by mod-97 or by their form, and kept only if the score,
raised or lowered by telling words within ``CONTEXT`` characters before or behind the span, reaches ``threshold``.

Defined results: null and empty texts have no spans; texts of any length are searched whole, in time in proportion to their
length; spans of several kinds may overlap, and those that begin at one place come in the order of the kinds; rows with equal
ids are scored each on its own; other columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import returns_memory, text_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can't begin behind a digit: it would have begun with that digit. Saying so keeps long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Overlapping beginnings are all tried; where the number ends, its checksum says.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
_IBAN_LENGTH = {
    country: int(length)
    for length, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL "
        "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
    ).split())
    for country in countries.split(",")
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?:token|secret|password|passwd|api[_-]?key)\"?\s{0,3}[=:]\s{0,3}\"?([A-Za-z0-9_/+-]{16,}+)", re.I)
_DIGIT = re.compile(r"[0-9]")

#: Score before context, words that raise it, words that lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "secret": 0.6}
RAISES = {
    "email": ("mail", "contact", "reach"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "cc"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "token", "secret", "password"),
}
LOWERS = {
    "ip": ("version", "release", "section"),
    "card": ("isbn", "order", "serial"),
    "phone": ("isbn", "order"),
    "iban": ("serial",),
    "ssn": ("part", "serial", "order"),
    "secret": ("example", "sample"),
    "email": ("example",),
}
_WORD = re.compile(r"[a-z]+")

#: Characters before and behind a span in which telling words count.
CONTEXT = 48


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall(text[max(0, start - CONTEXT) : start].lower())) | set(_WORD.findall(text[end : end + CONTEXT].lower()))
    score = PRIOR[kind] + 0.25 * any(w in near for w in RAISES[kind]) - 0.25 * any(w in near for w in LOWERS[kind])
    return round(min(1.0, max(0.0, score)), 3)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of the endings behind which no letter or digit follows and whose mod-97 holds, the country's or else the longest."""
    free = 0
    for m in _IBAN.finditer(text):
        start, end = m.span(1)
        if start < free:
            continue
        valid: list[tuple[int, int]] = []
        while end > start + 4:
            if text[end - 1] != " " and not (end < len(text) and text[end].isascii() and text[end].isalnum()):
                whole = text[start:end].replace(" ", "")
                if len(whole) < 15:
                    break
                if mod97(whole):
                    valid.append((len(whole), end))
            end -= 1
        if valid:
            free = dict(valid).get(_IBAN_LENGTH.get(text[start : start + 2], 0), valid[0][1])
            yield start, free


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find_spans(text: str | None, threshold: float = 0.5) -> list[Span]:
    """All spans by start, then by kind. Base kinds are kept whatever their score."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
        found += [(s, e, "iban") for s, e in _ibans(text)]
        found += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text)]
    spans = [Span(s, e, k, _score(text, k, s, e)) for s, e, k in found]
    return sorted((x for x in spans if x.kind in BASE_KINDS or x.score >= threshold), key=lambda x: (x.start, _RANK[x.kind]))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """Each span becomes its kind in brackets; of overlapping spans the one that begins first stands for all."""
    if not text or not spans:
        return text
    out, done = [], 0
    for x in spans:
        if x.start >= done:
            out += [text[done : x.start], f"[{x.kind.upper()}]"]
        done = max(done, x.end)
    return "".join([*out, text[done:]])


SPAN_SCHEMA = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())])
)


def pii_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id and its spans (start, end, kind, score), code points, end exclusive."""
    out = T.StructType([docs.schema["doc_id"], T.StructField("spans", SPAN_SCHEMA)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    @returns_memory
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[x._asdict() for x in find_spans(t.as_py(), threshold)] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, arrow)], ["doc_id", "spans"])

    return text_batches(docs).select("doc_id", "text").mapInArrow(scan, out)


def pii_redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind and ``n_chars`` brought up to date; all rows stay."""

    @F.pandas_udf(T.StringType())
    def clean(text):
        return text.map(lambda t: redact(t, find_spans(t, threshold)) if t is not None else None)

    out = text_batches(docs).withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def pii_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The digest of :func:`pii_spans`: counts of the base kinds, their hash, and all spans as a string."""
    spans = pii_spans(docs, threshold)
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        F.coalesce(F.aggregate("spans", F.lit(0.0), lambda a, x: F.greatest(a, x["score"])), F.lit(0.0)).alias("top_score"),
    )

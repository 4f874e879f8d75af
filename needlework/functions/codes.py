"""Substrings of one length as whole numbers, cut and counted by numpy: the alphabet's size to the power of a place, a digit a symbol.

What holds for any substring is whether its code fits 63 bits, see :func:`fits`; substrings of other alphabets stay strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode has fewer code points, all below 21 bits.
CODE_POINTS = 0x110000
#: Characters that are cut at once, about; a document is never divided.
CHUNK = 1 << 20
#: Rows of a histogram that a task holds before it sums them up.
HELD = 1 << 22


def fits(alphabet: int, m: int) -> bool:
    return 0 < alphabet**m < 1 << 63


def points(texts: pa.StringArray) -> np.ndarray:
    """The code points of texts, one after another."""
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")


def strings(symbols: np.ndarray) -> pa.StringArray:
    """A string for each row of code points."""
    size = 1 + (symbols >= 0x80).astype(np.int32) + (symbols >= 0x800) + (symbols >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size.sum(axis=1))]).astype(np.int32)
    data = symbols.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(symbols), pa.py_buffer(ends), pa.py_buffer(data))


def digits(codes: np.ndarray, m: int, alphabet: np.ndarray) -> np.ndarray:
    """The code points of coded substrings, a row each."""
    places = len(alphabet) ** np.arange(m - 1, -1, -1, dtype=np.int64)
    return alphabet[codes[:, None] // places % len(alphabet)]


def ranks(alphabet: np.ndarray) -> np.ndarray:
    """Code point to digit."""
    table = np.zeros(CODE_POINTS, np.int64)
    table[alphabet] = np.arange(len(alphabet))
    return table


def slices(batch: pa.RecordBatch, texts: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about CHUNK characters at a time; ``texts`` names a column of lists of strings."""
    column = batch.column(texts)
    size = np.bincount(pc.list_parent_indices(column).to_numpy(), pc.utf8_length(column.flatten()).to_numpy(), batch.num_rows)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1, [batch.num_rows]]).astype(int)
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(value, rows) of each run of rows that agree in a column of numbers without nulls."""
    values = batch.column(column).to_numpy()
    begins = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]).astype(int)
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b > a:
            yield int(values[a]), batch.slice(a, b - a)


def cut(column: pa.ListArray, m: int, digit: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, rows) of all substrings of m characters, place by place; none spans texts."""
    texts = column.flatten()
    sizes = pc.utf8_length(texts).to_numpy()
    symbols = digit[points(texts)]
    n = max(0, len(symbols) - m + 1)
    codes = np.zeros(n, np.int64)
    for j in range(m):
        codes = codes * base + symbols[j : n + j]
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = text[:n] == text[m - 1 :][:n]
    return codes[inside], pc.list_parent_indices(column).to_numpy()[text[:n][inside]]


def counted(column: pa.ListArray, m: int, digit: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, rows, counts): how often each row's texts hold each substring of m characters, by code, then row."""
    codes, row = cut(column, m, digit, base)
    bits = max(1, len(column).bit_length())
    known = None
    if base**m >= 1 << 63 - bits:  # few documents of a large alphabet: numbered inside the slice
        known, codes = np.unique(codes, return_inverse=True)
    pairs, counts = np.unique(codes << bits | row, return_counts=True)
    codes = pairs >> bits
    return (codes if known is None else known[codes]), pairs & ((1 << bits) - 1), counts


def histogram(codes: np.ndarray, tf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, tf, n) with a row for each code and tf, n summed."""
    order = np.lexsort((tf, codes))
    codes, tf, n = codes[order], tf[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (tf[1:] != tf[:-1])])) if len(codes) else np.zeros(0, int)
    return codes[first], tf[first], np.add.reduceat(n, first) if len(first) else n

"""Whole Arrow batches of text as UTF-8 bytes: words, word hashes and shingle hashes without a loop over words.

Everything works on pieces of about ``PIECE`` bytes, cut between texts, so the arrays beside a batch stay small;
one text larger than that is one piece.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PIECE = 1 << 20
_SEGMENT = 1 << 19  # bytes hashed at once
_LONG_WORD = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024, size: int | None = None) -> Iterator[None]:
    """Rows, and bytes if ``size`` is given, that travel to Python at a time in what runs inside: long texts and packed
    rows make batches of the usual size large, and a whole batch stands outside the JVM's heap and in Python at once."""
    given = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    if size is not None:
        given["spark.sql.execution.arrow.maxBytesPerBatch"] = str(size)
    before = {name: spark.conf.get(name, None) for name in given}
    for name, value in given.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def give_back() -> None:
    """Return unused memory to the system: Python workers live on after a task and would keep what it needed at most."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library is glibc
    if trim is not None:
        trim(0)


def _word_bytes(separators: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for first, last in separators:
        table[first:last + 1] = False
    return table


#: Words are runs of these bytes: everything but blanks; ASCII letters and digits, and all beyond ASCII.
NOT_BLANK = _word_bytes([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = _word_bytes([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, bytes and offsets from 0 of each piece."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PIECE, "right")) - 1)
        yield first, data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        first = last


def words(data: np.ndarray, bounds: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; no word crosses from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word_byte[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased; equal words have equal hashes wherever they stand."""
    if not _tables:
        size = _SEGMENT + _LONG_WORD + 1
        _tables["up"], _tables["down"] = powers(_BASE, size), powers(pow(_BASE, -1, 1 << 64), size)
        _tables["byte"] = mix(LOWER.astype(np.uint64) + np.uint64(1))
    up, down, value = _tables["up"], _tables["down"], _tables["byte"]
    out = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > _LONG_WORD)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = int(np.searchsorted(starts, low + _SEGMENT, "left"))
        stop = min(int(ends[to - 1]), int(low) + _SEGMENT + _LONG_WORD)
        sums = np.zeros(stop - low + 1, np.uint64)
        np.cumsum(value[data[low:stop]] * up[:stop - low], out=sums[1:])
        s, e = starts[at:to] - low, np.minimum(ends[at:to], stop) - low
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    out = mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in long:
        out[i] = long_hash(LOWER[data[starts[i]:ends[i]]].tobytes())
    return out


def long_hash(data: bytes) -> np.uint64:
    import hashlib

    return np.uint64(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little"))


def runs(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the number of the first word of each."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = hashes[:count].copy()
    for j in range(1, n):
        acc *= np.uint64(0xA24BAED4963EE407)
        acc += hashes[j:j + count]
    whole = np.flatnonzero(owner[:count] == owner[n - 1:n - 1 + count])
    return mix(acc[whole] + np.uint64(n)), whole


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_words(column: pa.Array, word_byte: np.ndarray) -> np.ndarray:
    """Words of each text."""
    data, bounds = utf8(column)
    out = np.zeros(len(column), np.int64)
    for first, piece, cuts in pieces(data, bounds):
        _, _, owner = words(piece, cuts, word_byte)
        out[first:first + len(cuts) - 1] = np.bincount(owner, minlength=len(cuts) - 1)
    return out

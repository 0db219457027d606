"""Benchmark decontamination by winnowed fingerprints (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemart.llm.among import boxed, parted
from tidemart.llm.text import ALPHANUMERIC, give_back, pieces, runs, signed, small_batches, utf8, word_hashes, words
from tidemart.session import settle

WINDOW = 10  # words of a window: every shared span of so many words is found
GRAM = 6  # words of a fingerprinted gram; a window of WINDOW - GRAM + 1 grams keeps its least hash
ROWS = 10_000  # fingerprints of an item that leave a task at a time
FILTER_BITS = 25  # size of the filter that documents' fingerprints pass before the join, as a power of two

ITEMS = "fp long, at int, item_id string, least int, around binary"
BASE = "doc_id long, mark long, n_words long, fps array<long>, ats array<int>, arounds array<binary>, key binary"
SPAN = "key binary, item_id string, start int, stop int"
NOTHING, NOWHERE = np.uint64(0), np.uint64(1)  # stand for the words beyond the ends of documents, and of items


def winnow(hashes: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every ``window`` consecutive grams of one text (the last of equal ones)."""
    count = len(hashes) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best, place = hashes[:count].copy(), np.zeros(count, np.int64)
    for j in range(1, window):
        other = hashes[j:j + count]
        less = other <= best
        best[less] = other[less]
        place[less] = j
    whole = owner[:count] == owner[window - 1:window - 1 + count]
    picked = np.zeros(len(hashes), bool)
    picked[(np.arange(count) + place)[whole]] = True
    return np.flatnonzero(picked)


def fingerprints(hashes: np.ndarray, owner: np.ndarray, window: int, gram: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the numbers of their first words: winnowed grams, and all runs of the lengths in ``short``."""
    grams, at = runs(hashes, owner, gram)
    kept = winnow(grams, owner[at], window - gram + 1)
    found = [(grams[kept], at[kept])] + [runs(hashes, owner, n) for n in short]
    return np.concatenate([f for f, _ in found]), np.concatenate([a for _, a in found])


def surroundings(hashes: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, gram: int, beyond: np.uint64) -> np.ndarray:
    """Hashes of the words from ``window - gram`` before each place to as many behind its gram; ``beyond`` outside of
    first .. last-1, the text's own words. Every window that holds the gram lies inside."""
    reach = window - gram
    place = at[:, None] + np.arange(-reach, gram + reach)
    inside = (place >= first[:, None]) & (place < last[:, None])
    out = np.full(place.shape, beyond, np.uint64)
    out[inside] = hashes[place[inside]]
    return out


def _rows(matrix: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix."""
    matrix = np.ascontiguousarray(matrix)
    size = matrix.shape[1] * matrix.itemsize
    offsets = pa.py_buffer(np.arange(len(matrix) + 1, dtype=np.int32) * size)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(matrix.tobytes())])


def item_fingerprints(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """fp, at (number of its first word), item_id as text, the least run of equal words that counts, and the words around.

    An item of fewer words than a window is one run of all its words. Items without id or words take no part. A row holds
    the words of one window to either side, however long the item is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, data, cuts in pieces(*utf8(batch.column(1))):
                starts, ends, owner = words(data, cuts, ALPHANUMERIC)
                hashes = word_hashes(data, starts, ends)
                begin = np.searchsorted(owner, np.arange(len(cuts)))
                for i in np.flatnonzero(np.diff(begin)):
                    own = hashes[begin[i]:begin[i + 1]]
                    zero = np.zeros(len(own), np.int64)
                    fps, at = fingerprints(own, zero, window, gram, []) if len(own) >= window else runs(own, zero, len(own))
                    around = surroundings(own, at, np.zeros(len(at), np.int64), np.full(len(at), len(own)), window, gram, NOWHERE)
                    for low in range(0, len(fps), ROWS):
                        part = slice(low, low + ROWS)
                        n = len(fps[part])
                        yield pa.RecordBatch.from_pydict({
                            "fp": signed(fps[part]), "at": at[part].astype(np.int32), "item_id": pa.array([names[first + i]] * n, pa.string()),
                            "least": pa.array([min(window, len(own))] * n, pa.int32()), "around": _rows(around[part])})

    items = benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id is not null and text is not null").distinct()
    return settle(items.mapInArrow(run, ITEMS), "winnow-items")


def _mark_documents(docs: DataFrame, allowed: np.ndarray, short: list[int], window: int, gram: int) -> DataFrame:
    """Word counts of all documents; fingerprints that pass the filter with the words around them."""
    shift = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, cuts in pieces(*utf8(batch.column(2))):
                n = len(cuts) - 1
                starts, ends, owner = words(data, cuts, ALPHANUMERIC)
                hashes = word_hashes(data, starts, ends)
                fps, at = fingerprints(hashes, owner, window, gram, short)
                slot = fps >> shift
                kept = (allowed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                fps, at = fps[kept], at[kept]
                order = np.argsort(at, kind="stable")
                fps, at = fps[order], at[order]
                begin = np.searchsorted(owner, np.arange(n + 1))
                cut = np.searchsorted(at, begin)
                keys: list = [None] * n
                for i in np.flatnonzero(cut[1:] > cut[:-1]):
                    keys[i] = hashlib.blake2b(hashes[begin[i]:begin[i + 1]].tobytes(), digest_size=16).digest()
                lists = pa.array(cut, pa.int32())
                text = owner[at] if len(at) else np.zeros(0, np.int64)
                around = surroundings(hashes, at, begin[text], begin[text + 1], window, gram, NOTHING)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(first, n), "mark": batch.column(1).slice(first, n), "n_words": np.diff(begin),
                    "fps": pa.ListArray.from_arrays(lists, pa.array(signed(fps))),
                    "ats": pa.ListArray.from_arrays(lists, pa.array((at - begin[text]).astype(np.int32))),
                    "arounds": pa.ListArray.from_arrays(lists, _rows(around)), "key": pa.array(keys, pa.binary())})
        give_back()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    with small_batches(docs.sparkSession):
        return settle(keyed.mapInArrow(run, BASE), "winnow-documents")


def _extend(window: int, gram: int):
    """Grow each hit to both sides while the words are equal; what reaches a window's length counts.

    A window that a document shares holds a fingerprint that both sides keep, at one place in it, so the hits together
    cover every shared window, though none looks farther than that.
    """
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in (batch.column(2), batch.column(5)))
            equal = own == other
            before = np.cumprod(equal[:, :reach][:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int32)
            behind = np.cumprod(equal[:, reach:], axis=1, dtype=np.int8).sum(1, dtype=np.int32)
            hit = (behind > 0) & (before + behind >= np.asarray(batch.column(4)))
            at = np.asarray(batch.column(1))
            kept = pa.array(hit)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column(0).filter(kept), "item_id": batch.column(3).filter(kept),
                "start": (at - before)[hit].astype(np.int32), "stop": (at + behind)[hit].astype(np.int32)})

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, mark (hash of the text), n_words, n_hit and items (ids as text, sorted) of every row of ``docs``.

    A document word is hit if it lies in an occurrence of ``window`` consecutive words of an item, or of a whole item
    that is shorter. Winnowing keeps the least hash of every window of grams on both sides, so a shared span of
    ``window`` words shares a fingerprint; fingerprints are joined, each with the words around it, and each hit is extended.

    A filter of fixed size drops most fingerprints that no item has before the join; a larger benchmark fills it up and
    makes the join larger, not the result other. Null and empty texts have no words; items without id or words take no
    part; items that repeat an id count as one. Repeated rows get a result each; extra columns are not read.
    """
    items = item_fingerprints(benchmark.select("item_id", "text"), window, gram)
    lengths = items.select("least").filter(F.col("least") < window).distinct()
    short = sorted(r.least for r in lengths.collect())
    slots = items.select(F.shiftrightunsigned("fp", 64 - FILTER_BITS).alias("slot")).distinct().toArrow()
    allowed = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    slot = np.asarray(slots.column(0).combine_chunks(), np.int64)
    np.bitwise_or.at(allowed, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))

    base = _mark_documents(docs, allowed, short, window, gram)
    marked = base.filter("key is not null")
    texts = marked.select("key", "fps", "ats", "arounds").dropDuplicates(["key"])
    met = texts.select("key", F.explode(F.arrays_zip("fps", "ats", "arounds")).alias("f")).select(
        "key", F.col("f.fps").alias("fp"), F.col("f.ats").alias("doc_at"), F.col("f.arounds").alias("own")).join(items, "fp")
    spans = met.select("key", "doc_at", "own", "item_id", "least", "around").mapInArrow(_extend(window, gram), SPAN)
    extended = settle(
        spans.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
        .groupBy("key").agg(F.count_distinct("at").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")), "winnow-hits")
    clean = base.filter("key is null").select(
        "doc_id", "mark", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    rest = marked.select("doc_id", "mark", "n_words", "key").join(extended, "key", "left").select(
        "doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return clean.unionByName(rest)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, unchanged, that share no window with the benchmark. Columns may have any names; only rows that
    may be hit are moved."""
    hit = settle(contamination(docs, benchmark, window, gram).filter("n_hit > 0").select("doc_id", "mark").distinct(), "winnow-hit")
    maybe, others = parted(boxed(docs), hit)
    theirs = hit.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    same = (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return others.select("row.*").unionByName(maybe.join(theirs, same, "left_anti").select("row.*"))

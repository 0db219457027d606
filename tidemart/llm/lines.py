"""Substring deduplication by hashes of lines, paragraphs or sentences (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemart.llm.text import NOT_BLANK, mix, pieces, powers, signed, utf8, word_hashes, words
from tidemart.session import settle

MIN_WORDS = 20  # shorter units are left alone
UNITS = "doc_id long, mark long, a long, b long, start long, end long"

_IN_LINE = np.ones(256, bool)
_IN_LINE[10] = False
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True  # ! . ?
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def spans(data: np.ndarray, cuts: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each unit: a line, a run of lines between blank ones, or a sentence."""
    if unit == "sentence":
        return sentences(data, cuts)
    starts, ends, owner = words(data, cuts, _IN_LINE)
    if unit == "line" or len(starts) < 2:
        return starts, ends, owner
    # a line break alone joins two lines of a text; more than that, or a line of blanks, parts paragraphs
    filled = np.add.reduceat(NOT_BLANK[data].astype(np.int64), np.column_stack([starts, ends]).ravel()[:-1])[::2] > 0
    starts, ends, owner = starts[filled], ends[filled], owner[filled]
    if not len(starts):
        return starts, ends, owner
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (starts[1:] - ends[:-1] > 1)
    first = np.flatnonzero(fresh)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1], owner[first]


def sentences(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of words of one line up to a word that ends in a full stop, ! or ?."""
    starts, ends, owner = words(data, cuts, NOT_BLANK)
    if not len(starts):
        return starts, ends, owner
    breaks = np.cumsum(data == 10)
    last = _STOP[data[ends - 1]]
    last[:-1] |= (owner[1:] != owner[:-1]) | (breaks[starts[1:]] != breaks[ends[:-1] - 1])
    last[-1] = True
    first = np.append(True, last[:-1])
    return starts[first], ends[last], owner[first]


def digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """128 bits of each run of words first .. last-1."""
    out = []
    for factor in _FACTORS:
        up, down = powers(factor, len(hashes) + 1), powers(pow(factor, -1, 1 << 64), len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=sums[1:])
        out.append(signed(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))))
    return out


def units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """A row per unit of at least ``min_words`` words: doc_id, mark (hash of the text), digest (a, b), byte offsets.

    A unit is normalised to its blank-separated words with A-Z lower-cased; the digest is of these.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for first, data, cuts in pieces(*utf8(batch.column(2))):
                starts, ends, owner = spans(data, cuts, unit)
                word_starts, word_ends, _ = words(data, cuts, NOT_BLANK)
                low, high = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
                long = high - low >= min_words
                starts, ends, owner, low, high = (x[long] for x in (starts, ends, owner, low, high))
                a, b = digests(word_hashes(data, word_starts, word_ends), low, high)
                row = pa.array(owner + first)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.take(row), "mark": marks.take(row), "a": a, "b": b,
                                                  "start": starts - cuts[owner], "end": ends - cuts[owner]})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return keyed.mapInArrow(run, UNITS)


def deduplicate(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, removed (array of start, end: UTF-8 byte offsets in the original text) and text without these units.

    Of units with equal words the first stays, in the order of doc_id (null last), then of a hash of the text, then of
    the offset; the rest goes, with the line break (of a sentence: the blank) behind it. Sentences also find a passage
    that stands inside lines which differ around it; lines and paragraphs are found whole only. Rows with equal doc_id
    and text are one document: they get the same result, and do not repeat each other. A null text stays null, an empty
    one empty; an empty table gives no rows. Extra columns are not read.

    Only digests and offsets are grouped, folded before the shuffle; a unit on a third of all documents is one row per
    task there, and the join back meets one row per digest, which lets Spark cut a hot digest.
    """
    found = settle(units(docs, unit, min_words), "lines-units")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "start")
    first = (
        found.groupBy("a", "b").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
        .filter("first <> last").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first")
    )
    same = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    repeats = settle(
        found.join(first, same).filter(rank != F.col("first"))
        .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed")), "lines-repeats")

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("mark", F.xxhash64("text"))
    theirs = repeats.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "removed")
    joined = keyed.join(theirs, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    cut = F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return joined.select("doc_id", cut.alias("removed"), F.when(F.col("removed").isNull(), F.col("text")).otherwise(_without("text", "removed")).alias("text"))


def _without(text: str, removed: str):
    """The text without the bytes of the spans and the line break behind each."""
    binary = F.col(text).cast("binary")
    size = F.octet_length(text)
    ends = F.concat(F.transform(removed, lambda r: r["start"]), F.array(size.cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(removed, lambda r: F.least(r["end"] + 1, size.cast("long"))))
    parts = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda p: F.substring(
        binary, (p["b"] + 1).cast("int"), F.greatest(p["e"] - p["b"], F.lit(0)).cast("int")).cast("string"))
    return F.array_join(parts, "")

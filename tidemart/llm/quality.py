"""Quality: a generalised additive model with pairwise interactions over measures of the text (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemart.llm.lines import digests
from tidemart.llm.text import NOT_BLANK, give_back, pieces, runs, small_batches, utf8, word_hashes, words
from tidemart.llm.toxicity import held_out
from tidemart.session import settle

TRAIN_ROWS = 12_000  # labelled rows the model is fitted on, the first by a hash of the id
BINS = 32
PAIR_BINS = 12
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
SMOOTHING = 2.0  # added to the weight of a leaf
MIN_LEAF = 1.0  # least weight of a leaf

MEASURES = [
    "log_bytes", "log_words", "log_lines", "word_length", "line_words", "upper", "digit", "blank", "stop", "shout", "symbol",
    "beyond_ascii", "distinct_words", "commonest_word", "repeated_word", "distinct_triples", "distinct_lines",
]
_UPPER, _LOWER, _DIGIT, _BLANK, _STOP, _SHOUT, _SYMBOL, _BEYOND = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, np.uint8)
    for kind, characters in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)),
                             (_BLANK, [9, 10, 11, 12, 13, 32]), (_STOP, b".,;:'\"()-"), (_SHOUT, b"!?"), (_BEYOND, range(128, 256))):
        table[list(characters)] = kind
    return table


_CLASS = _classes()
_LINE = np.ones(256, bool)
_LINE[10] = False


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and occurrences of the commonest one, of each text."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[first], size)
    return np.bincount(o[first], minlength=n), most


def measure(column: pa.Array) -> np.ndarray:
    """A row of ``MEASURES`` per text, of the whole text; null and empty texts measure 0 throughout."""
    out = np.zeros((len(column), len(MEASURES)))
    data, bounds = utf8(column)
    for first, piece, cuts in pieces(data, bounds):
        n = len(cuts) - 1
        size = np.diff(cuts)
        text_of = np.repeat(np.arange(n, dtype=np.int32), size)
        kinds = np.bincount(text_of * 8 + _CLASS[piece], minlength=n * 8).reshape(n, 8)
        starts, ends, owner = words(piece, cuts, NOT_BLANK)
        hashes = word_hashes(piece, starts, ends)
        count = np.bincount(owner, minlength=n)
        kinds_of_words, commonest = _distinct(hashes, owner, n)
        same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
        triples, at = runs(hashes, owner, 3)
        triple_count = np.bincount(owner[at], minlength=n)
        triple_kinds, _ = _distinct(triples, owner[at], n)
        line_starts, line_ends, line_owner = words(piece, cuts, _LINE)
        low, high = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
        line_key = digests(hashes, low, high)[0].view(np.uint64)  # of all words of the line
        lines = np.bincount(line_owner, minlength=n)
        line_kinds, _ = _distinct(line_key, line_owner, n)
        part = lambda a, b: a / np.maximum(b, 1)
        letters = kinds[:, _UPPER] + kinds[:, _LOWER]
        out[first:first + n] = np.column_stack([
            np.log1p(size), np.log1p(count), np.log1p(lines), part(np.bincount(owner, ends - starts, n), count), part(count, lines),
            part(kinds[:, _UPPER], letters), part(kinds[:, _DIGIT], size), part(kinds[:, _BLANK], size), part(kinds[:, _STOP], size),
            part(kinds[:, _SHOUT], size), part(kinds[:, _SYMBOL], size), part(kinds[:, _BEYOND], size), part(kinds_of_words, count),
            part(commonest, count), part(np.bincount(owner[same], minlength=n), count), part(triple_kinds, triple_count), part(line_kinds, lines)])
    return out


# -- the model --------------------------------------------------------------------------------

@dataclass
class Model:
    constant: float
    edges: list[np.ndarray]  # of the bins of each measure
    tables: list[np.ndarray]  # an addition per bin
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]  # two measures, an addition per pair of coarse bins

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.constant)
        for column, edges, table in zip(x.T, self.edges, self.tables):
            z += table[np.searchsorted(edges, column, "right")]
        if self.pairs:
            coarse = [np.searchsorted(edges, column, "right") for column, edges in zip(x.T, self.pair_edges)]
            for i, j, table in self.pairs:
                z += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= MIN_LEAF, g / (h + SMOOTHING), 0.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= MIN_LEAF, g * g / (h + SMOOTHING), 0.0)


def _cut(g: np.ndarray, h: np.ndarray) -> int:
    """Number of bins left of the best split."""
    if len(g) < 2:
        return len(g)
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    return int(np.argmax(gains)) + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on the bins of one measure, as an addition per bin."""
    out = np.zeros(len(g))
    middle = _cut(g, h)
    for a, b in ((0, middle), (middle, len(g))):
        c = a + _cut(g[a:b], h[a:b])
        for low, high in ((a, c), (c, b)):
            if high > low:
                out[low:high] = _leaf(g[low:high].sum(), h[low:high].sum())
    return out


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid of bins into four quarters: its gain and an addition per cell."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, rows, columns, total = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, rows - a, columns - a, total - rows - columns + a]

    gs, hs = quarters(cg), quarters(ch)
    gains = sum(_gain(x, y) for x, y in zip(gs, hs))
    i, j = np.unravel_index(np.argmax(gains), gains.shape)
    out = np.empty(g.shape)
    for (rows, columns), x, y in zip(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)),
                                      (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gs, hs):
        out[rows, columns] = _leaf(x[i, j], y[i, j])
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the measures in turn, a shallow tree each time; then, on what is left, the pairs that gain most, likewise."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    constant = float(np.log(share / (1 - share)))
    n = x.shape[1]
    if not len(y) or y.min() == y.max():
        return Model(constant, [np.zeros(0)] * n, [np.zeros(1)] * n, [np.zeros(0)] * n, [])
    edges = [_edges(c, BINS) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), constant)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(n):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])))
            tables[f] += step
            z += step[bins[f]]

    pair_edges = [_edges(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(pair_edges, x.T)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(pair_edges[i]) + 1, len(pair_edges[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(n), 2), key=lambda p: -_corner(grid(*p, g), grid(*p, h))[0])[:PAIRS]
    pairs = [(i, j, np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1))) for i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            g, h = slopes()
            step = RATE * _corner(grid(i, j, g), grid(i, j, h))[1]
            table += step
            z += step[coarse[i], coarse[j]]
    return Model(constant, edges, tables, pair_edges, pairs)


# -- Spark ------------------------------------------------------------------------------------

def train(docs: DataFrame, labels: DataFrame, kept: Column, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows; null or other labels, and ids with both labels, are left out."""
    sample = (
        labels.filter(kept & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_max")).filter("label = _max").drop("_max")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "label": batch.column(1), "x": pa.array(list(measure(batch.column(2))), pa.list_(pa.float64()))})

    table = (
        docs.filter("text is not null").join(F.broadcast(sample), "doc_id")
        .select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text")
        .mapInArrow(extract, "doc_id long, label int, x array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    )
    x = np.array(table.column(2).to_pylist(), float).reshape(-1, len(MEASURES))
    return fit(x, np.array(table.column(1).to_pylist(), float))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7,
                  rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every row of ``docs``.

    Only rows of ``labels`` (doc_id, quality) outside the held-out fold are learned from; a score depends on the text
    alone. Null and empty texts have the same score; without labels of both classes every score is the share of good
    labels (0.5 without any). Repeated rows are scored alike; extra columns are not read. Empty tables give no rows.
    """
    kept = ~held_out(F.col("doc_id"), folds, fold)
    model = train(docs.select("doc_id", "text").filter(kept), labels.select("doc_id", "quality"), kept, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(measure(batch.column(2)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(1), "score": scores,
                "predicted": (scores >= threshold).astype(np.int32)})

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    return rows_in.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``score_quality`` predicts to be good. Nothing is shuffled; the rows are written
    here, so that the texts travel to Python and back in small batches."""
    kept = ~held_out(F.col("doc_id"), folds, fold)
    model = train(docs.select("doc_id", "text").filter(kept), labels.select("doc_id", "quality"), kept, rows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(measure(batch.column(at))) >= threshold))
        give_back()

    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # columns may have any names
    with small_batches(docs.sparkSession):
        return settle(numbered.mapInArrow(run, numbered.schema), "quality-kept").toDF(*docs.columns)

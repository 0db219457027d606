"""Hard negatives of anchors by a vertical scan with shrinking candidate bitmaps (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemart.llm.text import small_batches
from tidemart.session import scratch_dir, settle

SCALE = 256
BLOCK_ROWS = 4096
BLOCKS_SENT = 16  # to Python at a time
STEP = 8  # dimensions that are read between two tests of the candidates
ANCHOR_BYTES = 8 << 20  # a list of anchors that travels to the tasks; a longer one takes several rounds
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score between which a negative's lies
EXACT = 1 << 53
LONG_MAX = (1 << 63) - 1
NO_ID = LONG_MAX  # a null vec_id, which sorts last

BLOCK = "rows binary, ids binary, labels binary, columns binary, least binary, most binary, dims int"
HIT = "anchor_row long, positive_no int, row long, vec_id long, score long"


def labelled_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own for every row), vec_id, label and vector: floor(scale * x) of each component x as double.

    Rows with a null label or vector, or with a null or non-finite component, are left out. Where vec_id is divisible by
    7, the label is (label + 1) % 10. The result is written, so that the numbers stay.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    kept = (
        embeddings.select("vec_id", "label", "embedding").filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
        .select(F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"),
                F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("vector"))
    )
    return settle(kept, "negatives-vectors")


def _matrix(column: pa.Array, dims: int = 0) -> np.ndarray:
    """A list column as a matrix of at least ``dims`` columns; shorter vectors are filled up with zeros."""
    rows = [np.asarray(column[i].values) for i in range(len(column))]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID), np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            vectors = _matrix(part.column(3))
            yield pa.RecordBatch.from_pydict({
                "rows": [np.asarray(part.column(0), np.int64).tobytes()], "ids": [_ids(part.column(1)).tobytes()],
                "labels": [np.asarray(part.column(2), np.int64).tobytes()], "columns": [np.ascontiguousarray(vectors.T).tobytes()],
                "least": [vectors.min(0).tobytes()], "most": [vectors.max(0).tobytes()], "dims": pa.array([vectors.shape[1]], pa.int32())})


def vertical(vectors: DataFrame) -> DataFrame:
    """Blocks of rows stored dimension by dimension, with the least and most of each."""
    return settle(vectors.select("row", "vec_id", "label", "vector").mapInArrow(_pack, BLOCK), "negatives-blocks")


class Block:
    def __init__(self, rows: bytes, ids: bytes, labels: bytes, columns: bytes, least: bytes, most: bytes, dims: int):
        self.rows, self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (rows, ids, labels))
        self.columns = np.frombuffer(columns, np.int64).reshape(dims, len(self.rows))
        self.least, self.most, self.dims = np.frombuffer(least, np.int64), np.frombuffer(most, np.int64), dims
        self.floats = self.columns.astype(np.float64)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, may) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and exact scores of the candidates that ``may(least, most)``, given what each score can still become,
        leaves over, and how many components were read.

        Dimensions are read in falling order of the anchor's magnitudes, ``STEP`` at a time, for the candidates left.
        """
        d = min(self.dims, len(anchor))
        q, least, most = anchor[:d].astype(object), self.least[:d].astype(object), self.most[:d].astype(object)
        kind = np.float64 if sum(abs(a) * max(abs(x), abs(y)) for a, x, y in zip(q, least, most)) < EXACT else object
        columns = self.floats if kind is np.float64 else self.columns.astype(object)
        q, least, most = q.astype(kind), least.astype(kind), most.astype(kind)
        order = np.argsort(-np.abs(anchor[:d].astype(np.float64)), kind="stable")
        ends = np.stack([q * least, q * most])
        worst, best = ends.min(0)[order], ends.max(0)[order]
        at = np.flatnonzero(bitmap)
        score, read = np.zeros(len(at), kind), 0
        for first in range(0, d, STEP):
            if not len(at):
                break
            some = order[first:first + STEP]
            part = columns[some] if len(at) == len(self.rows) else columns[np.ix_(some, at)]
            score = score + q[some] @ part
            read += part.size
            left = slice(first + STEP, None)
            kept = may(score + worst[left].sum(), score + best[left].sum())
            if not kept.all():
                at, score = at[kept], score[kept]
        if d and len(at):
            kept = may(score, score)
            at, score = at[kept], score[kept]
        if kind is object:
            score = np.array([max(min(int(s), LONG_MAX), -LONG_MAX - 1) for s in score], object)
        return at, score.astype(np.int64), read


class Best:
    """The first rows by falling score, ties by vec_id, of those seen so far."""

    def __init__(self, size: int):
        self.size, self.full, self.floor = size, False, -float("inf")
        self.rows = self.ids = self.scores = np.zeros(0, np.int64)

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        rows, ids, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.ids, ids), (self.scores, scores)))
        first = np.lexsort((rows, ids, -scores.astype(np.float64), )) if np.abs(scores.astype(np.float64)).max() < EXACT else np.array(
            sorted(range(len(rows)), key=lambda i: (-int(scores[i]), ids[i], rows[i])))
        first = first[:self.size]
        self.rows, self.ids, self.scores = rows[first], ids[first], scores[first]
        self.full = len(first) == self.size
        if self.full:
            self.floor = int(self.scores[-1])


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest; with fewer values, less than any."""
    return np.partition(values, -k)[-k] if len(values) >= k else -float("inf")


def find_positives(block: Block, row: int, label: int, anchor: np.ndarray, best: Best) -> int:
    """Take the block's rows of the anchor's label that can still be among the first; how many components were read."""
    def may(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most >= max(best.floor, _kth(least, best.size))

    at, score, read = block.scan(anchor, (block.labels == label) & (block.rows != row), may)
    best.take(block.rows[at], block.ids[at], score)
    return read


def find_negatives(block: Block, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], bests: list[Best]) -> int:
    """Take the block's rows of other labels whose score lies in a window and can still be among its first."""
    def may(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(least), bool)
        for (low, high), best in zip(windows, bests):
            inside = (least >= low) & (most <= high)
            kept |= (most >= max(low, best.floor, _kth(least[inside], best.size))) & (least <= high)
        return kept

    at, score, read = block.scan(anchor, block.labels != label, may)
    for (low, high), best in zip(windows, bests):
        fits = (score >= max(low, best.floor)) & (score <= high)
        best.take(block.rows[at[fits]], block.ids[at[fits]], score[fits])
    return read


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and most whole n with low * score <= 100 * n <= high * score; none below zero, where these cross."""
    return -(-low * score // 100), high * score // 100


Anchors = list[tuple[int, int, np.ndarray]]  # row, label, vector


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for fields in zip(*(c.to_pylist() for c in batch.columns)):
            yield Block(*fields)


def _hits(found: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    sizes = [len(b.rows) for _, _, b in found]
    parts = [np.concatenate([np.zeros(0, np.int64), *[getattr(b, name) for _, _, b in found]]) for name in ("rows", "ids", "scores")]
    return pa.RecordBatch.from_pydict({
        "anchor_row": np.repeat(np.array([a for a, _, _ in found], np.int64), sizes),
        "positive_no": pa.array(np.repeat(np.array([p for _, p, _ in found], np.int64), sizes), pa.int32()),
        "row": parts[0], "vec_id": pa.array(parts[1], pa.int64(), mask=parts[1] == NO_ID), "score": parts[2]})


def _positives(anchors: Anchors, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(count) for _ in anchors]
        for block in _blocks(batches):
            for (row, label, vector), best in zip(anchors, bests):
                find_positives(block, row, label, vector, best)
        yield _hits([(a[0], 0, b) for a, b in zip(anchors, bests)])

    return run


def _negatives(anchors: Anchors, windows: dict[int, list[tuple[int, int, int]]], count: int):
    """``windows``: of an anchor's row the number, least and most score of each positive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = {row: [Best(count) for _ in windows[row]] for row, _, _ in anchors if row in windows}
        for block in _blocks(batches):
            for row, label, vector in anchors:
                if row in bests:
                    find_negatives(block, label, vector, [w[1:] for w in windows[row]], bests[row])
        yield _hits([(row, w[0], b) for row, own in bests.items() for w, b in zip(windows[row], own)])

    return run


def _first(hits: DataFrame, keys: list[str], count: int, rank: str) -> DataFrame:
    spec = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn(rank, F.row_number().over(spec)).filter(F.col(rank) <= count)


def mine(
    spark: SparkSession, vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for ``labelled_vectors``.

    An anchor's positives are the first rows of its label other than itself, by falling inner product, then vec_id (null
    last). For each, the first rows of other labels with low * positive <= 100 * negative <= high * positive follow. Every
    row is a candidate, repeated ones too. Fewer rows give fewer results; an anchor without positives, or a positive with
    a negative score, gives none. Missing components count as zero; scores beyond 64 bits are clipped.

    Anchors travel to the blocks in rounds of ``ANCHOR_BYTES``, one broadcast at a time; every block is searched for
    every anchor, and a task hands on so many rows per anchor and positive as are asked for.
    """
    blocks = vertical(vectors)
    facts = vectors.filter(is_anchor).agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    rounds = max(1, -(-facts[1] * max(facts[0] or 1, 1) * 8 // ANCHOR_BYTES))
    listed = settle(vectors.filter(is_anchor).withColumn("round", F.pmod(F.xxhash64("row"), F.lit(rounds)).cast("int")), "negatives-anchors")
    chosen, found = scratch_dir(spark, "negatives-positives"), scratch_dir(spark, "negatives-hits")
    spark.createDataFrame([], f"{HIT}, no int").write.parquet(chosen)
    spark.createDataFrame([], HIT).write.parquet(found)
    with small_batches(spark, BLOCKS_SENT):
        for number in range(rounds):
            part = listed.filter(F.col("round") == number).select("row", "label", "vector").toArrow()
            anchors = [(r["row"], r["label"], np.array(r["vector"], np.int64)) for r in part.to_pylist()]
            if not anchors:
                continue
            best = settle(_first(blocks.mapInArrow(_positives(anchors, positives), HIT), ["anchor_row"], positives, "no"), "negatives-best")
            best.write.mode("append").parquet(chosen)
            windows: dict[int, list[tuple[int, int, int]]] = {}
            for r in best.select("anchor_row", "no", "score").toArrow().to_pylist():  # so many per anchor as are asked for
                least, most = window_of(r["score"], low, high)
                if least <= most:
                    windows.setdefault(r["anchor_row"], []).append((r["no"], least, most))
            if windows:
                blocks.mapInArrow(_negatives(anchors, windows, negatives), HIT).write.mode("append").parquet(found)
    theirs = spark.read.schema(f"{HIT}, no int").parquet(chosen).select(
        "anchor_row", F.col("no").alias("positive_no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ranked = _first(spark.read.schema(HIT).parquet(found), ["anchor_row", "positive_no"], negatives, "rank").select(
        "anchor_row", "positive_no", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = listed.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(theirs, ["anchor_row", "positive_no"]).join(named, "anchor_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

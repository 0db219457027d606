"""Exact top-k inner products with blocks of documents that are skipped by their bounds (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemart.session import scratch_dir, settle

BLOCK_ROWS = 256
QUERY_BYTES = 16 << 20  # a block of queries that travels to the tasks; longer query lists take several rounds
EXACT = 1 << 53

INDEX = "ids binary, vectors binary, top binary, dims int"
HIT = "query_id long, vec_id long, score long"


def quantise(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and vector: floor(scale * x) of each component, x as double.

    Rows without vec_id, and vectors that are null or hold a null or non-finite component, are left out. Of several
    vectors with one vec_id the smallest counts, once.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    return (
        embeddings.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))
        .groupBy("vec_id").agg(F.min("vector").alias("vector"))
    )


def build_index(vectors: DataFrame) -> DataFrame:
    """Blocks of up to ``BLOCK_ROWS`` documents: a forward index (all vectors) and the maxima of its terms.

    A component is two terms, one for positive and one for negative weights, so maxima bound any inner product. Blocks
    are ranges of documents sorted by their strongest component, which makes the vectors of a block alike and its maxima
    tight; vec_id comes last in the sort, so one very common vector spreads over many tasks.
    """
    size = F.transform("vector", F.abs)
    at = F.array_position(size, F.array_max(size)).cast("int")
    value = F.when(at > 0, F.get("vector", at - 1))
    by = [F.col("_side"), F.col("_value"), F.col("vec_id")]
    sorted_rows = (
        vectors.withColumns({"_side": at * F.signum(value), "_value": value})
        .repartitionByRange(*by).sortWithinPartitions(*by).select("vec_id", "vector")
    )
    return settle(sorted_rows.mapInArrow(_blocks, INDEX), "topk-index")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    rows = [np.asarray(column[i].values) for i in range(len(column))]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            ids, vectors = np.asarray(part.column(0), np.int64), _matrix(part.column(1))
            top = np.concatenate([vectors.max(0, initial=0), (-vectors).max(0, initial=0)])
            yield pa.RecordBatch.from_pydict(
                {"ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "top": [top.tobytes()],
                 "dims": pa.array([vectors.shape[1]], pa.int32())})


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers, clipped to 64 bits."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * d < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Search:
    """The best k of the blocks seen so far, for each query of one block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.queries, self.floor, self.k = ids, queries, floor.copy(), k
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), -1)
        self.count = np.zeros(len(ids), np.int64)

    def bounds(self, tops: list[np.ndarray]) -> np.ndarray:
        up, down = np.maximum(self.queries, 0), np.maximum(-self.queries, 0)
        out = np.empty((len(self.ids), len(tops)), np.int64)
        for i, top in enumerate(tops):
            half = len(top) // 2
            one, two = _product(up, top[None, :half])[:, 0], _product(down, top[None, half:])[:, 0]
            out[:, i] = np.clip(one.astype(float) + two, -9e18, 9e18) if max(one.max(initial=0), two.max(initial=0)) > 1 << 61 else one + two
        return out

    def take(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ranks: int | None = None) -> None:
        """Score blocks for each query in falling order of their bounds, until these are below its k-th score."""
        bounds = self.bounds([top for _, _, top in blocks])
        order = np.argsort(-bounds, axis=1, kind="stable")
        for rank in range(len(blocks) if ranks is None else min(ranks, len(blocks))):
            block = order[:, rank]
            live = bounds[np.arange(len(block)), block] >= self.floor
            if not live.any():
                break
            for b in np.unique(block[live]):
                self._score(np.flatnonzero(live & (block == b)), blocks[b])

    def _score(self, rows: np.ndarray, block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        ids, vectors, _ = block
        scores = _product(self.queries[rows], vectors)
        fits = (scores >= self.floor[rows, None]) & (ids[None, :] != self.ids[rows, None])
        some = fits.any(1)
        for row, s, f in zip(rows[some], scores[some], fits[some]):
            n = self.count[row]
            all_scores = np.concatenate([self.scores[row, :n], s[f]])
            all_ids = np.concatenate([self.found[row, :n], ids[f]])
            best = np.lexsort((all_ids, -all_scores))[:self.k]
            n = self.count[row] = len(best)
            self.scores[row, :n], self.found[row, :n] = all_scores[best], all_ids[best]
            if n == self.k:
                self.floor[row] = max(self.floor[row], self.scores[row, -1])


def _decode(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for ids, vectors, top, dims in zip(*(c.to_pylist() for c in batch.columns)):
        ids = np.frombuffer(ids, np.int64)
        out.append((ids, np.frombuffer(vectors, np.int64).reshape(len(ids), dims), np.frombuffer(top, np.int64)))
    return out


def _searcher(ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(ids, queries, floor, k)
        for batch in batches:
            blocks = _decode(batch)
            for at in range(0, len(blocks), 64):
                search.take(blocks[at:at + 64], 1 if probe else None)
        if probe:
            full = np.flatnonzero(search.count == k)
            yield pa.RecordBatch.from_pydict({"query_id": ids[full], "vec_id": ids[full], "score": search.scores[full, -1]})
            return
        held = np.arange(k)[None, :] < search.count[:, None]
        yield pa.RecordBatch.from_pydict({
            "query_id": np.repeat(ids, search.count), "vec_id": search.found[held], "score": search.scores[held]})

    return run


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to the smaller vec_id.

    ``vectors`` and ``queries`` hold (vec_id, vector of whole numbers), each vec_id once; a query does not find its own
    vec_id. Shorter vectors count as zero in the missing components; an empty one scores 0. Fewer than k others give
    fewer rows; an empty table or query set gives none. Scores beyond 64 bits are clipped.

    Queries travel to the index in rounds of ``QUERY_BYTES``; a first pass over each task's most promising block gives
    every query a k-th score to start from, the second pass prunes with it. Each task hands on k rows per query at most.
    """
    index = build_index(vectors)
    dims = queries.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    rounds = max(1, -(-dims[1] * max(dims[0] or 1, 1) * 8 // QUERY_BYTES))
    listed = settle(queries.withColumn("round", F.pmod(F.xxhash64("vec_id"), F.lit(rounds)).cast("int")), "topk-queries")
    folder = scratch_dir(spark, "topk-hits")
    spark.createDataFrame([], HIT).write.mode("append").parquet(folder)
    for number in range(rounds):
        part = listed.filter(F.col("round") == number).select("vec_id", "vector").toArrow()
        if not part.num_rows:
            continue
        ids, matrix = np.asarray(part.column(0).combine_chunks(), np.int64), _matrix(part.column(1).combine_chunks())
        order = np.argsort(ids)
        ids, matrix = ids[order], matrix[order]
        floor = np.full(len(ids), np.iinfo(np.int64).min)
        first = index.mapInArrow(_searcher(ids, matrix, floor, k, True), HIT).groupBy("query_id").agg(F.max("score").alias("score")).toArrow()
        floor[np.searchsorted(ids, np.asarray(first.column(0).combine_chunks(), np.int64))] = np.asarray(first.column(1).combine_chunks(), np.int64)
        index.mapInArrow(_searcher(ids, matrix, floor, k, False), HIT).write.mode("append").parquet(folder)
    spec = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        spark.read.schema(HIT).parquet(folder).withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

"""Nearest vectors: every query vector against a corpus of vectors, exact.

Scores are matrix products inside tasks (numpy over Arrow batches), and each task hands on only its
best ``k`` per query, so what is shuffled is k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemart.fixed_values import CONCEPT_THRESHOLD
from tidemart.functions.columns import round_half_up
from tidemart.operators.keys import per_key
from tidemart.session import scratch_dir, settle

BLOCK_BYTES = 32 << 20  # vectors of one block of queries, as doubles
GROUP_ROWS = 20_000  # rows of one category, of either side, that meet in one group
CELLS = 1 << 22  # scores a task holds at a time
SLACK = 1e-9  # what matrix products may be off, relative to the size of the terms; the exact scores decide
_HIT = "query_id bigint, id bigint, score double"


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def _quick(queries: np.ndarray, corpus: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """queries x corpus by matrix products, a higher score being nearer, and how far each may be off."""
    dots = queries @ corpus.T
    if metric == "cosine":
        norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(corpus, axis=1)[None, :]
        return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), np.full_like(dots, SLACK)
    squares = (queries**2).sum(1)[:, None] + (corpus**2).sum(1)[None, :]
    return 2 * dots - squares, SLACK * squares


def _exact(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs, row by row: differences are taken before they are squared, and equal pairs score alike."""
    if metric == "cosine":
        norms = np.sqrt((queries**2).sum(1)) * np.sqrt((corpus**2).sum(1))
        dots = (queries * corpus).sum(1)
        return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    return -((queries - corpus) ** 2).sum(1)


def _best(qids, qvec, ids, vecs, k, metric) -> pd.DataFrame:
    """The k best corpus rows of this batch for each query; ties by id."""
    found = []
    step = max(1, CELLS // max(1, len(qids)))
    for at in range(0, len(ids), step):
        part = slice(at, at + step)
        scores, off = _quick(qvec, vecs[part], metric)
        width = scores.shape[1]
        sure = scores - off
        least = np.partition(sure, width - k, axis=1)[:, width - k] if width > k else np.full(len(qids), -np.inf)
        q, c = np.nonzero(scores + off >= least[:, None])  # k per query, and all that may be as good
        for first in range(0, len(q), CELLS // max(1, qvec.shape[1]) + 1):
            some = slice(first, first + CELLS // max(1, qvec.shape[1]) + 1)
            found.append(pd.DataFrame({
                "query_id": qids[q[some]], "id": ids[part][c[some]], "score": _exact(qvec[q[some]], vecs[part][c[some]], metric)}))
    hits = pd.concat(found).sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    return hits.groupby("query_id", sort=False).head(k)


def _rows_per_block(width: int | None) -> int:
    return max(1, BLOCK_BYTES // (8 * max(1, width or 1)))


def _rounds(queries: DataFrame, key: str, block_rows: int | None) -> Iterator[pa.Table]:
    """The queries in blocks of bounded size, one after the other."""
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n // (block_rows or _rows_per_block(width))))
    listed = settle(queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), "vector-queries")
    for block in range(blocks):
        rows = listed.filter(F.col("_block") == block).drop("_block").orderBy(key).toArrow()
        if rows.num_rows:
            yield rows


def _in_rounds(spark: SparkSession, rounds: Iterator, score, schema: str) -> DataFrame:
    """Hits of all rounds, each written before the next begins, so that one broadcast lives at a time."""
    folder = scratch_dir(spark, "vector-hits")
    spark.createDataFrame([], schema).write.parquet(folder)
    for content in rounds:
        shared = spark.sparkContext.broadcast(content)
        score(shared).write.mode("append").parquet(folder)
        shared.destroy()
    return spark.read.schema(schema).parquet(folder)


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    metric: str = "cosine",
    same_category: bool = False,
    digits: int = 6,
    block_rows: int | None = None,
) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest corpus vectors of each query.

    ``queries`` is (query_id, vector[, category]), ``corpus`` is (id, vector[, category]). ``metric`` is
    `cosine` (0 when a vector has no length) or `l2`, whose score is minus the squared distance. Ranks follow the
    scores as they are; only the score that is returned is rounded to ``digits``.
    ``same_category`` keeps only corpus rows of the query's category.

    Queries travel to the corpus in rounds of ``block_rows`` (by default what fits ``BLOCK_BYTES``), so the corpus is
    read once per round and never shuffled. With categories both sides are shuffled by category instead, and a query
    meets its own category only.
    """
    spark = corpus.sparkSession
    if same_category:
        hits = _by_category(queries, corpus, k, metric, block_rows)
    else:
        rounds = (
            (np.asarray(r.column("query_id").combine_chunks(), np.int64), _matrix(r.column("vector").to_pylist()))
            for r in _rounds(queries.select("query_id", "vector"), "query_id", block_rows))
        hits = _in_rounds(
            spark, rounds, lambda shared: corpus.select("id", "vector").mapInPandas(_scorer(shared, k, metric), _HIT), _HIT)
    spec = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = hits.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= k)
    return best.withColumn("score", round_half_up(F.col("score"), digits))


def _scorer(shared, k: int, metric: str):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qvec = shared.value
        for batch in batches:
            if len(batch):
                yield _best(qids, qvec, batch["id"].to_numpy(), _matrix(batch["vector"]), k, metric)

    return score


def _by_category(queries: DataFrame, corpus: DataFrame, k: int, metric: str, block_rows: int | None) -> DataFrame:
    """The k best of each query within parts of its category.

    A category is dealt into parts of ``GROUP_ROWS`` corpus rows and of so many queries; every part of the corpus meets
    every part of the queries of its category in a group of its own, so no group grows with the data, whatever the
    largest category holds. Categories that only one side has are not moved on.
    """
    def parts(rows: DataFrame, name: str, size: int) -> DataFrame:
        return per_key(rows.filter(F.col("category").isNotNull()), "category", F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    asked, held = parts(queries, "_asked", block_rows or GROUP_ROWS), parts(corpus, "_held", block_rows or GROUP_ROWS)
    sizes = settle(asked.join(held, "category"), "vector-categories")

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        met = rows.select(key, "vector", "category").join(sizes, "category")
        return met.withColumn(own, F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]).empty_table()
        qids, ids = (np.asarray(t.column(c).combine_chunks(), np.int64) for t, c in ((left, "query_id"), (right, "id")))
        found = _best(qids, _matrix(left.column("vector").to_pylist()), ids, _matrix(right.column("vector").to_pylist()), k, metric)
        return pa.Table.from_pandas(found[["query_id", "id", "score"]], preserve_index=False)

    keys = ["category", "_asked", "_held"]
    asking, holding = dealt(queries, "query_id", "_asked", "_held"), dealt(corpus, "id", "_held", "_asked")
    return asking.groupBy(*keys).cogroup(holding.groupBy(*keys)).applyInArrow(score, _HIT)


def nearest_concept(
    vectors: DataFrame, concepts: DataFrame, columns: DataFrame, threshold: float = CONCEPT_THRESHOLD, digits: int = 6
) -> DataFrame:
    """Each vector's best concept where the cosine is above ``threshold``, with the concept's column.

    ``vectors`` is (id, vector); ``concepts`` is (concept, vector), ``columns`` is (concept, column_name).
    Concepts travel to the vectors in rounds of ``BLOCK_BYTES``; each vector keeps its best one, ties by name.
    """
    spark, schema = vectors.sparkSession, "id bigint, concept string, score double"
    rounds = (
        (np.array(r.column("concept").to_pylist(), dtype=object), _matrix(r.column("vector").to_pylist()))
        for r in _rounds(concepts.select("concept", "vector"), "concept", None))
    hits = _in_rounds(spark, rounds, lambda shared: vectors.select("id", "vector").mapInPandas(_namer(shared), schema), schema)
    best = hits.groupBy("id").agg(F.min_by(F.struct("concept", "score"), F.struct(-F.col("score"), F.col("concept"))).alias("best"))
    return (
        best.select("id", "best.concept", "best.score").filter(F.col("score") > threshold).join(columns, "concept")
        .select("id", "concept", "column_name", round_half_up(F.col("score"), digits).alias("score"))
    )


def _namer(shared):
    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, matrix = shared.value
        numbers = np.arange(len(labels))
        for batch in batches:
            if len(batch):
                rows = np.arange(len(batch))
                hits = _best(rows, _matrix(batch["vector"]), numbers, matrix, 1, "cosine")
                yield pd.DataFrame({"id": batch["id"].to_numpy()[hits["query_id"].to_numpy(np.int64)],
                                    "concept": labels[hits["id"].to_numpy(np.int64)], "score": hits["score"].to_numpy()})

    return name


def centroids(vectors: DataFrame, group: str, digits: int = 6) -> DataFrame:
    """(group, vector): the mean vector of each group, averaged per dimension before anything is gathered."""
    cells = vectors.select(group, F.posexplode("vector").alias("i", "x"))
    means = cells.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rounded = round_half_up(F.col("m"), digits)
    ordered = F.sort_array(F.collect_list(F.struct("i", rounded.alias("x"))))
    return means.groupBy(group).agg(F.transform(ordered, lambda c: c["x"]).alias("vector"))

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemart.llm import topk


def brute(vectors, k):
    out = []
    for q, v in vectors.items():
        if q % 100:
            continue
        scores = sorted((-max(min(sum(a * b for a, b in zip(v, w)), (1 << 63) - 1), -(1 << 63)), c) for c, w in vectors.items() if c != q)
        out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def search(spark, rows, k=10, schema="vec_id long, embedding array<double>, rank int, score int"):
    vectors = topk.quantise(spark.createDataFrame([(*r, 1, 2) for r in rows], schema)).cache()
    got = topk.top_k(spark, vectors, vectors.filter(F.col("vec_id") % 100 == 0), k)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("query_bytes", [topk.QUERY_BYTES, 700])
def test_against_brute_force(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(topk, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=5).tolist()) for i in rng.permutation(700)]
    rows[::3] = [(i, rows[0][1]) for i, _ in rows[::3]]  # one vector on a third of all rows: ties
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    assert search(spark, rows) == brute(vectors, 10)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [0.5]), (2, []), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [9.0, 9.0]),
            (7, [-0.0005, 0.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [3.0, 1.0, 5.0]), (9, [0.0, 1.0]), (100, [2.0, -1.0])]
    vectors = {0: [1024, 2048], 1: [512], 2: [], 7: [-1, 0], 8: [1024, 2048], 9: [0, 1024], 100: [2048, -1024]}
    assert search(spark, rows, 4) == brute(vectors, 4)
    assert len(search(spark, rows[:3], 10)) == 2
    assert search(spark, []) == [] and search(spark, [(1, [1.0])]) == []


def test_huge_components(spark):
    rows = [(0, [3e12, 1.0]), (1, [2e12, 1.0]), (2, [-2e12, 5.0]), (3, [1e15, 0.0])]
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    assert search(spark, rows) == brute(vectors, 10)


def test_blocks_are_skipped(monkeypatch):
    """Blocks whose bound is below the k-th score are not scored."""
    rng = np.random.default_rng(3)
    blocks = []
    for b in range(20):
        vectors = np.floor(rng.normal(size=(50, 4)) * 50 + (1000 if b == 7 else 0)).astype(np.int64)
        blocks.append((np.arange(b * 50, b * 50 + 50), vectors, np.concatenate([vectors.max(0).clip(0), (-vectors).max(0).clip(0)])))
    search = topk.Search(np.array([-1]), np.full((1, 4), 100), np.full(1, np.iinfo(np.int64).min), 10)
    scored = []
    monkeypatch.setattr(topk.Search, "_score", lambda self, rows, block, f=topk.Search._score: (scored.append(block[0][0]), f(self, rows, block)))
    search.take(blocks)
    assert scored == [350]
    every = np.concatenate([b[1] for b in blocks]).sum(1) * 100
    assert sorted(search.scores[0].tolist()) == sorted(np.sort(every)[-10:].tolist())

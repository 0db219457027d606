import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemart.llm import centroids, negatives

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, row int, distance int"


def table(spark, rows):
    """(vec_id, embedding, label) with further columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


# -- centroids --------------------------------------------------------------------------------

def brute_clusters(rows, clusters, rounds, dims, scale=64, seed=1):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == dims and all(x is not None and abs(x) < INF for x in v)]
    kept = [(i, [max(min(x, 2**63 - 1), -2**63) for x in v]) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [v for _, v in first[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(middle)):
            mine = [v for (_, v), c in zip(kept, own) if c == n]
            if mine:
                middle[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    top = 2**63 - 1
    within = {n: sum(min(d, top) for _, d, c in found if c == n) for n in range(len(middle))}
    return sorted(((i, c, min(d, top), min(within[c], top), min(sum(within.values()), top),
                    hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, d, c in found), key=repr)


def found_clusters(spark, rows, **options):
    return sorted(map(tuple, centroids.cluster(table(spark, rows), **options).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_clusters_against_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=6) + spread * (i % 4)).tolist(), 0) for i in rng.permutation(400)]
    rows[::3] = [(i, rows[0][1], 0) for i, _, _ in rows[::3]]  # one vector on a third of all rows
    rows += rows[5:8]  # repeated rows
    assert found_clusters(spark, rows, dims=6) == brute_clusters(rows, 16, 3, 6)


def test_clusters_of_small_whole_numbers_have_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), (rng.integers(-1, 2, size=3) / 64).tolist(), 0) for i in range(150)]
    assert found_clusters(spark, rows, dims=3, clusters=7) == brute_clusters(rows, 7, 3, 3)


def test_clusters_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], None), (2, [1.0], 0), (3, None, 0), (4, [1.0, None], 0), (5, [NAN, 1.0], 0), (6, [INF, 1.0], 0),
            (None, [-0.001, 3.0], 0), (7, [], 0), (8, [1.0, 2.0, 3.0], 0), (9, [-4.0, 0.0], 0), (9, [2.0, 0.5], 0)]
    for k in (2, 16):
        assert found_clusters(spark, rows, dims=2, clusters=k) == brute_clusters(rows, k, 3, 2)
    assert found_clusters(spark, rows[1:6], dims=2) == [] and found_clusters(spark, []) == []


def test_clusters_of_huge_components(spark):
    rows = [(i, [x, -x / 3, 1.0], 0) for i, x in enumerate([1e3, 1e9, 2e9, 5e12, 1e15, 3e16, 1e18, -1e18, 0.0, 7e9])]
    assert found_clusters(spark, rows, dims=3, clusters=4) == brute_clusters(rows, 4, 3, 3)


def test_inequalities_reject_centroids():
    rng = np.random.default_rng(7)
    middle = np.floor(rng.normal(size=(16, 64)) * 20 + 200 * np.arange(16)[:, None]).astype(np.int64)
    x = middle[rng.integers(0, 16, 500)] + rng.integers(-5, 6, (500, 64))
    number, away, measured = centroids.Centroids(middle.astype(object)).nearest(x)
    every = ((x[:, None, :] - middle[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (away == every.min(1)).all() and measured < 600


# -- negatives --------------------------------------------------------------------------------

def brute_negatives(rows, positives=5, count=10, every=100):
    clip = lambda s: max(min(s, 2**63 - 1), -2**63)
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not abs(x) < INF for x in v):
            continue
        whole = [max(min(int(np.floor(256 * x)), 2**63 - 1), -2**63) for x in v]
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, whole))
    out = []
    for a, (anchor, label, q) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scores = sorted((-clip(sum(x * y for x, y in zip(q, v))), i is None, i or 0, own) for r, (i, own, v) in enumerate(kept) if r != a)
        for p, no_p, pid, _ in [s for s in scores if s[3] == label][:positives]:
            fits = [s for s in scores if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:count]
            out += [(anchor, None if no_p else pid, r, None if no_n else nid, -p, -n) for r, (n, no_n, nid, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def found_negatives(spark, rows):
    vectors = negatives.labelled_vectors(table(spark, rows))
    got = negatives.mine(spark, vectors, F.col("vec_id") % 100 == 0)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


@pytest.mark.parametrize("rounds", [1, 5])
def test_negatives_against_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(negatives, "STEP", 3)
    if rounds > 1:
        monkeypatch.setattr(negatives, "ANCHOR_BYTES", 150)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(6, 7))
    rows = [(int(i), (middle[i % 6] + rng.normal(size=7)).tolist(), int(rng.integers(0, 3)) if i % 3 else 0) for i in rng.permutation(700)]
    rows[::4] = [(i, rows[0][1], label) for i, _, label in rows[::4]]  # one vector on a quarter of all rows: ties
    assert found_negatives(spark, rows) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 9), (0, [1.0, 2.0], 9), (100, [3.0, 1.0], 1), (1, [0.5], 0), (2, [], 1), (3, None, 0), (4, [1.0, None], 0),
            (5, [NAN, 1.0], 1), (6, [INF, 1.0], 1), (None, [2.0, 0.5], 1), (None, [1.0, 0.9], 0), (7, [1.0, 1.0], 9), (8, [1.0, 1.0], None),
            (9, [0.7, 0.8, 5.0], 2), (10, [2.0, 2.0], 0), (200, [-1.0, -1.0], 0), (300, [0.0, 0.0], 1), (11, [1.0, 0.1], 3), (11, [1.0, 0.1], 3)]
    assert found_negatives(spark, rows) == brute_negatives(rows)
    assert found_negatives(spark, []) == [] and found_negatives(spark, [(0, [1.0], 1)]) == []


def test_negatives_of_huge_components(spark):
    rows = [(0, [3e9, 1.0], 0), (1, [2e9, 1.0], 1), (2, [1e9, 5.0], 1), (3, [1e15, 0.0], 1), (4, [2e9, 3.0], 0), (100, [1.0, 1.0], 1), (5, [-1e15, 0.0], 2)]
    assert found_negatives(spark, rows) == brute_negatives(rows)


def test_bitmap_shrinks():
    """Dimensions that matter less are read for few candidates only."""
    rng = np.random.default_rng(9)
    vectors = rng.integers(-100, 101, size=(1000, 64)) // np.arange(1, 65)
    part = vectors.T.astype(np.int64)
    n = np.arange(1000, dtype=np.int64)
    block = negatives.Block(n.tobytes(), n.tobytes(), np.zeros(1000, np.int64).tobytes(), np.ascontiguousarray(part).tobytes(),
                            part.min(1).tobytes(), part.max(1).tobytes(), 64)
    best = negatives.Best(5)
    read = negatives.find_positives(block, 0, 0, vectors[0].astype(np.int64), best)
    scores = vectors @ vectors[0]
    want = sorted((-int(scores[i]), i) for i in range(1, 1000))[:5]
    assert [(-int(s), int(i)) for s, i in zip(best.scores, best.ids)] == want and read < 0.5 * vectors.size

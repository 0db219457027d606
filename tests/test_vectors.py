import numpy as np
import pytest

from tests.conftest import rows
from tidemart.operators import neighbours


def _frame(spark, vectors, name="id", categories=None):
    data = [(i, [float(x) for x in v]) + ((int(categories[i]),) if categories is not None else ())
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, f"{name} bigint, vector array<double>" + (", category int" if categories is not None else ""))


def brute(queries, corpus, k, metric, qc=None, cc=None):
    out = []
    for qi, q in enumerate(queries):
        hits = []
        for ci, c in enumerate(corpus):
            if qc is not None and qc[qi] != cc[ci]:
                continue
            if metric == "cosine":
                n = np.linalg.norm(q) * np.linalg.norm(c)
                s = float(q @ c / n) if n else 0.0
            else:
                s = -float(((q - c) ** 2).sum())
            hits.append((-s, ci))
        out += [(qi, ci, r + 1) for r, (_, ci) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("block", [None, 3])
@pytest.mark.parametrize("filtered", [False, True])
def test_top_k_matches_brute_force_in_one_block_and_in_many(spark, metric, block, filtered):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(10, 8)), rng.normal(size=(40, 8))
    c[5] = 0
    qc, cc = rng.integers(0, 3, 10), rng.integers(0, 3, 40)
    got = neighbours.top_k(
        _frame(spark, q, "query_id", qc if filtered else None), _frame(spark, c, "id", cc if filtered else None).repartition(3),
        4, metric, same_category=filtered, block_rows=block)
    want = brute(q, c, 4, metric, qc if filtered else None, cc if filtered else None)
    assert rows(got.select("query_id", "id", "rank")) == want


def test_scores_of_special_vectors(spark):
    corpus = _frame(spark, [[0, 0], [1, 0], [0, 1], [2, 0], [-1, 0]])
    got = neighbours.top_k(_frame(spark, [[3, 0]], "query_id"), corpus, 5)
    assert [(r.id, r.score) for r in got.orderBy("rank").collect()] == [
        (1, 1.0), (3, 1.0), (0, 0.0), (2, 0.0), (4, -1.0)]
    assert neighbours.top_k(_frame(spark, [[3, 0]], "query_id").filter("false"), corpus, 5).count() == 0


def test_concepts_need_more_than_the_threshold(spark):
    concepts = spark.createDataFrame([("price", [1.0, 0.0]), ("date", [0.0, 1.0])], "concept string, vector array<double>")
    columns = spark.createDataFrame([("price", "price"), ("date", "timestamp")], "concept string, column_name string")
    vectors = _frame(spark, [[0.6, 0.8], [0.8, 0.6], [-1, -1], [0, 0]])
    got = neighbours.nearest_concept(vectors, concepts, columns, threshold=0.8)
    assert rows(got) == []
    got = neighbours.nearest_concept(vectors, concepts, columns, threshold=0.6)
    assert rows(got) == [(0, "date", "timestamp", 0.8), (1, "price", "price", 0.8)]


def test_many_concepts_go_another_way_with_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(4)
    concepts = spark.createDataFrame(
        [(f"c{i}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(9, 5)))],
        "concept string, vector array<double>")
    columns = concepts.selectExpr("concept", "upper(concept) as column_name")
    vectors = _frame(spark, rng.normal(size=(30, 5)))
    short = rows(neighbours.nearest_concept(vectors, concepts, columns, 0.1))
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 4 * 8 * 5)
    assert rows(neighbours.nearest_concept(vectors, concepts, columns, 0.1)) == short


def test_centroids(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0]), (1, [2.0, 2.0])], "g int, vector array<double>")
    assert rows(neighbours.centroids(df, "g")) == [(0, [2.0, 4.0]), (1, [2.0, 2.0])]


def test_ranks_follow_unrounded_scores(spark):
    corpus = _frame(spark, [[0, 1], [1, 0.0005], [1, 0]])
    got = neighbours.top_k(_frame(spark, [[1, 0]], "query_id"), corpus, 1)
    assert [(r.id, r.score) for r in got.collect()] == [(2, 1.0)]


def test_distances_of_long_vectors(spark):
    corpus = _frame(spark, [[1e8 + 2, 3], [1e8, 0.1], [1e8, 0.2]])
    got = neighbours.top_k(_frame(spark, [[1e8, 0]], "query_id"), corpus, 3, "l2")
    assert [(r.id, r.score) for r in got.orderBy("rank").collect()] == [(1, -0.01), (2, -0.04), (0, -13.0)]


@pytest.mark.parametrize("group_rows", [20_000, 7])
def test_one_category_may_hold_most_rows(spark, monkeypatch, group_rows):
    """Parts of a hot category meet in groups of their own; categories of one side alone, and null, find nothing."""
    monkeypatch.setattr(neighbours, "GROUP_ROWS", group_rows)
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(25, 4)), rng.normal(size=(300, 4))
    qc, cc = np.where(rng.random(25) < 0.7, 1, 9), np.where(rng.random(300) < 0.8, 1, rng.integers(2, 5, 300))
    queries = _frame(spark, q, "query_id", qc).unionByName(spark.sql("SELECT 99L AS query_id, array(1d, 0d, 0d, 0d) AS vector, CAST(NULL AS int) AS category"))
    corpus = _frame(spark, c, "id", cc).unionByName(spark.sql("SELECT 999L AS id, array(1d, 0d, 0d, 0d) AS vector, CAST(NULL AS int) AS category"))
    got = neighbours.top_k(queries, corpus, 4, same_category=True)
    assert rows(got.select("query_id", "id", "rank")) == brute(q, c, 4, "cosine", qc, cc)


def test_one_broadcast_lives_at_a_time(spark, monkeypatch):
    live, most = set(), []
    make = type(spark.sparkContext).broadcast

    def broadcast(self, value):
        shared = make(self, value)
        live.add(id(shared))
        most.append(len(live))
        destroy = shared.destroy
        shared.destroy = lambda *a: (live.discard(id(shared)), destroy(*a))
        return shared

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    rng = np.random.default_rng(6)
    q, c = rng.normal(size=(10, 8)), rng.normal(size=(40, 8))
    got = neighbours.top_k(_frame(spark, q, "query_id"), _frame(spark, c), 4, block_rows=3)
    assert rows(got.select("query_id", "id", "rank")) == brute(q, c, 4, "cosine") and len(most) >= 3 and max(most) == 1 and not live

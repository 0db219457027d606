import itertools
import re

import pytest
from pyspark.sql import functions as F

from tidemart.llm import mixing

DOCS = "doc_id long, text string, source string, target string, size int"


def test_targets():
    assert mixing.targets({"a": 10, "b": 10}, {"a": 1.0, "b": 3.0}, 20) == {"a": 5, "b": 15}
    # b stops at 3 * 2, the rest goes to the others by weight; then c stops too
    got = mixing.targets({"a": 50, "b": 2, "c": 5}, {"a": 1.0, "b": 2.0, "c": 3.0}, 57)
    assert got == {"b": 6, "c": 15, "a": 36}
    assert mixing.targets({}, {}, 0) == {}
    assert mixing.targets({"a": 0}, {"a": 1.0}, 0) == {"a": 0}
    assert mixing.cycling_weights([None, "b", "a", "Z", "é"]) == {"Z": 1, "a": 2, "b": 3, "é": 1, None: 2}


def cost(flow, sizes):
    return sum(max(0, f - c * sizes[p]) for p, f in flow.items() for c in (1, 2))


@pytest.mark.parametrize("quotas", [{"x": 7, "y": 2}, {"x": 3, "y": 9}, {"x": 0, "y": 15}, {"x": 30, "y": 30}])
def test_flow_against_brute_force(quotas):
    sizes, members = {"p": 3, "q": 2, "r": 2}, {"p": ["x"], "q": ["x", "y"], "r": ["y"]}
    best = None
    for px, qx, qy, ry in itertools.product(range(10), range(7), range(7), range(7)):
        if px + qx <= quotas["x"] and qy + ry <= quotas["y"] and qx + qy <= 6:
            flow = {"p": px, "q": qx + qy, "r": ry}
            value = (-sum(flow.values()), cost(flow, sizes))
            best = min(best or value, value)
    got = mixing.route(sizes, members, quotas)
    assert (-sum(got.values()), cost(got, sizes)) == best


def _docs(spark, n=400):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 211)), ["a", "b", "c", None, "a", "a"][i % 6], "t", 5) for i in range(n)]
    rows += [(n, None, "a", "", 0), (n + 1, "", "b", "", 0), (n + 2, "one two\x0bthree", "d", "", 0), (None, "no id", "a", "", 0), (3, rows[3][1], rows[3][2], "", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_mix(spark):
    docs = _docs(spark)
    got = mixing.mix_documents(docs).toPandas()
    again = mixing.mix_documents(docs.repartition(5, "doc_id")).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))
    assert len(got) == 405
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", texts[None if i != i else i])) == s for i, s in zip(got.doc_id, got["size"]))
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    by = got.groupby(got.source.fillna("~"))
    sizes = by["size"].sum()
    want = mixing.targets(dict(sizes), {s: i % 3 + 1.0 for i, s in enumerate(sorted(sizes.index))}, sizes.sum())
    for source, rows in by:
        assert (rows.source_size == sizes[source]).all() and rows.target.iloc[0] == pytest.approx(want[source])
        assert abs(rows.taken.sum() - want[source]) <= max(3, want[source] / 200)
        assert rows.copies.max() - rows.copies[rows["size"] > 0].min() <= 1  # repetition is spread evenly


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5, 6])
def test_a_few_very_long_documents(spark, seed):
    """Long documents that do not fit leave no gap while enough fitting ones are left."""
    sizes = [20_000 if i < 4 else 50 + i * 31 % 23 for i in range(800)]
    docs = spark.createDataFrame([(i, "w " * n, "ab"[i % 2], "t", 5) for i, n in enumerate(sizes)], DOCS)
    got = mixing.mix_documents(docs, seed).toPandas()
    for _, rows in got.groupby("source"):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= 75
    counts = dict(zip(got.doc_id, got.copies))
    taken = {r.doc_id: r["count"] for r in mixing.take(docs, seed).groupBy("doc_id").count().collect()}
    assert {d: n for d, n in counts.items() if n} == taken


def test_rows_of_the_mix(spark):
    docs = _docs(spark)
    counts = {(r.doc_id, r["size"]): r.copies for r in mixing.mix_documents(docs).collect()}
    rows = mixing.take(docs)
    assert rows.columns == docs.columns
    taken = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    for (doc_id, size), copies in counts.items():
        assert taken.get(doc_id, 0) == copies * (2 if doc_id == 3 else 1)


def test_small_and_empty_tables(spark):
    assert mixing.mix_documents(spark.createDataFrame([], DOCS)).collect() == []
    assert mixing.take(spark.createDataFrame([], DOCS)).collect() == []
    only = mixing.mix_documents(spark.createDataFrame([(1, "", None, "", 1), (2, None, "a", "", 1)], DOCS)).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in only] == [(0, 0, 0.0, 0)] * 2


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["x", "y"] if i % 2 else ["x"]) for i in range(100)], "doc_id long, text string, sources array<string>")
    ordered = mixing.with_order(docs, F.col("sources"))
    sized = mixing.word_sizes(ordered, ["pattern", "order"]).cache()
    plan = mixing.plan_mix(sized, lambda s: {"x": 1.0, "y": 1.0})
    assert plan.source_sizes == {"x": 1000, "y": 500} and plan.targets == {"x": 500, "y": 500}
    taken = {r.pattern: r.n for r in plan.copies(sized).groupBy("pattern").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect()}
    assert taken == {'["x"]': 500, '["x","y"]': 500}  # nothing is read twice

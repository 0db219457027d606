"""Stages of the pipeline on tables whose further columns are called like anything the operators use inside."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_winnow_lines import brute as hits_brute
from tidemart.llm import among, jaccard, mixing, quality, winnow

NAMES = ["order", "pattern", "size", "copies", "_copies", "_copy", "_hash", "_mark", "_id", "mark", "row", "wins", "key", "n_hit", "items", "set_id",
         "group_id", "node", "_slot", "_word", "_bits", "_at", "a.b", "base", "rounds", "_plan", "embedding"]


@pytest.fixture(scope="module")
def docs(spark):
    """Ten groups of near copies with repeated rows, nulls and blanks; every further column holds its row's number."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(10)]
    rows = []
    for i in range(60):
        words = texts[i % 10].split()
        if i >= 10:
            words[int(rng.integers(60))] = "other"
        rows.append((i, " ".join(words), ["a", "b", None][i % 3]))
    rows += [(60, None, "a"), (61, "", "b"), (62, " \n ", None), (5, rows[5][1], "b"), (5, rows[5][1], "a"), (None, rows[7][1], "a"), (63, "short text", "a")]
    frame = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, source string, number int")
    return frame.select("doc_id", "text", "source", "number", *[F.concat(F.lit(f"{c} "), F.col("number")).alias(c) for c in NAMES])


def _unharmed(docs, kept):
    """Every kept row is a row of ``docs``, with its own values in all columns."""
    assert kept.columns == docs.columns
    rows = kept.collect()
    have = {r.number: r for r in docs.collect()}
    assert all(r == have[r.number] for r in rows)
    return rows


def test_near_duplicates(docs):
    rows = _unharmed(docs, jaccard.keep_one(docs))
    listed = [(r.doc_id if r.doc_id is not None else 99, r.text) for r in docs.collect()]
    want = {c if n else d for _, d, n, c in jaccard_brute(listed, 5, 80)}
    got = [r.doc_id if r.doc_id is not None else 99 for r in rows]
    assert sorted(got) == sorted(want)


def test_decontamination(spark, docs):
    items = [(0, docs.filter("doc_id = 3").first().text[:60]), (1, "short text"), (None, "w1 " * 12)]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, mark int")
    rows = _unharmed(docs, winnow.drop_contaminated(docs, bench))
    hit = {d for d, _, n, _ in hits_brute([(r.number + 1000, r.text) for r in docs.collect()], items, 10) if n}
    assert {r.number + 1000 for r in rows} == {r.number + 1000 for r in docs.collect()} - hit and len(hit) > 6


def test_mix(docs):
    rows = _unharmed(docs, mixing.take(docs))
    taken = {r.doc_id: r.copies for r in mixing.mix_documents(docs).filter("doc_id <> 5").collect()}
    got = {d: sum(r.doc_id == d for r in rows) for d in taken}
    assert got == taken


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    _unharmed(docs, quality.keep_good(docs, labels))


@pytest.mark.parametrize("keys", [0, 1, 40])
def test_parted_loses_nothing(spark, docs, keys):
    boxed = among.boxed(docs)
    listed = boxed.select("doc_id", "mark").limit(keys)
    maybe, others = among.parted(boxed, listed)
    inside = {tuple(r) for r in listed.collect()}
    assert maybe.count() + others.count() == docs.count()
    assert not any((r.doc_id, r.mark) in inside for r in others.collect())
    assert maybe.count() <= sum((r.doc_id, r.mark) in inside for r in boxed.collect()) + 1

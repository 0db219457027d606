import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_winnow_lines import brute as hits_brute
from tidemart.llm import mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps, written and read again."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.settle(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def _ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_names_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    assert all(df.columns == kept[0].columns for df in kept[:-1])


def test_quality_stage(spark, kept):
    scored = quality.score_quality(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert _ids(kept[1]) == _ids(scored.filter("predicted = 1"))


def test_near_duplicate_stage(kept):
    docs = [(r.doc_id, r.text) for r in kept[1].collect()]
    assert _ids(kept[2]) == sorted({c if n else d for _, d, n, c in jaccard_brute(docs, 5, 80)})


def test_decontamination_stage(spark, kept):
    docs = [(r.doc_id, r.text) for r in kept[2].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, _, hit, _ in hits_brute([(d or 10**9, t) for d, t in docs], items, 10) if not hit}
    assert _ids(kept[3]) == sorted(d for d, _ in docs if (d or 10**9) in clean)


def test_mix_stage(kept):
    taken = {r.doc_id: r.copies for r in mixing.mix_documents(kept[3]).collect()}
    assert _ids(kept[4]) == sorted(d for d, n in taken.items() for _ in range(n))


def test_shard_stage(kept):
    rows = kept[5].toPandas()
    assert sorted(rows.doc_id) == _ids(kept[4])
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(s) == list(range(len(s))) for _, s in rows.groupby("shard").slot)


def test_run_is_the_stages(spark, kept):
    columns = ["doc_id", "shard", "slot"]
    a, b = (df.toPandas()[columns].sort_values(columns).to_numpy() for df in (corpus_pipeline.run(spark, SF), kept[5]))
    assert np.array_equal(a, b)

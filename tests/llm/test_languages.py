import numpy as np
import pytest

from tidemart.llm import languages

SYLLABLES = {"en": "the ing and er ow th", "de": "der sch ein ung ich ge", "fr": "eau que les oi ent ai", "es": "cion ado que ñas ll os"}


def text_of(lang, words, rng):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, text_of(lang, int(rng.integers(3, 60)), rng), lang, "s", 0.5, True)
            for i, lang in enumerate(rng.choice(list(SYLLABLES), 400, p=[0.7, 0.1, 0.1, 0.1]))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, held_out boolean")


def test_held_out_accuracy(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = languages.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and 50 < len(held) < 110
    assert all(r.lang_pred == truth[r.doc_id] for r in got) and all(0.5 < r.score <= 1 for r in got)


def test_nothing_but_training_rows_is_read(spark, docs):
    """Labels of held-out rows change nothing, and neither do doc_id or source in a prediction."""
    want = {r.doc_id: (r.lang_pred, r.score) for r in languages.identify(docs).collect()}
    held = [r.doc_id for r in languages.identify(docs).filter("held_out").collect()]
    other = docs.withColumn("lang", languages.F.when(languages.F.col("doc_id").isin(held), "xx").otherwise(languages.F.col("lang")))
    assert {r.doc_id: (r.lang_pred, r.score) for r in languages.identify(other).collect()} == want


def test_odd_rows(spark, docs):
    rng = np.random.default_rng(2)
    long = text_of("de", 100_000, rng)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? 4", "fr"), (None, text_of("fr", 30, rng), None), (1004, long, None),
           (1004, long, None), (1005, "ñ", "es"), (1006, "\U0001d5ba\U0001d5bb", None)]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    got = languages.identify(both.withColumn("lang_pred", languages.F.lit(1))).filter("doc_id is null or doc_id >= 1000").collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == 8 and all(found[i] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert found[None][0] == "fr" and found[1004][0] == "de" and found[1005][0] in SYLLABLES and found[1006][0] in SYLLABLES
    assert [r.held_out for r in got if r.doc_id is None] == [True]  # as an empty id


def test_small_and_empty_tables(spark):
    one = spark.createDataFrame([(1, "the thing", "en"), (2, "andere", None), (3, "7", None)], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang_pred) for r in languages.identify(one).collect()) == [(1, "en"), (2, "en"), (3, "und")]
    assert {r.lang_pred for r in languages.identify(one.filter("lang is null")).collect()} == {"und"}
    assert languages.identify(one.limit(0)).collect() == []


def test_hierarchy():
    """The families come first; a pair of one family has a machine of its own, languages of two families have none."""
    rng = np.random.default_rng(3)
    grams = languages.Grams()
    langs = [lang for lang in SYLLABLES for _ in range(30)]
    model = languages.solve([grams(text_of(x, 20, rng)) for x in langs], langs)
    assert model.families == [["de", "en"], ["es", "fr"]] and model.pairs == [[(0, 1, 2)], [(0, 1, 3)]] and model.weights.shape[1] == 4
    assert languages.family("en-GB") == "germanic" and languages.family("pt_BR") == "romance" and languages.family("xx") == "xx"


def test_dual_solution_is_the_best_one():
    """The dual steps reach the least value of the primal objective, found here by gradient descent on a small problem."""
    rng = np.random.default_rng(4)
    texts = [np.sort(rng.choice(12, 6, replace=False) + (4 if i % 3 == 0 else 0)).astype(np.int32) for i in range(60)]
    sides = np.where(np.arange(60) % 3 == 0, 1, -1)
    x = np.zeros((60, 17))
    for i, t in enumerate(texts):
        x[i, t] = 1 / np.sqrt(6)
    x[:, 16] = 1
    cost = languages.COST * np.array([60 / 2 / (sides == s).sum() for s in sides])

    def value(w):
        return 0.5 * w @ w + (cost * np.maximum(1 - sides * (x @ w), 0) ** 2).sum()

    w = np.zeros(17)
    for _ in range(20000):
        slack = np.maximum(1 - sides * (x @ w), 0)
        w -= 2e-4 * (w - 2 * x.T @ (cost * sides * slack))
    got = languages.separate(texts, sides)
    small = np.append(got[:16], got[-1])
    assert not got[16:-1].any() and value(small) <= value(w) * 1.01

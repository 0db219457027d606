import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemart.llm import lines, winnow
from tidemart.llm.text import mix


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# -- winnowing --------------------------------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=10, max_size=14), st.lists(st.integers(0, 3), max_size=30), st.integers(0, 30))
def test_every_shared_window_shares_a_fingerprint(span, rest, at):
    text = rest[:at] + span + rest[at:]
    marks = []
    for words in (span, text):
        h = (np.array(words, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        marks.append(set(winnow.fingerprints(h, np.zeros(len(h), np.int64), 10, 6, [])[0].tolist()))
    assert marks[0] & marks[1]


def brute(docs, items, window):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    for doc_id, text in docs:
        words = re.findall(pattern, lower(text))
        hit, found = set(), set()
        for item_id, item in items:
            other = re.findall(pattern, lower(item))
            n = min(window, len(other))
            if item_id is None or not n:
                continue
            spans = {tuple(other[i:i + n]) for i in range(len(other) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in spans:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
        out.append((doc_id or -9, len(words), len(hit), sorted(found)))
    return sorted(out)


def test_contamination_against_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{rng.integers(6)}" for _ in range(n))  # noqa: E731  few words: many partial hits
    items = [(i, word(14)) for i in range(6)] + [(7, "Short ITEM here"), (8, "x"), (9, ""), (10, None), (None, "w1 " * 12), (7, word(11)), (11, "é ü 1a " * 5)]
    docs = [(i, f"pre.{i} {items[i % 6][1].upper()}; post {word(30)}") for i in range(20)]
    docs += [(50, None), (51, ""), (52, "a short, item HERE!"), (53, "X"), (54, items[0][1][:-3]), (None, items[3][1]), (55, items[2][1]), (55, items[2][1]),
             (55, "other text"), (56, word(60) + " " + "long " * 40_000 + items[4][1] + " tail"), (57, "é-ü.1A é ü 1a é ü 1a é"), (58, "... !!! \x00")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, n_words int").repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = winnow.contamination(frame, bench)
    assert sorted((r.doc_id or -9, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == brute(docs, items, 10)
    kept = winnow.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    clean = sorted((d or -9, n) for d, n, hit, _ in brute(docs, items, 10) if not hit)
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert sorted((r.doc_id or -9, len(words.findall(lower(r.text)))) for r in kept.collect()) == clean


def test_a_very_long_item(spark):
    """An item of 200,000 words costs rows of bounded size, and every one of its windows is found."""
    rng = np.random.default_rng(7)
    words = [f"w{x}" for x in rng.integers(0, 3000, 200_000)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2")], "item_id long, text string")
    marked = winnow.item_fingerprints(items)
    assert marked.count() > 50_000 and marked.agg(F.max(F.length("around"))).first()[0] == 8 * 14
    docs = [(0, "a " * 20 + " ".join(words[150_000:150_011]) + " b"), (1, " ".join(words[7:16])), (2, " ".join(words[199_990:])), (3, " ".join(words[50:9050]))]
    got = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items.filter("item_id = 1"))
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got.collect()} == {0: (11, ["1"]), 1: (0, []), 2: (10, ["1"]), 3: (9000, ["1"])}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_hits_cover_all_shared_windows(doc, item):
    """Fingerprints, surroundings and the extension of hits against a search for every window."""
    hashes = [mix(np.array(x, np.uint64) + np.uint64(9)) for x in (doc, item)]
    zero = [np.zeros(len(h), np.int64) for h in hashes]
    least = min(10, len(item))
    fps, at = winnow.fingerprints(hashes[0], zero[0], 10, 6, [least] if least < 10 else [])
    other, place = winnow.fingerprints(hashes[1], zero[1], 10, 6, []) if least == 10 else winnow.runs(hashes[1], zero[1], least)
    around = [winnow.surroundings(h, p, np.zeros(len(p), np.int64), np.full(len(p), len(h)), 10, 6, beyond)
              for h, p, beyond in ((hashes[0], at, winnow.NOTHING), (hashes[1], place, winnow.NOWHERE))]
    i, j = np.nonzero(fps[:, None] == other[None, :])
    batch = pa.RecordBatch.from_pydict({
        "key": pa.array([b"k"] * len(i), pa.binary()), "doc_at": pa.array(at[i], pa.int32()), "own": winnow._rows(around[0][i]),
        "item_id": pa.array(["x"] * len(i), pa.string()), "least": pa.array([least] * len(i), pa.int32()), "around": winnow._rows(around[1][j])})
    found = [r for b in winnow._extend(10, 6)(iter([batch])) for r in b.to_pylist()] if len(i) else []
    got = {k for r in found for k in range(r["start"], r["stop"])}
    spans = {tuple(item[k:k + least]) for k in range(len(item) - least + 1)}
    want = {k + n for k in range(len(doc) - least + 1) if tuple(doc[k:k + least]) in spans for n in range(least)}
    assert got == want


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in winnow.contamination(docs, none).orderBy("doc_id").collect()] == [(3, 0), (0, 0)]
    assert winnow.contamination(docs.filter("false"), none).collect() == []


# -- lines ------------------------------------------------------------------------------------

def cut(docs, min_words, unit="line"):
    """doc -> removed byte spans, kept text."""
    order = sorted({(d is None, d if d is not None else 0, t) for d, t in docs if t}, key=lambda x: x[:2])
    seen, removed = set(), defaultdict(list)
    for no_id, d, text in order:
        for m in re.finditer(r"[^\n]+" if unit == "line" else r"(?:[^\n]*[^\s][^\n]*)(?:\n[^\n]*[^\s][^\n]*)*", text):
            key = tuple(re.findall(r"[^\x20\x09-\x0D]+", lower(m.group())))
            if len(key) < min_words:
                continue
            if key in seen:
                removed[(None if no_id else d, text)].append((len(text[:m.start()].encode()), len(text[:m.end()].encode())))
            seen.add(key)
    return removed


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_lines_against_brute_force(spark, unit):
    long = "one Two three four"
    docs = [(2, f"{long}\nown é text of two\n{long.upper()}  \nend"), (1, f"first\n{long}"), (3, f"\n\n{long}\n"), (4, long), (5, "a b c"), (6, "a b c"),
            (7, None), (8, ""), (9, "\n \n"), (10, f"{long}\nmore words in here\n\nüüü üü ü ü\nmore words in here"), (11, f"x\n{long}\nmore words in here"),
            (4, long), (None, f"nothing own\n{long}"), (12, "word " * 70_000 + "\n" + long), (13, "word " * 70_000)]
    frame = spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, removed string, a int").repartition(4)
    got = lines.deduplicate(frame, unit, 4).collect()
    want = cut(docs, 4, unit)
    assert len(got) == len(docs)
    originals = defaultdict(set)
    for d, t in docs:
        originals[d].add(t)
    for r in got:
        (text,) = originals[r.doc_id]
        spans = [(s.start, s.end) for s in r.removed]
        assert spans == want.get((r.doc_id, text), []), r.doc_id
        data, at, parts = (text or "").encode(), 0, []
        for a, b in spans:
            parts.append(data[at:a])
            at = min(b + 1, len(data))
        assert r.text == (None if text is None else (b"".join(parts) + data[at:]).decode())


def test_lines_of_an_empty_table(spark):
    assert lines.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def cut_sentences(docs, min_words):
    """(doc, text) -> removed byte spans, by a scan over characters."""
    seen, removed = set(), defaultdict(list)
    for d, text in sorted({(d, t) for d, t in docs if t}):
        for m in re.finditer(r"[^\x20\x09-\x0D](?:[^\n]*?[^\x20\x09-\x0D])??(?:(?<=[.!?])(?=[\x20\x09-\x0D]|\Z)|(?=[\x20\x09\x0B-\x0D]*(?:\n|\Z)))", text):
            key = tuple(re.findall(r"[^\x20\x09-\x0D]+", lower(m.group())))
            if len(key) < min_words:
                continue
            if key in seen:
                removed[d, text].append((len(text[:m.start()].encode()), len(text[:m.end()].encode())))
            seen.add(key)
    return removed


def test_sentences_against_brute_force(spark):
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(["é", "Ü.b", "c", "d!e", "f"][i] + ["", "", ".", "?", " \t"][j] for i, j in zip(rng.integers(0, 5, n), rng.integers(0, 5, n)))
    docs = [(i, "".join(some(int(rng.integers(1, 9))) + ["\n", "\n\n", ". ", " "][rng.integers(4)] for _ in range(9))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, " \n.\n "), (53, "c d"), (54, "c d"), (54, "c d"), (55, "é f c. é f c!\r\né F C."), (56, "x " * 70_000 + "y. c d")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want, originals = cut_sentences(docs, 2), dict(docs)
    got = lines.deduplicate(frame, "sentence", 2).collect()
    assert len(got) == len(docs) and sum(map(len, want.values())) > 20
    for r in got:
        text = originals[r.doc_id]
        spans = [(s.start, s.end) for s in r.removed]
        assert spans == want.get((r.doc_id, text), []), r.doc_id
        data, at, parts = (text or "").encode(), 0, []
        for a, b in spans:
            parts.append(data[at:a])
            at = min(b + 1, len(data))
        assert r.text == (None if text is None else (b"".join(parts) + data[at:]).decode())


def test_a_passage_inside_lines_is_found_by_its_sentences(spark):
    """60 words that repeat inside lines with other words around them: no line repeats, the sentences do."""
    passage = " ".join(" ".join(f"p{i}w{j}" for j in range(20)) + "." for i in range(3))
    docs = [(1, f"A first line.\nThis one leads in. {passage} And goes on."), (2, f"Quite another start. {passage.upper()} Its end.\nMore."), (3, "Left alone. " * 30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r.removed for r in lines.deduplicate(frame).collect()] == [[], [], []]
    found = {r.doc_id: r for r in lines.deduplicate(frame, "sentence").collect()}
    assert {d: len(r.removed) for d, r in found.items()} == {1: 0, 2: 3, 3: 0}
    assert [found[d].text for d in (1, 2, 3)] == [docs[0][1], "Quite another start. Its end.\nMore.", docs[2][1]]

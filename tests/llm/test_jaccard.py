import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemart.llm import components, jaccard
from tidemart.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, region string, n int"


def sets_of(docs, shingle):
    out = []
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        n = min(shingle, len(words))
        out.append((doc_id, frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if n else frozenset()))
    return out


def brute(docs, shingle, percent):
    rows = sets_of(docs, shingle)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, a) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d is None, d or 0, len(a), least.get(find(i), -1)) for i, (d, a) in enumerate(rows))


def groups(got):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got.collect())


def corpus(seed=0, n=40, length=60, near=60, passage=30):
    """Random texts, chains of near copies of a few of them, texts that share a passage, short and odd ones."""
    rng = np.random.default_rng(seed)
    text = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    docs = [text(int(rng.integers(5, length))) for _ in range(n)]
    chain = text(length)
    for _ in range(near):  # neighbours are close, the ends of the chain are not
        chain = list(chain)
        chain[int(rng.integers(len(chain)))] = f"n{rng.integers(10**6)}"
        docs.append(chain)
    base = text(length)
    for _ in range(near):
        copy = list(base)
        for at in rng.integers(0, length, int(rng.integers(0, 4))):
            copy[at] = f"c{rng.integers(10**6)}"
        docs.append(copy)
    shared = text(40)
    docs += [text(int(rng.integers(0, 25))) + shared + text(int(rng.integers(0, 25))) for _ in range(passage)]
    rows = [(int(i), " ".join(d)) for i, d in zip(rng.permutation(len(docs)), docs)]
    top = len(rows)
    odd = [None, "", " \n", "One", "one", "one two", "One two", "one two three", "a b c d", "A b C d", "e " * 9, "e " * 500, "f " * 30_000]
    rows += [(top + i, t) for i, t in enumerate(odd)] + [(None, "only without id here x"), (None, rows[0][1]), rows[1], rows[1]]
    return rows


@pytest.mark.parametrize("shingle, percent", [(4, 85), (5, 80)])
def test_groups_against_brute_force(spark, shingle, percent):
    docs = corpus()
    frame = spark.createDataFrame([(*d, "r", 0) for d in docs], DOCS).repartition(5)
    assert groups(jaccard.jaccard_groups(frame, shingle, percent)) == brute(docs, shingle, percent)


def test_repeated_rows_are_one_document(spark, tmp_path):
    """The query returns a row per document, as its SQL does; the operator keeps its row per row."""
    docs = [d for d in corpus(5, n=15, near=15, passage=5) if d[0] is not None]
    docs = list(dict.fromkeys(docs)) + docs[::3] + docs[::6]
    spark.createDataFrame([(*d, "r", 0) for d in docs], DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op9_jaccard"](spark, str(tmp_path)).collect())
    found = duckdb.connect()
    found.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(found.execute(ORACLE["op9_jaccard"]).fetchall())
    assert len(got) == len({d for d, _ in docs}) < len(docs)


def test_regions_join_recursively(spark, monkeypatch):
    """Small leaves, so that pivots, windows, recursion and blocks all come to work."""
    monkeypatch.setattr(jaccard, "LEAF_ROWS", 6)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "SLICE_ROWS", 16)
    monkeypatch.setattr(jaccard, "LEVELS", 3)
    docs = corpus(1, n=10, near=45, passage=45)
    frame = spark.createDataFrame([(*d, "r", 0) for d in docs], DOCS).repartition(5)
    assert groups(jaccard.jaccard_groups(frame, 2, 70)) == brute(docs, 2, 70)


def link_counts(docs, shingle, percent):
    """Per row the number of other rows it is linked with."""
    rows = sets_of(docs, shingle)
    out = []
    for i, (d, a) in enumerate(rows):
        n = sum(1 for j, (_, b) in enumerate(rows) if j != i and a and b and 100 * len(a & b) >= percent * len(a | b))
        out.append((d is None, d or 0, len(a), n))
    return sorted(out)


@pytest.mark.parametrize("small", [{}, {"LEAF_ROWS": 6, "BLOCK_ROWS": 4, "PIVOTS": 3, "SLICE_ROWS": 16, "LEVELS": 3},
                                   {"LEAF_ROWS": 6, "BLOCK_ROWS": 4, "PIVOTS": 3, "SLICE_ROWS": 16, "GROWN": 99}])
def test_every_link_is_counted_once(spark, monkeypatch, small):
    """In one leaf, by pivots and blocks, and by pivots and copies into several cells."""
    for name, value in small.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = corpus(3, n=10, near=45, passage=30)
    frame = spark.createDataFrame([(*d, "r", 0) for d in docs], DOCS).repartition(5)
    got = jaccard.jaccard_groups(frame, 2, 70).collect()
    want = link_counts(docs, 2, 70)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.n_links) for r in got) == want
    assert max(n for *_, n in want) > 40


def test_one_of_each_group_stays(spark):
    docs = corpus(2, n=15, near=15, passage=8)
    frame = spark.createDataFrame([(*d, "r", 0) for d in docs], DOCS).repartition(3)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    empty = [d for d, t in docs if not (t or "").split()]
    wanted = {c for no_id, d, n, c in brute(docs, 5, 80) if n and c >= 0}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == sorted([*wanted, *empty])
    assert got.count(None) == 1  # a group without any id


def test_empty_table(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], DOCS)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([70, 80, 85, 95]), st.integers(1, 400), st.integers(0, 10**6), st.booleans())
def test_linked_sets_share_a_projection(percent, size, seed, crowded):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
    common = a[rng.random(len(a)) < (0.9 if crowded else 0.1)]
    b = a
    while True:  # drift away as far as the threshold allows
        c = np.unique(np.concatenate([b[rng.permutation(len(b))[int(rng.integers(0, 2)):]], rng.integers(0, 1 << 63, int(rng.integers(0, 2))).astype(np.uint64)]))
        both = len(np.intersect1d(a, c))
        if not len(c) or not jaccard.linked(both, len(a), len(c), percent) or rng.random() < 0.02:
            break
        b = c
    if np.array_equal(a, b):
        return
    starts = jaccard.ring_starts(percent, 2000)
    keys = []
    for s in (a, b):
        ring = int(np.searchsorted(starts, len(s), "right")) - 1
        rare = s[~jaccard._among(s, common)]
        keys.append(np.concatenate([jaccard.projections(s, rare, r, starts, percent) for r in (ring, ring + 1)]))
    assert len(np.intersect1d(*keys))


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 5, 70_000):
        keys = np.sort(rng.integers(0, 1 << 56, n).astype(np.uint64))
        nodes = rng.integers(0, 1 << 48, n) if n > 5 else np.arange(n)
        k, index, table = jaccard.unpack(jaccard.pack(keys, nodes))
        assert (k == keys).all() and (table[index] == nodes).all()


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 200, n).astype(np.uint64)) for n in (1, 50, 100, 150)]
    got = jaccard.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) or (i == j) for i, a in enumerate(sets) for j, b in enumerate(sets))


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (300, 301), (301, 302), (302, 300), (260, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 261)} | {301: 300, 302: 300}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=10), min_size=2, max_size=14), st.sampled_from([50, 80, 85]))
def test_pivots_decide_like_all_pairs(found, percent):
    sets = [np.array(sorted(s), np.uint64) for s in found]
    near, compared = jaccard.by_pivots(sets, percent)
    want = np.array([[i != j and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(found)] for i, a in enumerate(found)])
    assert (near == want).all() and compared <= len(sets) * (len(sets) - 1) // 2


def test_pivots_spare_comparisons():
    """Two tight groups: inside a group the way by a pivot is short enough, between them every window is missed."""
    rng = np.random.default_rng(3)
    bases = [rng.choice(100_000, 300, replace=False) + 1_000_000 * g for g in range(2)]
    sets = [np.sort(np.append(np.delete(bases[i % 2], rng.integers(0, 300, 3)), [5_000_000 + i])).astype(np.uint64) for i in range(16)]
    near, compared = jaccard.by_pivots(sets, 80)
    assert compared == 0 and near.sum() == 2 * 8 * 7


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1, max_size=40), st.sets(st.integers(0, 40), min_size=1, max_size=40), st.sampled_from([50, 80, 85, 95]),
       st.integers(0, 900))
def test_sketches_never_part_linked_sets(a, b, percent, more):
    """Also when the sketches are of different sizes."""
    shared = set(range(1000, 1000 + more))
    one, two = (np.array(sorted(x | shared), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (a, b))
    one.sort(), two.sort()
    common = len(np.intersect1d(one, two))
    if jaccard.linked(common, len(one), len(two), percent):
        assert jaccard.may_link(jaccard.sketch(one), jaccard.sketch(two), len(one), len(two), percent)


def test_sketches_part_unrelated_sets():
    rng = np.random.default_rng(1)
    for n in (20, 400, 5000):
        sets = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(30)]
        sketches = [jaccard.sketch(s) for s in sets]
        passed = sum(jaccard.may_link(sketches[i], sketches[j], n, n, 80) for i in range(30) for j in range(i))
        assert passed == 0 and len(sketches[0]) <= max(64, n)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(0, 3)), min_size=1, max_size=120))
def test_meetings_in_two_steps_lose_no_pair(rows):
    """Nodes that share a key are tested against each other, or hang together on edges that stay, however tasks divide them."""
    sure, met = set(), [[], []]
    for task in {t for _, _, t in rows}:
        own = [(k, n) for k, n, t in rows if t == task]
        keys, nodes, _, edges = jaccard.meetings(np.array([k for k, _ in own], np.uint64), np.array([n for _, n in own], np.int64))
        sure |= set(map(tuple, edges.tolist()))
        met[0].append(keys)
        met[1].append(nodes)
    _, _, pairs, edges = jaccard.meetings(np.concatenate(met[0]), np.concatenate(met[1]))
    sure |= set(map(tuple, edges.tolist()))
    tested = set(map(tuple, pairs.tolist()))
    root = {n: n for _, n, _ in rows}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in sure:
        root[find(u)] = find(v)
    for key in {k for k, _, _ in rows}:
        group = sorted({n for k, n, _ in rows if k == key})
        assert all((a, b) in tested or find(a) == find(b) for i, b in enumerate(group) for a in group[:i])
    assert all(u < v for u, v in tested)


def test_packed_rows_travel_in_batches_of_bounded_size(spark, monkeypatch):
    """A task may read several shards; what it hands to Python at once does not grow with them."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "BATCH", 1 << 13, raising=False)
    seen, plain = [], jaccard.neighbourhoods

    def measured(batches):
        for batch in batches:
            sizes = [len(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [len(sizes)], "all": [sum(sizes)], "last": [sizes[-1]]})

    def spied(marked, shards, percent):
        packed = marked.filter("shard >= 0").select("packed").coalesce(1)
        seen.extend(packed.mapInArrow(measured, "n long, all long, last long").collect())
        return plain(marked, shards, percent)

    monkeypatch.setattr(jaccard, "neighbourhoods", spied)
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 100_000, 200))) for i in range(80)]
    groups = jaccard.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in groups) == [(i, i) for i in range(80)]
    assert len(seen) > 1 and all(r["all"] - r["last"] < 1 << 13 for r in seen)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_edges_leave_python_in_batches_of_bounded_size(monkeypatch):
    """However many sets share projections, what a task holds and hands on at once stays small."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(11)
    chance = rng.integers(1, 1 << 47, (2_000, 16))  # groups that meet once
    twins = np.repeat(rng.integers(1, 1 << 47, (20, 16)), 100, axis=0)  # and groups that share 100 keys each
    groups = np.concatenate([chance, twins])
    keys, nodes = np.repeat(np.arange(len(groups), dtype=np.uint64), 16), groups.ravel()
    want = {tuple(sorted((a, b))) for g in np.unique(groups, axis=0).tolist() for i, a in enumerate(g) for b in g[:i]}
    monkeypatch.setattr(jaccard, "EDGES", 1_000, raising=False)
    rows = pa.RecordBatch.from_pydict({"shard": pa.array([0], pa.int32()), "packed": [jaccard.pack(keys, nodes)]})
    found = list(jaccard._meet(iter([rows])))
    assert {tuple(sorted(p)) for b in found for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())} == want
    assert not any(any(b.column(2).to_pylist()) for b in found)
    assert max(len(b) for b in found) <= 1_000
    own = np.column_stack([np.zeros(5_000, np.int64), np.arange(1, 5_001)])
    rows = pa.RecordBatch.from_pydict({"shard": pa.array([-1], pa.int32()), "packed": [own.tobytes()]})
    found = list(jaccard._own_edges(iter([rows])))
    assert np.array_equal(np.concatenate([np.column_stack([b.column(0), b.column(1)]) for b in found]), own)
    assert max(len(b) for b in found) <= 1_000 and all(all(b.column(2).to_pylist()) for b in found)

    tracemalloc.start()
    jaccard.meetings(np.repeat(np.arange(2_000, dtype=np.uint64), 16), twins.ravel())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5 << 20  # all 240,000 pairs of these groups, of which 2,400 are distinct, would be 3.8 MB at once

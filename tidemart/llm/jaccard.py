"""Exact Jaccard join of word shingle sets in metric space: pivots, regions, windows (operator 9)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemart.llm.among import boxed, parted
from tidemart.llm.components import connected_components
from tidemart.llm.text import NOT_BLANK, give_back, mix, pieces, runs, signed, small_batches, utf8, word_hashes, words
from tidemart.operators.keys import per_key
from tidemart.session import scratch_dir, scratch_scope, settle, shuffles_dropped
from tidemart.sources import files

SHINGLE = 5
PERCENT = 80
LEAF_ROWS = 16  # documents of a region that is joined in one go
LEAF_PIVOTS = 4  # of such a region
BLOCK_ROWS = 128  # documents of a block, two of which are compared at once
LEAF_SHINGLES = 2_000_000
PIVOTS = 8
LEVELS = 8
GROWN = 3  # times the sets of a region that its cells may hold; of more, blocks are compared
SLICE_ROWS = 256  # documents of a large region that one task measures against its pivots
FLUSH = 1_000_000  # projections or shingles that a task holds before it hands them on
FINER = 6  # times the least number of slices that sets with few rare shingles are projected on
MEET = 500_000  # projections that are joined at once
EDGES = 100_000  # edges that leave Python at a time: those of ``MEET`` projections grow with the sets that share one
KEY_BITS = 56  # of projections; where two are taken for one, neighbourhoods are larger than they need be, nothing else
FLUSH_SETS = 60_000
SHARD_BYTES = 32 << 20  # of text; its projections, about as many bytes when packed, meet at once
BATCH = 4 << 20  # bytes that travel to Python at a time, however many shards a task has
COMMON_SHARE = 500  # a shingle in more than one of so many documents is common; there are COMMON_SHARE * mean set size at most
COMMON_LEAST = 20  # and it is in so many documents
COMMON_IN_TASK = 4  # occurrences among the documents a task holds from which a shingle is counted

SMALL_GROUP = 16  # sets that share a projection, up to which every pair of them is tested
BIG = 1 << 50  # marks the node that stands for a larger group; nodes have 48 bits

MARKED = "doc_id long, mark long, n long, set_id binary, node long, sketch binary, shard int, packed binary"
EDGE = "u long, v long, sure boolean"
MEMBER = "parent long, region long, set_id binary, n long, copies long, home boolean, text string, a binary, b binary, links long"
LINK = "a binary, b binary, links long"  # a link, or (b null) a part of the number of rows that a is linked with
BLOCK = "region long, own int, blocks int, names binary, facts binary, tokens binary"


# -- sets -------------------------------------------------------------------------------------

def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    for _, data, cuts in pieces(*utf8(column)):
        starts, ends, owner = words(data, cuts, NOT_BLANK)
        hashes = word_hashes(data, starts, ends)
        n = len(cuts) - 1
        begin = np.searchsorted(owner, np.arange(n + 1))
        count = np.diff(begin)
        grams, at = runs(hashes, owner, size)
        cut = np.searchsorted(at, begin)
        for i in range(n):
            if count[i] >= size:
                yield np.unique(grams[cut[i]:cut[i + 1]])
            elif count[i]:
                own = hashes[begin[i]:begin[i + 1]]
                yield runs(own, np.zeros(len(own), np.int64), len(own))[0]
            else:
                yield np.zeros(0, np.uint64)


def _among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` are in the sorted ``b``."""
    if not len(b):
        return np.zeros(len(a), bool)
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return b[place] == a


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


# -- neighbourhoods ---------------------------------------------------------------------------
# Unrelated documents are all at a distance of about 1, where windows of twice the radius would copy every document
# into every region. So the corpus is first cut into neighbourhoods that no link leaves, by an exact projection: the
# shingle space is cut into slices, more than two linked sets can differ in, so that they agree on a whole slice.

def ring_starts(percent: int, largest: int) -> np.ndarray:
    """First sizes of rings such that linked sets lie in one ring or in neighbouring ones."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


def slices(ring: int, starts: np.ndarray, percent: int) -> tuple[int, int, int]:
    """Number of slices of a ring, how many thin ones a set may leave out, and the shingles from which one is not thin.

    Linked sets of the ring differ in at most d shingles, so of d + 1 + spare slices spare + 1 are equal.
    """
    differ = 2 * (100 - percent) * (int(starts[ring + 1]) - 1) // (100 + percent)
    low = int(starts[max(ring - 1, 0)])
    for full in (2, 1):
        spare = 1
        for _ in range(6):
            count = differ + 1 + spare
            mean = low / count
            thin = count * math.exp(-mean) * (1 + mean if full == 2 else 1)
            spare = math.ceil(1.2 * thin + 2 * math.sqrt(thin)) + 1
        if spare <= differ / 2 or full == 1:
            spare = min(spare, differ + 1)
            return differ + 1 + spare, spare, full
    raise AssertionError


def _project(shingles: np.ndarray, ring: int, shape: tuple[int, int, int], salt: int) -> tuple[np.ndarray, bool]:
    """A key per slice that is not thin, and whether there are few enough thin ones; if not, a key per slice."""
    count, spare, full = shape
    salted = mix(shingles ^ np.uint64(0x5851F42D4C957F2D + ring))
    of = (salted >> np.uint64(33)).astype(np.int64) % count
    total, filled = np.zeros(count, np.uint64), np.bincount(of, minlength=count)
    np.add.at(total, of, salted)
    keys = mix(total + mix(np.uint64((salt << 48) + (ring << 32)) + np.arange(count, dtype=np.uint64)))
    keys >>= np.uint64(64 - KEY_BITS)
    strong = filled >= full
    enough = count - int(strong.sum()) <= spare
    return (keys[strong] if enough or salt < 2 else keys), enough


def projections(shingles: np.ndarray, rare: np.ndarray, ring: int, starts: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which linked sets of the ring share one.

    ``rare`` is the set without common shingles; it differs from another no more than the sets themselves do. Equal
    slices are thin in both sets or in neither, so if one of two linked sets has few thin slices, they meet in another.
    Sets with many thin slices, as few of their shingles are rare, are projected on more and finer slices too; those
    that consist of common shingles nearly throughout, on the slices of all their shingles.
    """
    shape = slices(ring, starts, percent)
    least = shape[0] - shape[1]  # slices of which one must be equal
    if least == 1:
        return np.zeros(0, np.uint64)  # only equal sets are linked, and these have one name
    out = []
    for salt, (own, form) in enumerate([(rare, shape), (rare, (FINER * least, (FINER - 1) * least, 1)), (shingles, shape)]):
        keys, enough = _project(own, ring, form, salt)
        out.append(keys)
        if enough:
            break
    return np.concatenate(out)


def _steps(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of equal weight, which packs well."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _sums(data: bytes, n: int, at: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack(keys: np.ndarray, nodes: np.ndarray) -> bytes:
    """Sorted keys and their nodes, small."""
    table, index = np.unique(nodes, return_inverse=True)
    index = index.astype(np.uint32 if len(table) > 65535 else np.uint16)
    head = np.array([len(keys), len(table)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + _steps(table.view(np.uint64)) + _steps(keys) + index.tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, the places of their nodes in a table, and the table."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, t = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    index = np.frombuffer(raw, np.uint32 if t > 65535 else np.uint16, n, 16 + 8 * (t + n))
    return _sums(raw, n, 16 + 8 * t), index, _sums(raw, t, 16).view(np.int64)


def distinct_pairs(pairs: np.ndarray) -> np.ndarray:
    """Each row of two numbers once, sorted."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return pairs if new.all() else pairs[new]


def meetings(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What to pass on of the nodes that share keys: keys and nodes, pairs to be tested, and edges that stay as they are.

    All pairs of up to ``SMALL_GROUP`` nodes with one key are to be tested. More nodes hang on their least one, which alone
    is passed on, marked with ``BIG``; then a pair of them may be linked though both edges to the least one are not, so
    none of these edges may go. Keys and nodes come back sorted, each pair of them once.
    """
    order = np.lexsort((nodes & ~BIG, keys))
    keys, nodes = keys[order], nodes[order]
    own, big = nodes & ~BIG, nodes >= BIG
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    marks = np.zeros(int(fresh.sum()), bool)
    np.logical_or.at(marks, np.cumsum(fresh) - 1, big)
    keys, own, big = keys[fresh], own[fresh], marks
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(first) - 1
    large = (np.bincount(group) > SMALL_GROUP) | (np.bincount(group, big) > 0) if len(group) else np.zeros(0, bool)
    inside = large[group] if len(group) else np.zeros(0, bool)
    least = own[first][group]
    edges = distinct_pairs(np.column_stack([least, own])[inside & (least != own)])
    pairs = [np.zeros((0, 2), np.int64)]
    for step in range(1, min(SMALL_GROUP, len(keys))):
        both = (group[step:] == group[:-step]) & ~inside[step:]
        if not both.any():
            break
        # two sets that share many keys make as many equal pairs; they go before more are held
        pairs.append(distinct_pairs(np.column_stack([own[:-step][both], own[step:][both]])))
    kept = ~inside | first
    found = np.concatenate(pairs)
    pairs.clear()
    return keys[kept], np.where(inside, own | BIG, own)[kept], distinct_pairs(found), edges


def sketch(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall into each range of their hashes, about four to one. The differences of two sketches add up
    to no more than the sets differ in, so sets whose sketches differ too much are not linked. None if a count is too large."""
    bits = max(6, (len(shingles) // 4).bit_length())
    counts = np.bincount((mix(shingles ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def may_link(a: bytes | None, b: bytes | None, n_a: int, n_b: int, percent: int) -> bool:
    """False if the sketches show that sets of these sizes are not linked."""
    if a is None or b is None:
        return True
    one, two = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (a, b))
    size = min(len(one), len(two))
    least = np.abs(one.reshape(size, -1).sum(1) - two.reshape(size, -1).sum(1)).sum()
    return bool((100 + percent) * least <= (100 - percent) * (n_a + n_b))


def common_shingles(docs: DataFrame, shingle: int, n: int) -> np.ndarray:
    """Sorted shingles that more than one in ``COMMON_SHARE`` of the ``n`` documents hold, counted over all of them.

    Tasks count the documents they hold at a time and pass on what they met ``COMMON_IN_TASK`` times, so a count may
    fall short: any list is right, a fuller one only saves work. It has a bounded size and travels to all tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            n = np.diff(np.append(first, len(tokens)))
            often = n >= COMMON_IN_TASK
            return pa.RecordBatch.from_pydict({"token": signed(tokens[first[often]]), "n": n[often]})

        for batch in batches:
            for own in shingle_sets(batch.column(0), shingle):
                held.append(own)
                size += len(own)
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()
        held = []
        give_back()

    often = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = often.filter(F.col("n") >= max(COMMON_LEAST, n // COMMON_SHARE)).select("token").toArrow()
    return np.sort(np.asarray(found.column(0).combine_chunks(), np.int64).view(np.uint64))


class _Projector:
    """Gathers the projections of a task, joins what it can and packs the rest by shard of the key."""

    def __init__(self, shards: int, percent: int, common: np.ndarray):
        self.shards, self.percent, self.common = shards, percent, common
        self.starts = ring_starts(percent, 64)
        self.keys: list[np.ndarray] = []
        self.nodes: dict[int, int] = {}
        self.held = 0

    def add(self, shingles: np.ndarray, node: int) -> None:
        if node in self.nodes:
            return
        if len(shingles) >= self.starts[-4]:
            self.starts = ring_starts(self.percent, 4 * len(shingles))
        ring = int(np.searchsorted(self.starts, len(shingles), "right")) - 1
        rare = shingles[~_among(shingles, self.common)]
        own = np.concatenate([projections(shingles, rare, r, self.starts, self.percent) for r in (ring, ring + 1)])
        self.nodes[node] = len(own)
        self.keys.append(own)
        self.held += len(own)

    def full(self) -> bool:
        return self.held >= FLUSH or len(self.nodes) >= FLUSH_SETS

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            nodes = np.repeat(np.fromiter(self.nodes.keys(), np.int64), np.fromiter(self.nodes.values(), np.int64))
            # pairs are tested where all nodes of a key meet
            keys, nodes, _, edges = meetings(np.concatenate(self.keys), nodes)
            if len(edges):
                yield -1, edges.tobytes()
            shard = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(shard, np.arange(self.shards + 1))
            for i in np.flatnonzero(np.diff(cut)):
                yield int(i), pack(keys[cut[i]:cut[i + 1]], nodes[cut[i]:cut[i + 1]])
        self.keys, self.nodes, self.held = [], {}, 0


def _mark(shards: int, shingle: int, percent: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projector = _Projector(shards, percent, common)
        types = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()),
                           ("node", pa.int64()), ("sketch", pa.binary()), ("shard", pa.int32()), ("packed", pa.binary())])

        def flushed() -> Iterator[pa.RecordBatch]:
            for shard, data in projector.flush():
                yield pa.RecordBatch.from_pylist([{"shard": shard, "packed": data}], schema=types)

        for batch in batches:
            sizes, names, nodes, sketches = [], [], [], []
            for own in shingle_sets(batch.column(2), shingle):
                name = set_name(own) if len(own) else None
                node = int.from_bytes(name[:6], "little") if name else None
                sizes.append(len(own))
                names.append(name)
                nodes.append(node)
                sketches.append(sketch(own) if name else None)
                if name:
                    projector.add(own, node)
                    if projector.full():
                        yield from flushed()
            empty = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(empty, pa.int32()), pa.array(empty, pa.binary())],
                schema=types)
        yield from flushed()
        give_back()

    return run


def _edge_rows(found: np.ndarray, sure: bool) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(found), EDGES):
        part = found[first:first + EDGES]
        yield pa.RecordBatch.from_pydict({"u": part[:, 0], "v": part[:, 1], "sure": pa.repeat(sure, len(part))})


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between sets whose projections meet; the rows of a shard come one after the other."""
    at, held = None, []

    def edges() -> Iterator[pa.RecordBatch]:
        total = sum(len(k) for k, _, _ in held)
        parts = -(-total // MEET)  # ranges of keys, joined one by one
        low, high = min(k[0] for k, _, _ in held), max(k[-1] for k, _, _ in held)
        width = (int(high) - int(low)) // parts + 1
        cuts = [np.searchsorted(k, np.array([int(low) + width * i for i in range(parts + 1)], np.uint64)) for k, _, _ in held]
        for i in range(parts):
            some = [(k[c[i]:c[i + 1]], table[index[c[i]:c[i + 1]]]) for (k, index, table), c in zip(held, cuts)]
            _, _, pairs, sure = meetings(np.concatenate([k for k, _ in some]), np.concatenate([n for _, n in some]))
            yield from _edge_rows(pairs, False)
            yield from _edge_rows(sure, True)

    for batch in batches:
        for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != at:
                if held:
                    yield from edges()
                at, held = shard, []
            held.append(unpack(packed))
    if held:
        yield from edges()
    held = []
    give_back()


def _own_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(1).to_pylist():
            yield from _edge_rows(np.frombuffer(packed, np.int64).reshape(-1, 2), True)


def _tested(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, *facts = (c.to_pylist() for c in batch.columns)
            kept = pa.array([may_link(a, b, m, n, percent) for a, b, m, n in zip(*facts)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["u", "v"])

    return run


def neighbourhoods(marked: DataFrame, shards: int, percent: int) -> DataFrame:
    """node and region of the sets that links may hold together.

    Few sets that share a projection do so by chance; of small groups the pairs whose sketches tell them apart go, so that
    chance does not tie the corpus together as it grows. Only sketches of sets in such pairs are moved.
    """
    packed = marked.filter("shard is not null").select("shard", "packed")
    width = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = packed.filter("shard >= 0").repartition(max(width, shards), "shard").sortWithinPartitions("shard").mapInArrow(_meet, EDGE)
    met = settle(met.unionByName(packed.filter("shard < 0").mapInArrow(_own_edges, EDGE)), "jaccard-met")
    pairs = settle(met.filter("not sure").select("u", "v").distinct(), "jaccard-pairs")
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    some, _ = parted(marked.filter("shard is null and node is not null").select("node", "n", "sketch"), wanted, ("node",))
    # two sets with one node, which happens in very large corpora, cannot be told apart: their pairs stay
    same = (F.min("sketch").eqNullSafe(F.max("sketch"))) & (F.min("n") == F.max("n")) & (F.count("sketch") == F.count(F.lit(1)))
    known = settle(some.groupBy("node").agg(F.min("n").alias("n"), F.when(same, F.min("sketch")).alias("sketch")), "jaccard-sketches")
    a = known.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("sketch").alias("s_u"))
    b = known.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("sketch").alias("s_v"))
    kept = pairs.join(a, "u").join(b, "v").select("u", "v", "s_u", "s_v", "n_u", "n_v").mapInArrow(_tested(percent), "u long, v long")
    found = connected_components(met.filter("sure").select("u", "v").unionByName(kept))
    return found.select("node", F.col("root").alias("region")).unionByName(
        found.select(F.col("root").alias("node"), F.col("root").alias("region")).distinct())


# -- regions ----------------------------------------------------------------------------------

def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1  # a shingle of one set is in no intersection
    column, owner = column[several], owner[several]
    out = np.zeros((len(sets), len(sets)), np.int64)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(column, column[at] + 32768))
        block = np.zeros((len(sets), 32768), np.float32)
        block[owner[at:stop], column[at:stop] - column[at]] = 1
        out += (block @ block.T).astype(np.int64)
        at = stop
    return out


def by_pivots(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """Which of a few sets are linked, and how many pairs had to be compared with each other.

    Each pivot, the set farthest from those before, is measured against all. The distances of two sets to a pivot bound
    their own from below by the difference and from above by the sum: a pair out of reach of any pivot's window is not
    linked, one within the radius by way of a pivot is, and only what is left is compared.
    """
    k, radius = len(sets), (100 - percent) / 100
    n = np.array([len(s) for s in sets])
    low, high = np.zeros((k, k)), np.full((k, k), 2.0)
    near, known = np.zeros((k, k), bool), np.eye(k, dtype=bool)
    pivot, reach = 0, np.full(k, 2.0)
    for _ in range(min(LEAF_PIVOTS, k)):
        common = np.array([_common(sets[pivot], s) for s in sets])
        away = 1 - common / (n + n[pivot] - common)
        near[pivot] = near[:, pivot] = linked(common, n, n[pivot], percent)
        known[pivot] = known[:, pivot] = True
        low, high = np.maximum(low, np.abs(away[:, None] - away)), np.minimum(high, away[:, None] + away)
        reach = np.minimum(reach, away)
        pivot = int(reach.argmax())
        if known[pivot].all():
            break
    sure = high <= radius - 1e-9
    near |= sure & ~known
    left = np.argwhere(np.triu(~known & ~sure & (low <= radius + 1e-9), 1))
    for i, j in left:
        near[i, j] = near[j, i] = linked(_common(sets[i], sets[j]), n[i], n[j], percent)
    np.fill_diagonal(near, False)
    return near, len(left)


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric matrix, as few as connect what all of them connect."""
    seen, out = np.zeros(len(near), bool), []
    for root in range(len(near)):
        left = [] if seen[root] else [root]
        seen[root] = True
        while left:
            at = left.pop()
            new = np.flatnonzero(near[at] & ~seen)
            seen[new] = True
            out += [(at, int(i)) for i in new]
            left += new.tolist()
    return out


def _once(names: list[bytes], home: np.ndarray, others: list[bytes], other_home: np.ndarray) -> np.ndarray:
    """Which pairs are counted here: those whose smaller set is at home, so that no pair is counted in two regions."""
    smaller = np.array([[a < b for b in others] for a in names], bool).reshape(len(names), len(others))
    return np.where(smaller, home[:, None], other_home[None, :])


def _rows(edges: list[tuple[bytes, bytes]], names: list[bytes], links: np.ndarray) -> pa.RecordBatch:
    """Links, and for each name the part of its number that is known here."""
    found = np.flatnonzero(links)
    a = [a for a, _ in edges] + [names[i] for i in found]
    b = [b for _, b in edges] + [None] * len(found)
    parts = [None] * len(edges) + links[found].tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(parts, pa.int64())], names=["a", "b", "links"])


def _leaves(shingle: int, percent: int):
    """All pairs of each region compared: links that connect it, and how many rows each set is linked with; the rows of
    a region come one after the other."""
    def links(held: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            names = list(held)
            copies, home, texts = zip(*held.values())
            copies, home = np.array(copies, np.int64), np.array(home, bool)
            near, _ = by_pivots(list(shingle_sets(pa.array(texts, pa.large_string()), shingle)), percent)
            edges = [(names[i], names[j]) for i, j in spanning(near)]
            yield _rows(edges, names, (near & _once(names, home, names, home)) @ copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for region, name, copies, home, text in zip(*(c.to_pylist() for c in batch.columns)):
                if region != at:
                    yield from links(held)
                    at, held = region, {}
                held[name] = (copies, home, text)
        yield from links(held)
        held = {}
        give_back()

    return run


def join_leaves(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    rows = members.select("region", "set_id", "copies", "home", "text")
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(_leaves(shingle, percent), LINK)


def _measure(shingle: int, percent: int, level: int):
    """Distances of a region's documents to its pivots, which come first: links, their number, home region and windows."""
    radius = (100 - percent) / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, theirs, last = None, {}, None, None
        types = pa.schema([("parent", pa.int64()), ("region", pa.int64()), ("set_id", pa.binary()), ("n", pa.int64()),
                           ("copies", pa.int64()), ("home", pa.bool_()), ("text", pa.string()), ("a", pa.binary()),
                           ("b", pa.binary()), ("links", pa.int64())])

        def link(region, a, b, links=None) -> tuple:
            return region, None, None, None, None, None, None, a, b, links

        def ended() -> list[tuple]:
            return [link(at[0], p, None, int(x)) for p, x in zip(pivots, theirs) if x] if theirs is not None else []

        def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for first in range(0, len(rows), 2000):
                part = rows[first:first + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types.types)], schema=types)

        for batch in batches:
            rows = []
            for region, salt, pivot, name, n, copies, home, text, own in zip(
                    *(c.to_pylist() for c in batch.columns), shingle_sets(batch.column(7), shingle)):
                if (region, salt) != at:
                    rows += ended()
                    at, pivots, theirs, last = (region, salt), {}, None, None
                if pivot:
                    pivots[name] = (own, copies, home)
                    continue
                if name == last:
                    continue  # a repeated row
                last = name
                if theirs is None:
                    theirs = np.zeros(len(pivots), np.int64)
                common = np.array([_common(own, p) for p, _, _ in pivots.values()])
                others = np.array([len(p) for p, _, _ in pivots.values()])
                away = 1 - common / (len(own) + others - common)
                near = linked(common, len(own), others, percent) & np.array([p != name for p in pivots])
                rows += [link(region, name, p) for p, is_near in zip(pivots, near) if is_near]
                counted = near & _once([name], np.array([home]), list(pivots), np.array([h for _, _, h in pivots.values()]))[0]
                mine = int(counted @ np.array([c for _, c, _ in pivots.values()]))
                if mine:
                    rows.append(link(region, name, None, mine))
                if name in pivots:
                    continue  # its links are all known now, and the other pivots count theirs
                theirs += counted * copies
                nearest = int(away.argmin())
                for i in np.flatnonzero(away <= away[nearest] + 2 * radius + 1e-9):
                    cell = _cell(region, level, int(i))
                    rows.append((region, cell, name, n, copies, home and int(i) == nearest, text, None, None, None))
            yield from batches_of(rows)
        yield from batches_of(ended())
        give_back()

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return int((_among(a, b) if len(a) <= len(b) else _among(b, a)).sum())


def _cell(region: int, level: int, pivot: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{region} {level} {pivot}".encode(), digest_size=8).digest(), "little", signed=True)


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))


def join_regions(spark: SparkSession, members: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """All pairs of sets (set_id, n, copies, home, text) of each region that are linked: links (a, b) that connect them, and
    parts (a, null, links) of the number of rows each set is linked with.

    A region of up to ``LEAF_ROWS`` sets is joined at once, by the windows of ``LEAF_PIVOTS`` pivots. A larger one takes pivots; each set is measured against
    them, lies in the Voronoi region of the nearest, its home, and is copied into those whose pivot is at most twice the
    radius farther, which by the triangle inequality is where a linked set can lie. So the regions are joined on their
    own, recursively, and a pair is counted where the set of the smaller name is at home. Where sets are so evenly apart,
    or so close together, that a region does not shrink, its sets are compared block by block: exact, bounded in memory,
    quadratic in work.
    """
    links, behind = [], []
    small = (F.col("rows") <= LEAF_ROWS) & (F.col("shingles") <= LEAF_SHINGLES)
    columns = ["region", "set_id", "n", "copies", "home", "text"]

    def written(rows: DataFrame, label: str) -> DataFrame:
        """``settle`` for rows with texts: they go when the next level has been written."""
        path = scratch_dir(spark, label)
        rows.write.parquet(path)
        behind.append(path)
        return spark.read.schema(rows.schema).parquet(path)

    def drop(paths: list[str]) -> None:
        for path in paths:
            files.delete(spark, path)

    def by_size(rows: DataFrame, label: str) -> DataFrame:
        """Joins the small regions; the rows of the others."""
        sized = rows.join(_sizes(rows).filter("rows > 1").withColumn("leaf", small), "region")
        leaf = sized.filter("leaf").select(*columns)
        links.append(settle(join_leaves(leaf, shingle, percent), f"jaccard-links-{label}"))
        return written(sized.filter("not leaf").select(*columns, "rows"), f"jaccard-large-{label}")

    current = by_size(members, "0")
    level = 0
    while not current.isEmpty():
        level += 1
        if level > LEVELS:
            links.append(settle(_by_blocks(current, written, shingle, percent), "jaccard-links-blocks"))
            break
        done = list(behind)
        order = Window.partitionBy("region").orderBy(F.xxhash64("set_id", F.lit(level)), "set_id")
        parts = F.ceil(F.col("rows") / SLICE_ROWS).cast("int")
        pivots = (
            current.withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= PIVOTS)
            .withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("pivot", F.lit(True))
        )
        rows = current.withColumns({"salt": F.pmod(F.xxhash64("set_id"), parts).cast("int"), "pivot": F.lit(False)})
        dealt_columns = ["region", "salt", "pivot", *columns[1:]]
        dealt = (
            pivots.select(*dealt_columns).unionByName(rows.select(*dealt_columns))
            .repartition("region", "salt").sortWithinPartitions("region", "salt", F.desc("pivot"), "set_id")
        )
        measured = written(dealt.mapInArrow(_measure(shingle, percent, level), MEMBER), "jaccard-measured")
        done.append(behind[-1])
        cells = measured.filter("a is null").select("parent", *columns)
        parents = current.groupBy("region").agg(F.first("rows").alias("rows"))
        filled = cells.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("cell"))
        filled = filled.groupBy("parent").agg(F.max("cell").alias("cell"), F.sum("cell").alias("cells"))
        # a cell nearly as large as the region, or many copies: blocks cost less
        full = (F.col("cell") > 0.7 * F.col("rows")) | (F.col("cells") > GROWN * F.col("rows"))
        stuck = filled.join(parents, filled["parent"] == parents["region"]).filter(full).select("parent")
        stuck = settle(stuck, "jaccard-stuck")
        # blocks count all pairs of a region, also those with its pivots
        links.append(settle(measured.filter("a is not null").join(stuck, "parent", "left_anti").select("a", "b", "links"), "jaccard-links-pivots"))
        blocked = current.join(stuck, current["region"] == stuck["parent"], "left_semi")
        links.append(settle(_by_blocks(blocked, written, shingle, percent), "jaccard-links-blocks"))
        done.append(behind[-1])
        current = by_size(cells.join(stuck, "parent", "left_anti").select(*columns), str(level))
        drop(done)
        behind = [path for path in behind if path not in done]
    drop(behind)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _by_blocks(rows: DataFrame, written: Callable[[DataFrame, str], DataFrame], shingle: int, percent: int) -> DataFrame:
    """The pairs of each region: its sets are dealt into blocks of a row each, and every block meets every block."""
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    packed = (
        dealt.select("region", "own", "blocks", "set_id", "copies", "home", "text")
        .repartition("region", "own").sortWithinPartitions("region", "own").mapInArrow(_pack_blocks(shingle, percent), BLOCK)
    )
    met = written(packed, "jaccard-blocks").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("region", "at", "own", "names", "facts", "tokens").repartition("region", "at")
    return met.sortWithinPartitions("region", "at", F.desc(F.col("own") == F.col("at"))).mapInArrow(_meet_blocks(percent), LINK)


def _labels(near: np.ndarray) -> np.ndarray:
    """The component of each row of a symmetric matrix, from 0."""
    out, count = np.full(len(near), -1, np.int64), 0
    for root in range(len(near)):
        if out[root] < 0:
            out[root], left = count, [root]
            while left:
                new = np.flatnonzero(near[left.pop()] & (out < 0))
                out[new] = count
                left += new.tolist()
            count += 1
    return out


def _pack_blocks(shingle: int, percent: int):
    """One row per block; the rows of a block come one after the other."""
    def packed(at: tuple, held: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
        if held:
            copies, home, texts = zip(*held.values())
            sets = list(shingle_sets(pa.array(texts, pa.large_string()), shingle))
            n = np.array([len(s) for s in sets])
            group = _labels(linked(common_counts(sets), n[:, None], n[None, :], percent))
            owner, tokens = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
            order = np.argsort(tokens, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([at[2]], pa.int32()),
                 pa.array([b"".join(held)], pa.binary()), pa.array([np.array([n, copies, home, group], np.int64).tobytes()], pa.binary()),
                 pa.array([pack(tokens[order], owner[order])], pa.binary())], names=["region", "own", "blocks", "names", "facts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for region, own, blocks, name, copies, home, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (region, own, blocks) != at:
                    yield from packed(at, held)
                    at, held = (region, own, blocks), {}
                held[name] = (copies, home, text)
        yield from packed(at, held)
        held = {}
        give_back()

    return run


class _Block:
    def __init__(self, names: bytes, facts: bytes, tokens: bytes):
        self.names = [names[i:i + 16] for i in range(0, len(names), 16)]
        self.n, self.copies, home, self.group = np.frombuffer(facts, np.int64).reshape(4, -1)
        self.home = home > 0
        self.tokens, index, table = unpack(tokens)
        self.owner = table[index]

    def common(self, other: _Block) -> np.ndarray:
        """Sizes of the intersections of the sets of two blocks."""
        both = np.intersect1d(self.tokens, other.tokens)
        sides = []
        for block in (self, other):
            inside = _among(block.tokens, both)
            sides.append((np.searchsorted(both, block.tokens[inside]), block.owner[inside], len(block.names)))
        out = np.zeros((sides[0][2], sides[1][2]), np.int64)
        for first in range(0, len(both), 16384):
            dense = []
            for column, owner, rows in sides:
                low, high = np.searchsorted(column, [first, first + 16384])
                block = np.zeros((rows, 16384), np.float32)
                block[owner[low:high], column[low:high] - first] = 1
                dense.append(block)
            out += (dense[0] @ dense[1].T).astype(np.int64)
        return out

    def edges(self, other: _Block, near: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Links that connect the groups of two blocks, each connected in itself, as few as do it."""
        i, j = np.nonzero(near)
        own, all_ = int(self.group.max()) + 1, int(self.group.max()) + int(other.group.max()) + 2
        at = np.full((all_, all_), -1, np.int64)
        at[self.group[i], own + other.group[j]] = np.arange(len(i))
        at = np.maximum(at, at.T)
        return [(self.names[i[at[p, q]]], other.names[j[at[p, q]]]) for p, q in spanning(at >= 0)]


def _meet_blocks(percent: int):
    """Links of a block's sets with all of the region, and their number; the block itself comes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, found = None, None, None
        for batch in batches:
            for region, place, no, names, facts, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                block = _Block(names, facts, tokens)
                if (region, place) != at:
                    if own is not None:
                        yield _rows([], own.names, found)
                    at, own, found = (region, place), None, None
                    if no != place:
                        continue  # no set is in the block itself
                    own, found = block, np.zeros(len(block.names), np.int64)
                if own is None:
                    continue
                near = linked(own.common(block), own.n[:, None], block.n[None, :], percent)
                if no == place:
                    np.fill_diagonal(near, False)
                    edges = [(own.names[i], own.names[j]) for i, j in spanning(near)]
                else:
                    edges = own.edges(block, near) if place < no else []
                found += (near & _once(own.names, own.home, block.names, block.home)) @ block.copies
                if edges:
                    yield _rows(edges, [], np.zeros(0, np.int64))
        if own is not None:
            yield _rows([], own.names, found)
        give_back()

    return run


# -- the join ---------------------------------------------------------------------------------

def _sets_and_links(spark: SparkSession, keyed: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows of ``keyed`` (doc_id, mark, text), and what ``join_regions`` found; both written."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, size = keyed.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    shards = max(16, width, (size or 0) // SHARD_BYTES)
    common = common_shingles(keyed, shingle, n)
    packed = scratch_dir(spark, "jaccard-marked")
    keyed.mapInArrow(_mark(shards, shingle, percent, common), MARKED).write.parquet(packed)
    marked = spark.read.schema(MARKED).parquet(packed)
    base = settle(marked.filter("shard is null").select("doc_id", "mark", "n", "set_id", "node"), "jaccard-sets")
    regions = settle(neighbourhoods(marked, shards, percent), "jaccard-regions")
    files.delete(spark, packed)  # the largest of the written tables, and not read again
    near = base.filter("set_id is not null").join(regions, "node")
    chosen = settle(
        near.groupBy("set_id").agg(
            F.first("region").alias("region"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("row"))
        .select("set_id", "region", "n", "copies", F.col("row.doc_id").alias("_id"), F.col("row.mark").alias("_mark")), "jaccard-chosen")
    # few documents are members: only texts that may be are moved
    maybe, _ = parted(keyed, chosen.select(F.col("_id").alias("doc_id"), F.col("_mark").alias("mark")))
    kept = scratch_dir(spark, "jaccard-members")
    near = maybe.join(chosen, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    near = near.select("region", "set_id", "n", "copies", F.lit(True).alias("home"), "text")
    near.write.parquet(kept)
    links = join_regions(spark, spark.read.schema(near.schema).parquet(kept), shingle, percent)
    files.delete(spark, kept)
    return base, links


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, set_id, group_id, component_id and n_links of every row of ``docs``.

    Words are blank-separated with A-Z lower-cased; a document's set holds its distinct shingles, or its whole sequence
    if it has fewer words. Documents are linked where 100 * intersection >= percent * union; component_id is the smallest
    doc_id that links reach; n_links is the number of other rows linked with this one, each pair compared. Null, empty and blank texts have an empty set (set_id null), are linked with nothing and
    have their own id. Equal sets are one point of the join, so copies cost nothing beyond the first step. A null doc_id
    never names a component: one without any id has a null component_id. Repeated rows count as copies. Extra columns
    are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    with small_batches(spark, size=BATCH), shuffles_dropped(spark):
        base, links = _sets_and_links(spark, keyed, shingle, percent)
    roots = connected_components(links.filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    numbers = links.filter("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("others"))
    sets = base.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    sets = sets.join(numbers, "set_id", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    rooted = sets.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(rooted.join(least, "root").select("set_id", "root", "component_id", "n_links"), "jaccard-groups")
    filled = base.filter("set_id is not null").join(named, "set_id")
    empty = base.filter("set_id is null").select("doc_id", "mark", F.lit(0).cast("long").alias("n_shingles"), "set_id", F.col("set_id").alias("group_id"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return filled.select("doc_id", "mark", F.col("n").alias("n_shingles"), "set_id", F.col("root").alias("group_id"), "component_id", "n_links").unionByName(empty)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` per group of ``jaccard_groups``, unchanged: the smallest doc_id, null last; of several rows with
    that id the one with the smaller hash of the text. Rows without words are linked with nothing and all stay. Columns
    may have any names.

    Groups are settled on ids and hashes. Of the rows themselves only those that may lose, or repeat a winner, are moved;
    what led to the decision is deleted when it is written.
    """
    spark = docs.sparkSession
    decided = scratch_dir(spark, "jaccard-decided")
    with scratch_scope(spark), shuffles_dropped(spark):
        groups = jaccard_groups(docs, shingle, percent).filter("group_id is not null")
        rows = settle(groups.groupBy("group_id", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n")), "jaccard-rows")
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
        best = per_key(rows, "group_id", F.min(place).alias("best"))
        wins = place == F.col("best")
        judged = rows.join(best, "group_id").filter(~wins | (F.col("n") > 1)).select("doc_id", "mark", wins.alias("wins"))
        judged.write.parquet(decided)
    judged = spark.read.schema("doc_id long, mark long, wins boolean").parquet(decided)
    maybe, others = parted(boxed(docs), judged)
    theirs = judged.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "wins")
    met = maybe.join(theirs, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    once = met.filter("wins").dropDuplicates(["doc_id", "mark"])
    return others.select("row.*").unionByName(met.filter("wins is null").select("row.*")).unionByName(once.select("row.*"))

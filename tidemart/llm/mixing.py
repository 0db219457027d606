"""Mixing sources to target weights by a min-cost flow over membership patterns (operator 7)."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemart.llm.text import NOT_BLANK, count_words, give_back, small_batches
from tidemart.session import settle

MAX_COPIES = 3
SEED = 71
DIGIT = 8  # bits of the seeded hash by which the range is narrowed in which a pattern's selection ends
FINE_ROWS = 4096  # documents of such a range that are ordered at once
TRADES = 4  # documents that may be left out for one that is larger than the gap which is left when nothing fits
CLOSE = 1000  # a gap of less than this part of what a pattern gives is left as it is
BROADCAST_ROWS = 100_000  # rows of a plan (some 100 bytes each) that are broadcast; longer plans are joined by shuffle

ROUNDS = "array<struct<after: bigint, stop: bigint, most: bigint>>"

Source = str | None


def cycling_weights(sources: Sequence[Source]) -> dict[Source, float]:
    """1, 2, 3, 1, … by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(i % 3 + 1) for i, s in enumerate(ordered)}


def targets(sizes: dict[Source, int], weights: dict[Source, float], total: float, most: float = MAX_COPIES) -> dict[Source, float]:
    """Shares of ``total`` by weight; none above ``most`` times its source's size, the excess reshared by weight."""
    out: dict[Source, float] = {}
    open_, left = [s for s in weights if s in sizes], float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        above = [s for s in open_ if left * weights[s] / weight > most * sizes[s]]
        if not above:
            return out | {s: left * weights[s] / weight for s in open_}
        for s in above:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[str, int], members: dict[str, Sequence[Source]], quotas: dict[Source, int], copies: int = MAX_COPIES) -> dict[str, int]:
    """Words each pattern gives, so that quotas are filled as far as they can be and repetition costs least.

    A network start -> pattern -> source -> end. A pattern has one arc per copy of its documents, as wide as their words,
    that costs as many units a word as copies were taken before, a convex cost: all patterns of a source are read
    once before any is read twice. Shortest augmenting paths with potentials.
    """
    names = list(patterns)
    sources = list(quotas)
    start, end = 0, 1 + len(names) + len(sources)
    at = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, width: int, price: int) -> int:
        for x, y, w, p in ((a, b, width, price), (b, a, 0, -price)):
            out[x].append(len(head))
            head.append(y)
            room.append(w)
            cost.append(p)
        return len(head) - 2

    used: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        used[name] = [arc(start, 1 + i, patterns[name], copy) for copy in range(copies)]
        for s in members[name]:
            arc(1 + i, at[s], copies * patterns[name], 0)
    for s in sources:
        arc(at[s], end, quotas[s], 0)

    potential = [0] * (end + 1)
    while True:
        far = [float("inf")] * (end + 1)
        via = [-1] * (end + 1)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if room[e] and d + cost[e] + potential[x] - potential[head[e]] < far[head[e]]:
                    far[head[e]] = d + cost[e] + potential[x] - potential[head[e]]
                    via[head[e]] = e
                    heapq.heappush(heap, (far[head[e]], head[e]))
        if via[end] < 0:
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far)]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = head[via[x] ^ 1]
        width = min(room[e] for e in path)
        for e in path:
            room[e] -= width
            room[e ^ 1] += width
    return {name: sum(room[e ^ 1] for e in arcs) for name, arcs in used.items()}


@dataclass
class Share:
    """What is taken of one pattern: every document ``base`` times, and once more those of the ``rounds`` that are not in
    ``drops``, and those in ``fills``. A round (after, stop, most) has the documents of up to ``most`` words between two
    places of the seeded order; null is no limit. ``gap``: words still missing."""
    base: int
    gap: int
    close: int = 0
    rounds: list[tuple[int | None, int | None, int | None]] = field(default_factory=list)
    fills: list[int] = field(default_factory=list)
    drops: list[int] = field(default_factory=list)


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def _holds(column: str) -> Column:
    return F.coalesce(F.array_contains(column, F.col("order")), F.lit(False))


def _in_rounds(rounds: Column | str, size: Column) -> Column:
    def takes(r: Column) -> Column:
        behind = r["after"].isNull() | (F.col("order") > r["after"])
        before = r["stop"].isNull() | (F.col("order") < r["stop"])
        return behind & before & (r["most"].isNull() | (size <= r["most"]))

    return F.coalesce(F.exists(rounds, takes), F.lit(False))


@dataclass
class Plan:
    source_sizes: dict[Source, int]
    targets: dict[Source, float]
    shares: dict[str, Share]

    def copies(self, docs: DataFrame, name: str = "copies", size: str | Column = "size") -> DataFrame:
        """``docs`` (with pattern and order, see ``with_order``, and size) and how often each is taken. Nothing is
        shuffled: the decision is a lookup in the plan, one row per pattern."""
        rows = [(p, s.base, s.rounds, s.fills, s.drops) for p, s in self.shares.items()]
        plan = _small(docs.sparkSession, rows, f"pattern string, base int, rounds {ROUNDS}, fills array<long>, drops array<long>")
        plan = plan.select("pattern", F.struct("base", "rounds", "fills", "drops").alias("_plan"))
        order, own = F.col("order"), F.col("_plan")
        size = F.col(size) if isinstance(size, str) else size
        more = (_in_rounds(own["rounds"], size) & ~F.array_contains(own["drops"], order)) | F.array_contains(own["fills"], order)
        return docs.join(plan, "pattern", "left").withColumn(name, (own["base"] + more.cast("int")).cast("int")).drop("_plan")


def with_order(docs: DataFrame, sources: Column, seed: int = SEED) -> DataFrame:
    """``docs`` with its membership pattern (sorted distinct sources as JSON) and its place in the seeded order."""
    return docs.withColumns({
        "pattern": F.to_json(F.array_sort(F.array_distinct(sources))),
        "order": F.xxhash64("doc_id", "text", F.lit(seed))})


def plan_mix(sized: DataFrame, weigh: Callable[[Sequence[Source]], dict[Source, float]] = cycling_weights, copies: int = MAX_COPIES) -> Plan:
    """Plan over ``sized`` (pattern, order, size; written, as it is read a few times).

    One row per membership pattern goes to the driver. Where a pattern's selection ends is found by sums over ranges
    of the seeded order, then inside one range, so no pattern is ever sorted as a whole; behind a document that is too
    large it goes on with those that are not, until none fits. Documents with equal doc_id and text share a place in the order
    and are taken together.
    """
    totals = {r.pattern: int(r.size) for r in sized.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    members = {p: json.loads(p) for p in totals}
    sizes: dict[Source, int] = {}
    for p, found in members.items():
        for s in found:
            sizes[s] = sizes.get(s, 0) + totals[p]
    aims = targets(sizes, weigh(list(sizes)), sum(totals.values()), copies)
    taken = route(totals, members, {s: round(t) for s, t in aims.items()}, copies)
    shares = {p: Share(*(divmod(taken[p], n) if n else (0, 0)), taken[p] // CLOSE) for p, n in totals.items()}
    _select(sized.filter("size > 0"), shares)
    return Plan(sizes, aims, shares)


def _gaps(spark: SparkSession, shares: dict[str, Share]) -> DataFrame:
    rows = [(p, s.gap, s.rounds, s.fills, s.drops) for p, s in shares.items() if s.gap]
    return _small(spark, rows, f"pattern string, gap long, rounds {ROUNDS}, fills array<long>, drops array<long>")


def _walk(sized: DataFrame, shares: dict[str, Share]) -> None:
    """Rounds along the seeded order: each ends before the first place that does not fit, and the next goes on behind it
    with the documents that are no larger than the gap, until nothing is left that fits.

    Where a round ends is found digit by digit: sums over the 256 ranges that the next bits of the hash make of the range
    found so far, until that holds ``FINE_ROWS`` documents; these are then ordered. So no task sees more of a pattern.
    """
    spark = sized.sparkSession
    u = sized.withColumn("_u", F.col("order").bitwiseXOR(F.lit(-1 << 63)))
    limits: dict[str, tuple[int | None, int | None]] = {p: (None, None) for p, s in shares.items() if s.gap}
    while limits:
        fits = (F.col("after").isNull() | (F.col("order") > F.col("after"))) & (F.col("most").isNull() | (F.col("size") <= F.col("most")))
        inside = F.col("bits") == 0
        inside = inside | (F.expr("shiftrightunsigned(_u, cast(64 - bits as int))") == F.col("prefix"))

        def among(cuts: dict[str, tuple[int, int, int]]) -> DataFrame:
            """The documents that fit, of the range found so far: its leading bits, how many these are, and the sum before."""
            open_ = [(p, shares[p].gap, *limits[p], bits, _as_long(prefix, bits), before) for p, (bits, prefix, before) in cuts.items()]
            kind = "pattern string, gap long, after long, most long, bits int, prefix long, before long"
            return u.join(_small(spark, open_, kind), "pattern").filter(fits & inside)

        cuts, fine, whole = {p: (0, 0, 0) for p in limits}, {}, {}
        while cuts:
            bits = next(iter(cuts.values()))[0]
            digit = F.shiftrightunsigned("_u", 64 - DIGIT - bits).bitwiseAND(F.lit((1 << DIGIT) - 1))
            sums = among(cuts).groupBy("pattern", "gap", "before", digit.alias("digit")).agg(
                F.sum("size").alias("part"), F.count(F.lit(1)).alias("n"))
            upto = F.col("before") + F.sum("part").over(Window.partitionBy("pattern").orderBy("digit"))
            ends = sums.withColumn("upto", upto)
            over = F.when(F.col("upto") > F.col("gap"), F.struct("digit", (F.col("upto") - F.col("part")).alias("before"), "n"))
            found = ends.groupBy("pattern").agg(F.max("upto").alias("total"), F.min(over).alias("cut")).collect()
            further = {}
            for r in found:
                if r.cut is None:
                    whole[r.pattern] = r.total
                    continue
                cut = (bits + DIGIT, (cuts[r.pattern][1] << DIGIT) | r.cut.digit, r.cut.before)
                (fine if r.cut.n <= FINE_ROWS or bits + DIGIT == 64 else further)[r.pattern] = cut
            cuts = further
        within = Window.partitionBy("pattern").orderBy("order")
        places = among(fine).groupBy("pattern", "gap", "before", "order").agg(F.sum("size").alias("size"))  # equal places count together
        summed = places.withColumn("sum", F.col("before") + F.sum("size").over(within))
        stops = summed.groupBy("pattern").agg(
            F.max(F.when(F.col("sum") <= F.col("gap"), F.col("sum"))).alias("sum"), F.first("before").alias("before"),
            F.min(F.when(F.col("sum") > F.col("gap"), F.col("order"))).alias("stop")).collect() if fine else []
        further = {}
        for r in stops:
            s, (after, most) = shares[r.pattern], limits[r.pattern]
            given = r.before if r["sum"] is None else r["sum"]
            if given:
                s.rounds.append((after, r.stop, most))
                s.gap -= given
            if s.gap:
                further[r.pattern] = (r.stop, s.gap)
        for p, total in whole.items():
            shares[p].rounds.append((limits[p][0], None, limits[p][1]))
            shares[p].gap -= total
        limits = further


def _as_long(prefix: int, bits: int) -> int:
    return prefix - (1 << 64) if bits == 64 and prefix >> 63 else prefix


def _select(sized: DataFrame, shares: dict[str, Share]) -> None:
    _walk(sized, shares)
    spark = sized.sparkSession

    def places(open_: dict[str, Share], free: Column, largest: bool) -> list:
        """Per pattern the largest free place that its gap holds, or the smallest that it does not hold.

        A place is as large as all rows there, documents with equal doc_id and text."""
        if not open_:
            return []
        held = F.col("size") <= F.col("gap")
        rows = sized.join(_gaps(spark, open_), "pattern").filter(free & held if largest else free)
        found = rows.groupBy("pattern", "order", "gap").agg(F.sum("size").alias("size")).filter(held if largest else ~held)
        pick = F.max if largest else F.min
        return found.groupBy("pattern").agg(pick(F.struct("size", "order")).alias("best")).collect()

    def far() -> dict[str, Share]:
        return {p: s for p, s in shares.items() if s.gap > s.close}

    taken = _in_rounds("rounds", F.col("size"))
    # where all that is left is too large: take the smallest, and leave out as much of what was taken
    trial = far()
    for r in places(trial, ~taken & ~_holds("fills"), False):
        s = trial[r.pattern]
        trial[r.pattern] = Share(s.base, r.best.size - s.gap, s.close, s.rounds, [*s.fills, r.best.order])
    trial = {p: s for p, s in trial.items() if s is not shares[p]}
    for _ in range(TRADES):
        found = places({p: s for p, s in trial.items() if s.gap}, taken & ~_holds("drops"), True)
        for r in found:
            trial[r.pattern].drops.append(r.best.order)
            trial[r.pattern].gap -= r.best.size
        if not found:
            break
    shares.update({p: s for p, s in trial.items() if s.gap < shares[p].gap})


def word_sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and size, the number of blank-separated words of the text (null: 0)."""
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(keep)}
            yield pa.RecordBatch.from_pydict(columns | {"size": count_words(batch.column(len(keep)), NOT_BLANK)})
        give_back()

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", size long")


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken (words, repeats counted) of every row of ``docs``.

    Each row belongs to its one source; a null source is a source of its own, listed last. Sizes are words of the whole
    text; null and empty texts have none and are taken as their pattern's ``base`` says, which adds no words. Sources of
    no words have target 0. Extra columns are not read. An empty table gives no rows. Reruns agree.
    """
    ordered = with_order(docs.select("doc_id", "source", "text"), F.array(F.col("source")), seed)
    with small_batches(docs.sparkSession):
        sized = settle(word_sizes(ordered, ["doc_id", "source", "pattern", "order"]), "mix-sizes")
    plan = plan_mix(sized)
    facts = [(s, plan.source_sizes[s], float(t)) for s, t in plan.targets.items()]
    about = _small(docs.sparkSession, facts, "_source string, source_size long, target double")
    rows = plan.copies(sized)
    return rows.join(about, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them; columns stay as they are, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ordered = with_order(docs.select(row.alias("row"), "doc_id", "text", "source"), F.array(F.col("source")), seed)
    with small_batches(docs.sparkSession):
        sized = settle(word_sizes(ordered, ["pattern", "order"]), "mix-sizes")
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0))
    chosen = plan_mix(sized).copies(ordered, "_copies", size)
    return chosen.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


_WORD = r"[^\x20\x09-\x0D]+"

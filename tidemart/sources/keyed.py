"""Tables in folders by a hash of their keys, so that a fold rewrites only the folders its keys fall into."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart.sources import tables

FOLDER_BYTES = 64 << 20  # a folder beyond this is divided when it is next written
DEPTH, PLACE = "_d", "_h"  # a folder holds the keys whose hash, modulo 2**depth, is its place
Leaf = tuple[int, int]


def _place(leaf: Leaf) -> str:
    return f"{DEPTH}={leaf[0]}/{PLACE}={leaf[1]}"


def _deal(rows: DataFrame, keys: list[str], leaves: list[Leaf]) -> DataFrame:
    """``rows`` with the depth and place of their folder; ``leaves`` hold every key that occurs, each once."""
    x = F.xxhash64(*keys)

    def at(depth: int):
        return F.pmod(x, F.lit(1 << depth))

    depths = sorted({d for d, _ in leaves})
    if len(depths) == 1:
        return rows.withColumns({DEPTH: F.lit(depths[0]), PLACE: at(depths[0])})
    tried = F.explode(F.array(*[F.struct(F.lit(d).alias(DEPTH), at(d).alias(PLACE)) for d in depths]))
    listed = rows.sparkSession.createDataFrame(leaves, f"{DEPTH} int, {PLACE} long")
    return rows.withColumn("_tried", tried).select(*rows.columns, "_tried.*").join(listed, [DEPTH, PLACE]).select(*rows.columns, DEPTH, PLACE)


def _divided(leaf: Leaf, size: int, limit: int) -> list[Leaf]:
    depth, place = leaf
    more = max(0, math.ceil(math.log2(size / limit))) if size > limit else 0
    return [(depth + more, place + (i << depth)) for i in range(1 << more)]


def fold(
    changes: DataFrame, root: str, table: str, keys: list[str], resolve: Callable[[DataFrame], DataFrame], size: int,
    folder_bytes: int = FOLDER_BYTES, retain_hours: float | None = tables.RETAIN_HOURS,
    before: Callable[[DataFrame | None], None] | None = None,
) -> str:
    """Merge ``changes`` (of about ``size`` bytes, read twice) into a table; ``resolve`` picks the row of each key.

    Only the folders that keys of ``changes`` fall into are read and written; a refresh costs what the batch touches,
    not what the table holds. Folders stay below ``folder_bytes`` or so: one that has grown beyond is divided by the next
    bits of the hash when it is written again. A table that was written in another layout is dealt into folders once.
    ``before`` is given the rows that the table has of these keys (None: no table yet) before anything is written.
    """
    spark = changes.sparkSession
    found = tables.snapshot(spark, root, table)

    def tell(have: DataFrame | None) -> None:
        if before is not None:
            before(None if have is None else have.join(changes.select(*keys).distinct(), keys, "left_semi"))

    if found is None or "leaves" not in found.facts:
        have = tables.read_current(spark, root, table)
        tell(have)
        both = changes if have is None else changes.unionByName(have, allowMissingColumns=True)
        leaves = _divided((0, 0), size + (sum(found.folders.values()) if found else 0), folder_bytes)
        rows = _deal(resolve(both), keys, leaves)
        return tables.commit(rows, root, table, [DEPTH, PLACE], None, retain_hours, _facts(leaves))
    leaves, touched = _touched(changes, found, keys)
    if not touched:
        return tables.current_path(spark, root, table)
    places = found.places()
    have = _rows(spark, root, table, found, touched)
    tell(have)
    fresh = [part for leaf in touched for part in _divided(leaf, sum(found.folders[f] for f in places.get(_place(leaf), [])), folder_bytes)]
    rows = _deal(resolve(changes.unionByName(have, allowMissingColumns=True)), keys, fresh)
    gone = set(touched)
    return tables.commit(
        rows, root, table, [DEPTH, PLACE], {_place(leaf) for leaf in touched}, retain_hours,
        _facts([leaf for leaf in leaves if leaf not in gone] + fresh))


def _facts(leaves: list[Leaf]) -> dict:
    return {"leaves": leaves, "hidden": [DEPTH, PLACE]}


def _touched(changes: DataFrame, found: tables.Snapshot, keys: list[str]) -> tuple[list[Leaf], list[Leaf]]:
    """All folders of a table, and those that keys of ``changes`` fall into (the driver holds a line per folder)."""
    leaves = [(d, h) for d, h in found.facts["leaves"]]
    if len(leaves) == 1:
        return leaves, leaves
    dealt = _deal(changes.select(*keys), keys, leaves).select(DEPTH, PLACE).distinct()
    return leaves, sorted((r[0], r[1]) for r in dealt.collect())


def _rows(spark: SparkSession, root: str, table: str, found: tables.Snapshot, leaves: list[Leaf]) -> DataFrame:
    places = found.places()
    folders = [folder for leaf in leaves for folder in places.get(_place(leaf), [])]
    return tables.read_folders(spark, root, table, found, folders).drop(DEPTH, PLACE)

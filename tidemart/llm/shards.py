"""Sharding by a pseudo-random permutation of global row numbers (operator 3)."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemart.operators.keys import dense_key
from tidemart.session import settle

PRIME = (1 << 31) - 1  # products of two residues stay below 2^62
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    draw = random.Random(seed)
    return [tuple(draw.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]


def image(x: Column, a: int, b: int, seed: int) -> Column:
    """Where 0 <= x < a*b goes: a Feistel network on (x div b, x mod b) whose halves are taken modulo a and b."""
    keys = F.array(*[
        F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("pqs", key)], F.lit(i % 2 == 1).alias("odd"))
        for i, key in enumerate(round_keys(seed))])
    def turn(state: Column, key: Column) -> Column:
        v = F.when(key["odd"], state["l"]).otherwise(state["r"])
        t = (v * key["p"] + key["q"]) % PRIME
        noise = (t * t + v * key["s"]) % PRIME
        return F.struct(
            F.when(key["odd"], state["l"]).otherwise((state["l"] + noise % a) % a).alias("l"),
            F.when(key["odd"], (state["r"] + noise % b) % b).otherwise(state["r"]).alias("r"))

    def network(v: Column) -> Column:
        halves = F.struct(((v - v % b) / b).cast("long").alias("l"), (v % b).cast("long").alias("r"))
        return F.aggregate(keys, halves, turn, lambda s: s["l"] * b + s["r"])

    # x stands in the expression once, so that images of images do not multiply
    return F.get(F.transform(F.array(x), network), 0)


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def walk_length(spark: SparkSession, n: int, a: int, b: int, seed: int) -> int:
    """Steps after which every walk that starts below ``n`` is below ``n`` again.

    Only the points n .. a*b-1, fewer than the square root of n, prolong a walk. They are followed until those left are
    no fewer than before: every path that ends below n gets shorter by one point a step, so these go round in circles
    that no walk enters. The number is exact and not a guess.
    """
    steps, left, count = 1, spark.range(n, a * b), a * b - n
    while count:
        left = settle(left.select(image(F.col("id"), a, b, seed).alias("id")).filter(F.col("id") >= n), "shard-walks")
        before, count = count, left.count()
        if count == before:
            break
        steps += 1
    return steps


def shuffle_into_shards(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``position`` (its place in the shuffle), ``shard`` and ``slot``.

    Rows are numbered 0 .. n-1 in the order of ``order``; the number is permuted, and again while the image is not
    below n (cycle walking); shard = position mod shards, slot = position div shards. So shard sizes differ by one at
    most, slots have no gaps, and both can be computed from a row number alone. Runs agree whatever the partitioning.
    Only the columns of ``df`` move, in one range shuffle: pass narrow rows. Rows that agree in ``order`` share out their
    places in any order, so name all columns there for reruns to agree. Nulls sort first; an empty table gives no rows.
    Columns called position, shard or slot are replaced.
    """
    df = df.drop("position", "shard", "slot")
    n = df.count()
    a, b = grid(n)
    numbered = dense_key(df, order, "position", base=-1, kind="long")
    at = F.col("position")
    for step in range(walk_length(df.sparkSession, n, a, b, seed)):
        again = image(at, a, b, seed)
        numbered = numbered.withColumn("position", again if step == 0 else F.when(at >= n, again).otherwise(at))
    return numbered.withColumns({
        "shard": (F.col("position") % shards).cast("int"),
        "slot": ((F.col("position") - F.col("position") % shards) / shards).cast("long"),
    })


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard of every row.

    The law is ``rows``. A null text counts as empty (size 8, checksum 0); a null doc_id is numbered first; repeated rows
    get a place each. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffle_into_shards(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Parting the rows of a wide table that may be on a list of keys from those that are not, without moving any."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemart.session import settle

BITS = 25  # size of the filter as a power of two: at most 2 ** (BITS - 6) words of 64 bits travel to the tasks


def parted(rows: DataFrame, keys: DataFrame, on: tuple[str, ...] = ("doc_id", "mark")) -> tuple[DataFrame, DataFrame]:
    """Rows of ``rows`` whose columns ``on`` may be among those of ``keys``, and the others, which surely are not.

    The keys are hashed into a filter of fixed size, broadcast by words of 64 bits; so a join on the keys has to move only
    the first part. A list that fills the filter up makes that part larger, not the result other. Nulls count as values.
    """
    slot = F.shiftrightunsigned(F.xxhash64(*on), 64 - BITS)
    slots = keys.select(slot.alias("slot"))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = settle(slots.groupBy(F.shiftright("slot", 6).alias("_word")).agg(F.bit_or(one).alias("_bits")), "among")
    placed = rows.withColumn("_slot", slot)
    met = placed.withColumn("_at", F.shiftright("_slot", 6)).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    inside = F.coalesce(F.getbit("_bits", F.col("_slot").bitwiseAND(F.lit(63)).cast("int")), F.lit(0).cast("byte")) == 1
    return met.filter(inside).select(*rows.columns), met.filter(~inside).select(*rows.columns)


def boxed(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``, so that none can clash), doc_id and mark (hash of the text)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))

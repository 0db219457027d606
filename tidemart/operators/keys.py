"""Keeping one row per key, and dense integer keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemart.session import settle

COPIES = 10_000  # of one row that a task unfolds at a time
_POSITION_BITS = 33  # monotonically_increasing_id: partition above, position in it below


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``.

    Ties fall to the remaining columns, so the winner does not depend on partitioning. Spark turns
    the `= 1` filter into a row limit per key on both sides of the shuffle: a key that holds a third
    of the table sends one row per task, not all of them.
    """
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    spec = Window.partitionBy(*keys).orderBy(*(order + rest or [F.lit(0)]))  # without other columns all rows of a key agree
    return df.withColumn("_rank", F.row_number().over(spec)).filter("_rank = 1").drop("_rank")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` with an id per row that depends on the row alone, not on partitioning, so reading a file again gives the
    same ids and another file (its name is a column) gives other ones. Equal rows are told apart by a count.

    Equal rows are folded to one with their number before the shuffle and unfolded behind it; a row that fills much of
    a file is unfolded in pieces of ``COPIES`` that are spread over the tasks.
    """
    row = F.md5(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    folded = df.select(row.alias(name), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")).groupBy(name).agg(
        F.any_value("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("long")
    few = folded.filter(F.col("_n") <= COPIES).withColumn("_from", one)
    many = folded.filter(F.col("_n") > COPIES).withColumn("_from", F.explode(F.sequence(one, F.col("_n"), F.lit(COPIES).cast("long"))))
    pieces = few.unionByName(many.repartition(width, name, "_from"))
    last = F.least(F.col("_from") + (COPIES - 1), F.col("_n"))
    copies = pieces.withColumn("_copy", F.explode(F.sequence("_from", last)))
    return copies.select("_row.*", F.md5(F.concat_ws("#", name, "_copy")).alias(name))


def per_key(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """One row per key, meant to be joined back to rows of ``df``.

    Grouping by a function of the key as well changes no group, but the result is then not hashed on
    the key alone, so the join shuffles it like its other side. Spark cuts a hot key of a join into
    several tasks only when both sides come straight from a shuffle.
    """
    return df.groupBy(key, F.hash(key).alias("_apart")).agg(*aggregates).drop("_apart")


def dense_key(df: DataFrame, order: list[str], name: str, base: int = 0, kind: str = "int") -> DataFrame:
    """``base`` + 1 .. n in the order of ``order``, which must be unique.

    A row number over the whole table would sort it in one task. Here the rows are range-partitioned,
    sorted and numbered inside their partition; the partition sizes, one row per partition, then give
    each partition its start. The numbered rows are written first: range bounds come from a sample, so
    computing them twice could place rows differently.
    """
    by = [F.col(c).asc() for c in order]
    placed = settle(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_slot", F.monotonically_increasing_id()),
        f"dense-{name}",
    )
    part = F.shiftright("_slot", _POSITION_BITS)
    position = F.col("_slot").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # `starts` has at most one row per shuffle partition, whatever the table holds
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    key = (F.lit(base) + F.col("_start") + position + 1).cast(kind).alias(name)
    return numbered.select(key, *df.columns)

"""Data quality reports and column profiles."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemart.fixed_values import UNKNOWN_KEY
from tidemart.functions.columns import round_half_up, to_timestamp
from tidemart.operators.uploads import column_kind, kind_by_name


def _share(condition, rows):
    return F.try_divide(F.count_if(condition) * 100.0, rows)


def scores(fact: DataFrame, as_of: date | str | None = None, fresh_days: int = 30) -> DataFrame:
    """One row of percentages over the fact table, in one pass.

    completeness: filled order id, amount and customer key; accuracy: positive amounts; consistency:
    known customer and product; timeliness: rows at most ``fresh_days`` old at ``as_of``. 0 when empty.
    """
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    rows = F.count(F.lit(1))
    filled = F.count("transaction_id") + F.count("amount") + F.count("user_key")
    known = (F.col("user_key") != UNKNOWN_KEY) & (F.col("product_key") != UNKNOWN_KEY)
    fresh = F.datediff(today, F.col("timestamp").cast("date")) <= fresh_days
    parts = {
        "completeness": F.try_divide(filled * 100.0, rows * 3),
        "accuracy": _share(F.col("amount") > 0, rows),
        "consistency": _share(known, rows),
        "timeliness": _share(fresh, rows),
    }
    return fact.agg(*[F.coalesce(round_half_up(v, 1), F.lit(0.0)).alias(n) for n, v in parts.items()])


def trend(fact: DataFrame) -> DataFrame:
    """Filled amounts, positive amounts and known customers by month, in percent."""
    rows = F.count(F.lit(1))
    return (
        fact.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
            F.try_divide(F.count("amount") * 100.0, rows).alias("completeness"),
            _share(F.col("amount") > 0, rows).alias("accuracy"),
            _share(F.col("user_key") != UNKNOWN_KEY, rows).alias("consistency"),
        ).orderBy("month")
    )


def checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: pass when it holds rows, warning when it is empty, fail when it cannot be read. A layer without
    tables is one warning."""
    found = []
    for name in tables:
        try:
            rows = tables[name].count()
            found.append((name, "pass" if rows else "warning", rows, 0))
        except Exception:  # whatever keeps the table from being read is what the check reports
            found.append((name, "fail", 0, 1))
    return SparkSession.active().createDataFrame(
        found or [("No data", "warning", 0, 0)], "check string, status string, records bigint, issues int")


INT = r"^\s*[+-]?[0-9]+\s*$"
FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _kind_of_values() -> Column:
    """The least kind that holds all filled values of a text column: int, float or datetime, else string."""
    filled = F.count("value")

    def all_are(holds: Column) -> Column:
        return (filled > 0) & (F.count(F.when(holds, F.lit(1))) == filled)

    value = F.col("value")
    return (
        F.when(all_are(value.rlike(INT)), "int").when(all_are(value.rlike(FLOAT)), "float")
        .when(all_are(to_timestamp(value).isNotNull()), "datetime").otherwise("string")
    )


def column_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """Kind, nulls, distinct values and the first sample values of every column, over all rows.

    The kind follows the name; where that tells nothing, the type, and for text, as raw files have it, the values: int
    before float before datetime before string, the first that every filled value fits.

    Each row is unfolded into (column, value) and folded again before the shuffle, so the cost is one
    pass with partial sums, however many columns there are and however common a value is; values are judged once each.
    """
    cells = df.select(F.posexplode(F.array(*[
        F.col(f"`{c}`").cast("string") for c in df.columns
    ])).alias("ordinal", "value"))
    values = cells.groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("ordinal").orderBy("value"))
    first = (
        values.filter(F.col("value").isNotNull()).withColumn("r", rank).filter(F.col("r") <= samples)
        .groupBy("ordinal").agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]), "|").alias("samples"))
    )
    folded = values.groupBy("ordinal").agg(
        F.sum("n").alias("_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"), _kind_of_values().alias("_judged"),
    )
    names = F.array(*[F.lit(f.name) for f in df.schema])
    text = [isinstance(f.dataType, T.StringType) and kind_by_name(f.name) is None for f in df.schema]
    kinds = F.array(*[F.lit(None if t else column_kind(f.name, f.dataType)).cast("string") for f, t in zip(df.schema, text)])
    return folded.join(first, "ordinal", "left").select(
        "ordinal", names[F.col("ordinal")].alias("column"), F.coalesce(kinds[F.col("ordinal")], "_judged").alias("kind"), "null_count",
        F.try_divide(F.col("null_count").cast("double"), F.col("_rows")).alias("null_rate"),
        "unique_count", "samples")

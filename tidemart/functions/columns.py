"""Column expressions shared by the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemart.fixed_values import TIMESTAMP_FORMATS

MONEY = T.DecimalType(34, 9)
HUGE = 1e18  # amounts from here on are summed as doubles, where a billionth is below their resolution by far


def money(amount: Column) -> Column:
    """Amounts below ``HUGE`` to a billionth, so that a sum does not depend on the order in which tasks finish."""
    return F.when(F.abs(amount) < HUGE, amount).cast(MONEY)


def money_parts(amount: Column, name: str = "_money") -> list[Column]:
    """Aggregates that ``money_total`` can sum up further: an exact sum, and the sum of what is beyond it."""
    return [F.sum(money(amount)).alias(name), F.sum(F.when(F.abs(amount) >= HUGE, amount)).alias(f"{name}_huge")]


def money_total(name: str = "_money") -> Column:
    """The sum over all ``money_parts``; null when nothing was summed."""
    exact, huge = F.sum(name).cast("double"), F.sum(f"{name}_huge")
    return F.coalesce(exact + huge, exact, huge)


def money_sum(amount: Column) -> Column:
    """The sum of all amounts, of any size; null when there are none."""
    exact, huge = F.sum(money(amount)).cast("double"), F.sum(F.when(F.abs(amount) >= HUGE, amount))
    return F.coalesce(exact + huge, exact, huge)


def money_avg(amount: Column) -> Column:
    """Exact sum over count; null when nothing was counted."""
    return F.try_divide(money_sum(amount), F.count(amount))


def exact_avg(number: Column) -> Column:
    """Mean of an integer column from its exact sum."""
    return F.try_divide(F.sum(number).cast("double"), F.count(number))


def round_half_up(x: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def date_key(day: Column) -> Column:
    """yyyymmdd as an integer."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def month_key(day_key: Column) -> Column:
    return F.floor(day_key / 100).cast("int")


def to_timestamp(value: Column) -> Column:
    """ISO text first, then the known formats; null when none fits."""
    tries = [value.try_cast("timestamp")]
    tries += [F.try_to_timestamp(value.cast("string"), F.lit(fmt)) for fmt in TIMESTAMP_FORMATS]
    return F.coalesce(*tries)


def to_type(value: Column, kind: T.DataType, source: T.DataType | None = None) -> Column:
    """``value`` as ``kind``, null where it does not parse. Typed input of that kind is left alone."""
    if source == kind:
        return value
    text = source is None or isinstance(source, T.StringType)
    if isinstance(kind, T.TimestampType):
        return to_timestamp(value) if text else value.try_cast("timestamp")
    if isinstance(kind, T.DateType):
        return to_timestamp(value).cast("date") if text else value.try_cast("date")
    if isinstance(kind, T.IntegerType) and text:
        # "12.0" is a whole number that was written as a decimal
        return F.coalesce(value.try_cast("int"), F.round(value.try_cast("double")).try_cast("int"))
    return value.try_cast(kind)


def finite(df: DataFrame) -> DataFrame:
    """Infinity and NaN become null in every floating column, as a report's reader expects."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({
        c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in floating}) if floating else df


def stock_status(stock_level: Column, reorder_point: Column) -> Column:
    return (
        F.when(stock_level == 0, "out_of_stock")
        .when(stock_level <= reorder_point, "low_stock")
        .otherwise("in_stock")
    )

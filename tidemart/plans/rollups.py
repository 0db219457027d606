"""Headline numbers and short lists built on the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidemart.fixed_values import HIGH_TURNOVER, LOW_STOCK
from tidemart.functions.columns import money_sum, round_half_up
from tidemart.plans import kpi
from tidemart.plans.kpi import Gold
from tidemart.sources.tables import needs


def _exact(column: str):
    """Reports hold money as doubles; sums over them are exact again."""
    return money_sum(F.col(column))


_RATIO = T.DecimalType(18, 6)  # means and ratios are summed at six digits, in any order


PIVOT_COLUMNS = 1000


def clv_headline(gold: Gold) -> DataFrame:
    return kpi.clv(gold).agg(
        F.try_divide(_exact("estimated_clv"), F.count("estimated_clv")).alias("avg_clv"),
        F.max("estimated_clv").alias("max_clv"),
        F.count(F.lit(1)).alias("customers"),
    )


def top_customers(gold: Gold, n: int = 10) -> DataFrame:
    return kpi.clv(gold).limit(n)


def top_pairs(gold: Gold, n: int = 15, min_support: int = 2) -> DataFrame:
    return kpi.market_basket(gold, min_support).limit(n)


def segment_share(gold: Gold) -> DataFrame:
    """Customers in total, and the share of orders that are new; 0 unless both kinds exist."""
    kind = F.col("customer_type")
    counts = kpi.customer_segmentation(gold).agg(
        F.coalesce(F.sum("customer_count"), F.lit(0)).alias("total_customers"),
        F.sum(F.when(kind == "New", F.col("order_count"))).alias("_new"),
        F.sum(F.when(kind == "Returning", F.col("order_count"))).alias("_returning"),
    )
    share = F.col("_new").cast("double") / (F.col("_new") + F.col("_returning")) * 100
    new = F.coalesce(round_half_up(share, 0).cast("int"), F.lit(0))
    return counts.select("total_customers", new.alias("new_pct"), (F.lit(100) - new).alias("returning_pct"))


def _pct(part: str, whole: str):
    return round_half_up(F.try_divide(F.col(part) * 100.0, F.col(whole)), 1)


@needs("total_shipments bigint, avg_delivery_days double, fast_deliveries bigint, delayed_deliveries bigint, on_time_pct double",
       "fact_shipments")
def delivery_headline(gold: Gold) -> DataFrame:
    """All shipments: how many, mean days of the delivered ones, fast ones, and the share not delayed."""
    category = F.col("delivery_category")
    delivered_days = F.when(F.col("status") == "delivered", F.col("delivery_days"))
    sums = gold["fact_shipments"].agg(
        F.count(F.lit(1)).alias("total_shipments"),
        F.sum(delivered_days).cast("double").alias("_days"),
        F.count(delivered_days).alias("_timed"),
        F.count_if(category == "fast").alias("fast_deliveries"),
        F.count_if(category == "delayed").alias("delayed_deliveries"),
    ).withColumn("_on_time", F.col("total_shipments") - F.col("delayed_deliveries"))
    return sums.select(
        "total_shipments",
        round_half_up(F.try_divide("_days", "_timed"), 1).alias("avg_delivery_days"),
        "fast_deliveries", "delayed_deliveries",
        _pct("_on_time", "total_shipments").alias("on_time_pct"),
    )


@needs("region string, delayed_pct double", "fact_shipments")
def region_bottlenecks(gold: Gold) -> DataFrame:
    """Share of delayed shipments by origin region, over all shipments."""
    return (
        gold["fact_shipments"].groupBy(F.col("origin_region").alias("region")).agg(
            F.count_if(F.col("delivery_category") == "delayed").alias("_delayed"), F.count(F.lit(1)).alias("_n"))
        .select("region", _pct("_delayed", "_n").alias("delayed_pct"))
        .orderBy(F.desc("delayed_pct"), "region")
    )


def carrier_performance(gold: Gold) -> DataFrame:
    """Mean delivery days by carrier: the report's means, weighted by their shipments."""
    weighted = F.sum(F.col("avg_delivery_days") * F.col("shipment_count"))
    days = round_half_up(F.try_divide(weighted, F.sum("shipment_count")), 1)
    return kpi.delivery_metrics(gold).groupBy("carrier").agg(days.alias("avg_days")).orderBy("carrier")


def inventory_headline(gold: Gold) -> DataFrame:
    return kpi.inventory_turnover_by_key(gold).agg(
        round_half_up(
            F.try_divide(F.sum(F.col("turnover_ratio").cast(_RATIO)).cast("double"), F.count(F.lit(1))), 2
        ).alias("avg_turnover"),
        F.count_if(F.col("avg_stock") < LOW_STOCK).alias("low_stock"),
        F.count_if(F.col("turnover_ratio") > HIGH_TURNOVER).alias("high_turnover"),
        F.count_if(F.col("reorder_instances") > 0).alias("needs_reorder"),
    )


def stock_by_category(gold: Gold) -> DataFrame:
    return (
        kpi.inventory_turnover_by_key(gold).groupBy("category")
        .agg(round_half_up(F.sum(F.col("avg_stock").cast(_RATIO)).cast("double"), 0).cast("bigint").alias("in_stock"))
        .orderBy("category")
    )


def seasonal_units(gold: Gold) -> DataFrame:
    """Month of the year and a map of its categories to units, summed over the years: any number of categories."""
    units = kpi.seasonal_trends(gold).groupBy("month", "category").agg(F.sum("units_sold").alias("units"))
    pairs = F.array_sort(F.collect_list(F.struct("category", "units")))
    return units.filter(F.col("category").isNotNull()).groupBy("month").agg(F.map_from_entries(pairs).alias("units")).orderBy("month")


def seasonal_pivot(gold: Gold, categories: list[str] | None = None) -> DataFrame:
    """Month of the year by category, units summed over the years.

    Without ``categories`` their names are looked up first, as a pivot needs its columns: up to ``PIVOT_COLUMNS`` of them.
    ``seasonal_units`` has no such limit.
    """
    if categories is None:
        names = gold["dim_products"].select("category").filter(F.col("category").isNotNull()).distinct().orderBy("category")
        categories = [r.category for r in names.limit(PIVOT_COLUMNS + 1).collect()]
        if len(categories) > PIVOT_COLUMNS:
            raise ValueError(f"more than {PIVOT_COLUMNS} categories: name those wanted, or use seasonal_units")
    return (
        kpi.seasonal_trends(gold).groupBy("month").pivot("category", categories).agg(F.sum("units_sold"))
        .orderBy("month")
    )


def reorder_alerts(gold: Gold, n: int = 6) -> DataFrame:
    return (
        kpi.inventory_turnover_by_key(gold).filter(F.col("avg_stock") < LOW_STOCK)
        .orderBy("avg_stock", "product_key").limit(n).drop("product_key")
    )

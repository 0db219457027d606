"""Questions analysts ask, as named queries with parameters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemart.fixed_values import UNKNOWN_KEY
from tidemart.functions.columns import money_sum, money_total
from tidemart.plans import kpi
from tidemart.plans.kpi import Gold
from tidemart.sources.tables import needs

_REVENUE = "total_revenue"


def _revenue():
    return money_sum(F.col("amount")).alias(_REVENUE)


@needs("total_revenue double", "fact_transactions")
def total_revenue(gold: Gold) -> DataFrame:
    return gold["fact_transactions"].agg(_revenue())


@needs("orders bigint", "fact_transactions")
def order_count(gold: Gold) -> DataFrame:
    return gold["fact_transactions"].agg(F.count_distinct("transaction_id").alias("orders"))


@needs("avg_order_value double", "fact_transactions")
def average_order_value(gold: Gold) -> DataFrame:
    return gold["fact_transactions"].agg(
        F.try_divide(money_sum(F.col("amount")), F.count_distinct("transaction_id")).alias("avg_order_value"))


def _city_lines(gold: Gold, city: str) -> DataFrame:
    users = gold["dim_users"].filter(F.col("is_current") & (F.col("city") == city))
    return gold["fact_transactions"].join(
        users.select(F.col("surrogate_key").alias("user_key"), "user_id", "name"), "user_key")


@needs("total_revenue double", "fact_transactions", "dim_users")
def city_revenue(gold: Gold, city: str) -> DataFrame:
    return _city_lines(gold, city).agg(_revenue())


@needs("products bigint", "dim_products")
def category_product_count(gold: Gold, category: str) -> DataFrame:
    return gold["dim_products"].filter(F.col("category") == category).agg(F.count(F.lit(1)).alias("products"))


def top_customers(gold: Gold, n: int = 5) -> DataFrame:
    return kpi.clv(gold).select("user_id", "customer_name", "total_spend").limit(n)


def top_products(gold: Gold, n: int = 5) -> DataFrame:
    return kpi.top_products(gold, n).select("product_name", "category", "price", _REVENUE)


@needs("category string, total_revenue double", "fact_transactions", "dim_products")
def category_revenue(gold: Gold) -> DataFrame:
    products = gold["dim_products"].select("product_key", "category")
    return (
        kpi.product_sales(gold).join(products, "product_key").groupBy("category")
        .agg(money_total().alias(_REVENUE)).orderBy(F.desc(_REVENUE), "category")
    )


@needs("store_id string, total_revenue double", "fact_transactions", "dim_stores")
def best_store(gold: Gold) -> DataFrame:
    by_store = gold["fact_transactions"].filter(F.col("store_key") != UNKNOWN_KEY).groupBy("store_key").agg(_revenue())
    return (
        by_store.join(gold["dim_stores"].select("store_key", "store_id"), "store_key")
        .select("store_id", _REVENUE).orderBy(F.desc(_REVENUE), "store_id").limit(1)
    )


@needs("total_revenue double", "fact_transactions")
def previous_month_revenue(gold: Gold, as_of: date | str | None = None) -> DataFrame:
    """Revenue of the calendar month before ``as_of``, as a range on the timestamp."""
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    this_month = F.trunc(today, "month")
    stamp = F.col("timestamp")
    lo, hi = F.add_months(this_month, -1), this_month
    fact = gold["fact_transactions"]
    if "month_key" in fact.columns:  # opens one folder of a fact that lies by month
        fact = fact.filter(F.col("month_key") == F.year(lo) * 100 + F.month(lo))
    return fact.filter((stamp >= lo.cast("timestamp")) & (stamp < hi.cast("timestamp"))).agg(_revenue())


@needs("name string, total_spend double, orders bigint", "fact_transactions", "dim_users")
def city_top_customers(gold: Gold, city: str, n: int = 10) -> DataFrame:
    """Customers of one city by spend; orders counts their order lines."""
    return (
        _city_lines(gold, city).groupBy("user_key", "user_id", "name")
        .agg(money_sum(F.col("amount")).alias("total_spend"), F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("total_spend"), "user_id").limit(n).select("name", "total_spend", "orders")
    )

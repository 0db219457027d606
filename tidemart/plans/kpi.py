"""The ten business reports over the star schema.

Each takes the gold tables by name and returns a lazy DataFrame; a report whose tables are not all
there comes back empty with its columns. Money is summed exactly. Counts of distinct orders
shuffle on the order first, so a city, month or customer that holds much of the table is spread out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemart.fixed_values import NEW_CUSTOMER_DAYS, UNKNOWN_KEY
from tidemart.functions.columns import exact_avg, money_parts, money_sum, money_total
from tidemart.operators import basket
from tidemart.operators.keys import per_key
from tidemart.schemas import EMPTY_KPIS
from tidemart.sources.tables import empty, needs

Gold = Mapping[str, DataFrame]


def _needs(gold: Gold, report: str, *names: str) -> DataFrame | None:
    """An empty report when a table is missing, else None."""
    if all(n in gold for n in names):
        return None
    return empty(SparkSession.active(), EMPTY_KPIS[report])


def _known(column: str) -> Column:
    return F.col(column) != UNKNOWN_KEY


def _users(gold: Gold, *columns: str) -> DataFrame:
    return gold["dim_users"].filter("is_current").select(F.col("surrogate_key").alias("user_key"), *columns)


def _pairs(lines: DataFrame, *by: str) -> DataFrame:
    """Lines folded by order and customer (and ``by``): sums and a count, much fewer rows than the fact has."""
    return lines.groupBy("transaction_id", "user_key", *by).agg(*money_parts(F.col("amount")), F.count("amount").alias("_lines"))


def _counts(pairs: DataFrame, buyers: DataFrame, by: list[str]) -> DataFrame:
    """revenue, lines and distinct orders of ``pairs``, and rows of ``buyers`` (distinct customers), by ``by``.

    Orders and customers are counted from folded rows of their own; counting both distinct in one aggregate would
    multiply every row before the shuffle.
    """
    parts = ["_money", "_money_huge", "_lines"]
    orders = pairs.groupBy(*by, "transaction_id").agg(*[F.sum(p).alias(p) for p in parts]).select(
        *by, *parts, F.col("transaction_id").isNotNull().cast("long").alias("_orders"), F.lit(0).cast("long").alias("_customers"))
    nothing = [F.lit(None).cast(orders.schema[p].dataType).alias(p) for p in parts]
    customers = buyers.select(*by, *nothing, F.lit(0).cast("long").alias("_orders"), F.lit(1).cast("long").alias("_customers"))
    return orders.unionByName(customers).groupBy(*by).agg(
        money_total().alias("revenue"), F.sum("_lines").alias("lines"),
        F.coalesce(F.sum("_orders"), F.lit(0)).alias("orders"), F.coalesce(F.sum("_customers"), F.lit(0)).alias("customers"))


def clv(gold: Gold) -> DataFrame:
    """Spend, orders and active span of each current customer, highest spend first."""
    missing = _needs(gold, "clv", "fact_transactions", "dim_users")
    if missing is not None:
        return missing
    bought = (
        gold["fact_transactions"].filter(_known("user_key")).groupBy("user_key").agg(
            F.count_distinct("transaction_id").alias("purchase_count"),
            money_sum(F.col("amount")).alias("total_spend"),
            F.min("timestamp").cast("date").alias("_first"),
            F.max("timestamp").cast("date").alias("_last"),
        )
    )
    return (
        bought.join(_users(gold, "user_id", "name", "city"), "user_key")
        .select(
            "user_id",
            F.col("name").alias("customer_name"),
            F.col("city").alias("customer_city"),
            "purchase_count",
            "total_spend",
            F.try_divide("total_spend", "purchase_count").alias("avg_order_value"),
            F.datediff("_last", "_first").alias("customer_lifespan_days"),
            F.col("total_spend").alias("estimated_clv"),
        )
        .orderBy(F.desc("estimated_clv"), "user_id")
    )


def market_basket(gold: Gold, min_support: int = 3) -> DataFrame:
    """Product pairs bought in the same transaction at least ``min_support`` times."""
    missing = _needs(gold, "market_basket", "fact_transactions", "dim_products")
    if missing is not None:
        return missing
    return basket.market_basket(gold["fact_transactions"], gold["dim_products"], min_support)


def summary_kpis(gold: Gold) -> DataFrame:
    """One row: revenue, known customers who bought, orders."""
    if "fact_transactions" not in gold:
        return SparkSession.active().createDataFrame([(0.0, 0, 0)], EMPTY_KPIS["summary_kpis"])
    fact = gold["fact_transactions"]
    counted = _counts(_pairs(fact), fact.filter(_known("user_key")).select("user_key").distinct(), [])
    return counted.select(
        F.coalesce("revenue", F.lit(0.0)).alias("total_revenue"), F.col("customers").alias("active_users"),
        F.col("orders").alias("total_orders"))


_GRAINS = {"daily": ["full_date", "day_of_week"], "monthly": ["year", "month"], "yearly": ["year"]}


def revenue_timeseries(gold: Gold, granularity: str = "daily") -> DataFrame:
    """Revenue and orders per day, month or year, in calendar order."""
    if granularity not in _GRAINS:
        raise ValueError(f"granularity is one of {', '.join(_GRAINS)}")
    missing = _needs(gold, f"revenue_{granularity}", "fact_transactions", "dim_dates")
    if missing is not None:
        return missing
    grain = _GRAINS[granularity]
    sums = [money_sum(F.col("amount")).alias("revenue"), F.count_distinct("transaction_id").alias("order_count")]
    fact, dates = gold["fact_transactions"], gold["dim_dates"]
    if granularity == "daily":
        # one calendar row per key: sum by the key alone, then look the day up
        out = fact.groupBy("date_key").agg(*sums).join(dates.select("date_key", *grain), "date_key")
    else:
        out = fact.join(dates.select("date_key", *grain), "date_key").groupBy(*grain).agg(*sums)
    return out.select(*grain, "revenue", "order_count").orderBy(*grain[:2])


def city_sales(gold: Gold) -> DataFrame:
    """Orders, revenue and customers by city. avg_order_value is the mean order line."""
    missing = _needs(gold, "city_sales", "fact_transactions", "dim_users")
    if missing is not None:
        return missing
    fact, users = gold["fact_transactions"].filter(_known("user_key")), _users(gold, "city")
    buyers = fact.select("user_key").distinct().join(users, "user_key")
    return _counts(_pairs(fact).join(users, "user_key"), buyers, ["city"]).select(
        "city", F.col("orders").alias("order_count"), F.col("revenue").alias("total_revenue"),
        F.try_divide("revenue", "lines").alias("avg_order_value"), F.col("customers").alias("unique_customers"),
    ).orderBy(F.desc("total_revenue"), "city")


def product_sales(gold: Gold) -> DataFrame:
    """Lines and exact revenue by product key: what every product report starts from."""
    return gold["fact_transactions"].filter(_known("product_key")).groupBy("product_key").agg(
        F.count(F.lit(1)).alias("units_sold"),
        *money_parts(F.col("amount")),
        F.count("amount").alias("_lines"),
    )


def top_products(gold: Gold, limit: int = 10) -> DataFrame:
    """The ``limit`` products with the highest revenue."""
    missing = _needs(gold, "top_products", "fact_transactions", "dim_products")
    if missing is not None:
        return missing
    product = ["product_name", "category", "price"]
    revenue = money_total()
    return (
        product_sales(gold).join(gold["dim_products"].select("product_key", *product), "product_key")
        .groupBy(*product).agg(
            F.sum("units_sold").alias("units_sold"),
            revenue.alias("total_revenue"),
            F.try_divide(revenue, F.sum("_lines")).alias("avg_sale_price"),
        )
        .orderBy(F.desc("total_revenue"), *product).limit(limit)
    )


@needs("product_key int, product_name string, category string, units_sold bigint, avg_stock double, turnover_ratio double, "
       "reorder_instances bigint", "fact_transactions", "fact_inventory", "dim_products")
def inventory_turnover_by_key(gold: Gold) -> DataFrame:
    """Turnover with the product key, for the reports that build on it."""
    sold = gold["fact_transactions"].filter(_known("product_key")).groupBy("product_key").agg(
        F.count(F.lit(1)).alias("units_sold"))
    stock = gold["fact_inventory"].filter(_known("product_key")).groupBy("product_key").agg(
        exact_avg(F.col("stock_level")).alias("avg_stock"),
        F.count_if("needs_reorder").alias("reorder_instances"),
    )
    ratio = F.col("units_sold") / F.nullif(F.col("avg_stock"), F.lit(0.0))
    return (
        gold["dim_products"].select("product_key", "product_name", "category")
        .join(sold, "product_key", "left").join(stock, "product_key", "left")
        .select(
            "product_key", "product_name", "category",
            F.coalesce("units_sold", F.lit(0)).alias("units_sold"),
            F.coalesce("avg_stock", F.lit(0.0)).alias("avg_stock"),
            F.coalesce(ratio, F.lit(0.0)).alias("turnover_ratio"),
            "reorder_instances",
        )
    )


def inventory_turnover(gold: Gold) -> DataFrame:
    """Lines sold over mean stock, for every product. No inventory leaves reorder_instances null."""
    missing = _needs(gold, "inventory_turnover", "fact_transactions", "fact_inventory", "dim_products")
    if missing is not None:
        return missing
    rows = inventory_turnover_by_key(gold)
    return rows.orderBy(F.desc("turnover_ratio"), "product_key").drop("product_key")


def delivery_metrics(gold: Gold) -> DataFrame:
    """Delivery days, counts and cost of delivered shipments by carrier and origin region.

    Summed by store first, so that regions are looked up for one row per carrier and store. Only
    delivered shipments count, hence delayed_deliveries is 0 here; ``rollups`` counts the delayed ones.
    """
    missing = _needs(gold, "delivery_metrics", "fact_shipments", "dim_stores")
    if missing is not None:
        return missing
    category = F.col("delivery_category")
    by_store = (
        gold["fact_shipments"].filter((F.col("status") == "delivered") & _known("origin_store_key"))
        .groupBy("carrier", F.col("origin_store_key").alias("store_key")).agg(
            F.sum("delivery_days").alias("_days"), F.count("delivery_days").alias("_timed"),
            F.min("delivery_days").alias("_min"), F.max("delivery_days").alias("_max"),
            F.count(F.lit(1)).alias("_n"),
            F.count_if(category == "fast").alias("_fast"), F.count_if(category == "delayed").alias("_delayed"),
            *money_parts(F.col("shipping_cost"), "_cost"), F.count("shipping_cost").alias("_priced"),
        )
    )
    stores = gold["dim_stores"].select("store_key", F.col("region").alias("origin_region"))
    return (
        by_store.join(stores, "store_key").groupBy("carrier", "origin_region").agg(
            F.try_divide(F.sum("_days").cast("double"), F.sum("_timed")).alias("avg_delivery_days"),
            F.min("_min").alias("min_delivery_days"),
            F.max("_max").alias("max_delivery_days"),
            F.sum("_n").alias("shipment_count"),
            F.sum("_fast").alias("fast_deliveries"),
            F.sum("_delayed").alias("delayed_deliveries"),
            F.try_divide(money_total("_cost"), F.sum("_priced")).alias("avg_shipping_cost"),
        )
        .orderBy(F.asc_nulls_last("avg_delivery_days"), "carrier", "origin_region")
    )


def seasonal_trends(gold: Gold) -> DataFrame:
    """Units and revenue by month and category."""
    missing = _needs(gold, "seasonal_trends", "fact_transactions", "dim_dates", "dim_products")
    if missing is not None:
        return missing
    dates = gold["dim_dates"].select("date_key", "year", "quarter", "month")
    products = gold["dim_products"].select("product_key", "category")
    # folded by day and product first, so that the dimensions are looked up for few rows
    sold = gold["fact_transactions"].filter(_known("product_key")).groupBy("date_key", "product_key").agg(
        F.count(F.lit(1)).alias("_n"), *money_parts(F.col("amount")), F.count("amount").alias("_lines"))
    return (
        sold.join(dates, "date_key").join(products, "product_key")
        .groupBy("year", "quarter", "month", "category").agg(
            F.sum("_n").alias("units_sold"),
            money_total().alias("revenue"),
            F.try_divide(money_total(), F.sum("_lines")).alias("avg_transaction_value"),
        )
        .orderBy("year", "quarter", "month", F.desc("revenue"), "category")
    )


def customer_segmentation(gold: Gold) -> DataFrame:
    """Order lines within a week of the customer's first purchase day are New, later ones Returning.

    A customer can count in both. avg_order_value is the mean order line. The first day is joined back
    rather than taken by a window, which would gather all rows of a customer in one task.
    """
    missing = _needs(gold, "customer_segmentation", "fact_transactions")
    if missing is not None:
        return missing
    fact = gold["fact_transactions"].filter(_known("user_key")).withColumn("_day", F.col("timestamp").cast("date"))
    first = per_key(fact, "user_key", F.min("_day").alias("_first"))
    kind = F.when(F.datediff("_day", "_first") <= NEW_CUSTOMER_DAYS, "New").otherwise("Returning").alias("customer_type")
    pairs = _pairs(fact, "_day").join(first, "user_key").select("*", kind)
    # a customer has few days beside lines
    buyers = fact.select("user_key", "_day").distinct().join(first, "user_key").select("user_key", kind).distinct()
    return _counts(pairs, buyers, ["customer_type"]).select(
        "customer_type", F.col("customers").alias("customer_count"), F.col("orders").alias("order_count"),
        F.col("revenue").alias("total_revenue"), F.try_divide("revenue", "lines").alias("avg_order_value"),
    ).orderBy("customer_type")

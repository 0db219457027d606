"""Dimensions and facts of the star schema."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.fixed_values import FAST_DAYS, NORMAL_DAYS, UNKNOWN_KEY, UNKNOWN_REGION
from tidemart.functions.columns import date_key
from tidemart.operators.keys import dense_key


def dim_products(products: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Products with their keys: those of ``keys`` (product_id, product_key), or dense ones in the order of the ids."""
    rows = products.select("product_id", "product_name", "category", "price")
    if keys is None:
        return dense_key(rows, ["product_id"], "product_key")
    return rows.join(keys, "product_id").select("product_key", *rows.columns)


def store_ids(transactions: DataFrame) -> DataFrame:
    return transactions.select("store_id").filter(F.col("store_id").isNotNull()).distinct()


def dim_stores(transactions: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Stores of the transactions with their keys: those of ``keys`` (store_id, store_key), or dense ones."""
    stores = store_ids(transactions)
    region = F.concat(F.lit("Region_"), F.right("store_id", F.lit(3)))
    keyed = dense_key(stores, ["store_id"], "store_key") if keys is None else stores.join(keys, "store_id").select("store_key", "store_id")
    return keyed.withColumn("region", region)


def dim_dates(transactions: DataFrame) -> DataFrame:
    """A gap-free calendar from the first to the last transaction day."""
    bounds = transactions.agg(
        F.min("timestamp").cast("date").alias("lo"), F.max("timestamp").cast("date").alias("hi")
    )
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("full_date"))
    day = F.col("full_date")
    return days.select(
        date_key(day).alias("date_key"),
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        F.dayofweek(day).isin(1, 7).alias("is_weekend"),
    )


def _lookup(fact: DataFrame, dim: DataFrame | None, on: str, picks: dict[str, tuple[str, Column]]) -> DataFrame:
    """Left join on a business key; ``picks`` names each new column, its source and its fallback.

    The dimension has one row per key, so the fact never fans out. No broadcast is forced: Spark
    broadcasts a dimension below its size limit, and sort-merges a larger one, where the adaptive
    planner splits a key that holds much of the fact.
    """
    if dim is None:
        return fact.select("*", *[fallback.alias(new) for new, (_, fallback) in picks.items()])
    renamed = dim.select(F.col(dim.columns[0]).alias("_on"),
                         *[F.col(source).alias(f"_{new}") for new, (source, _) in picks.items()])
    joined = fact.join(renamed, F.col(on) == F.col("_on"), "left")
    return joined.select(
        *fact.columns,
        *[F.coalesce(F.col(f"_{new}"), fallback).alias(new) for new, (_, fallback) in picks.items()],
    )


def _key() -> Column:
    return F.lit(UNKNOWN_KEY).cast("int")


def _by_id(dim: DataFrame | None, id_column: str, *columns: str) -> DataFrame | None:
    return None if dim is None else dim.select(id_column, *columns)


def fact_transactions(
    transactions: DataFrame,
    users: DataFrame | None = None,
    products: DataFrame | None = None,
    stores: DataFrame | None = None,
) -> DataFrame:
    """One row per order line with the keys of its customer, product and store; -1 where unknown."""
    current = None if users is None else users.filter("is_current").select("user_id", "surrogate_key")
    fact = _lookup(transactions, current, "user_id", {"user_key": ("surrogate_key", _key())})
    fact = _lookup(fact, _by_id(products, "product_id", "product_key"), "product_id",
                   {"product_key": ("product_key", _key())})
    fact = _lookup(fact, _by_id(stores, "store_id", "store_key", "region"), "store_id",
                   {"store_key": ("store_key", _key()), "region": ("region", F.lit(UNKNOWN_REGION))})
    return fact.select(
        "transaction_id", date_key(F.col("timestamp")).alias("date_key"), "timestamp", "amount",
        "user_key", "product_key", "store_key", "region",
    )


def fact_inventory(
    inventory: DataFrame, products: DataFrame | None, stores: DataFrame | None, as_of: date | str | None = None
) -> DataFrame:
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    fact = _lookup(inventory, _by_id(products, "product_id", "product_key"), "product_id",
                   {"product_key": ("product_key", _key())})
    fact = _lookup(fact, _by_id(stores, "store_id", "store_key", "region"), "store_id",
                   {"store_key": ("store_key", _key()), "region": ("region", F.lit(UNKNOWN_REGION))})
    return fact.select(
        "product_key", "store_key", "region",
        date_key(F.col("last_restock_date")).alias("date_key"),
        "stock_level", "reorder_point", "last_restock_date", "stock_status",
        F.coalesce(F.col("stock_level") <= F.col("reorder_point"), F.lit(False)).alias("needs_reorder"),
        F.datediff(today, "last_restock_date").alias("days_since_restock"),
    )


def delivery_category(status: Column, days: Column) -> Column:
    delivered = status == "delivered"
    return (
        F.when(delivered & (days <= FAST_DAYS), "fast")
        .when(delivered & (days <= NORMAL_DAYS), "normal")
        .when(delivered, "slow")
        .when(status == "delayed", "delayed")
        .otherwise("pending")
    )


def fact_shipments(shipments: DataFrame, stores: DataFrame | None) -> DataFrame:
    """Shipments with the store dimension in two roles, origin and destination."""
    fact = shipments
    for role in ("origin", "dest"):
        fact = _lookup(
            fact, _by_id(stores, "store_id", "store_key", "region"), f"{role}_store_id",
            {f"{role}_store_key": ("store_key", _key()), f"{role}_region": ("region", F.lit(UNKNOWN_REGION))},
        )
    return fact.select(
        "shipment_id", "transaction_id", "origin_store_key", "dest_store_key", "origin_region", "dest_region",
        date_key(F.col("shipped_date")).alias("date_key"),
        "shipped_date", "delivered_date", "delivery_days", "carrier", "tracking_number", "status", "shipping_cost",
        delivery_category(F.col("status"), F.col("delivery_days")).alias("delivery_category"),
    )

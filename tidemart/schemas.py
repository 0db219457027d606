"""Typed layouts of the silver tables and of the event stream."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in text.items()])


_S, _D, _I, _DATE, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.DateType(), T.TimestampType()

SILVER: dict[str, T.StructType] = {
    "transactions": _struct({
        "transaction_id": _S, "user_id": _S, "product_id": _S,
        "timestamp": _TS, "amount": _D, "store_id": _S,
    }),
    "users": _struct({"user_id": _S, "name": _S, "email": _S, "city": _S, "signup_date": _DATE}),
    "products": _struct({"product_id": _S, "product_name": _S, "category": _S, "price": _D}),
    "inventory": _struct({
        "product_id": _S, "store_id": _S, "stock_level": _I, "reorder_point": _I,
        "last_restock_date": _DATE, "stock_status": _S,
    }),
    "shipments": _struct({
        "shipment_id": _S, "transaction_id": _S, "origin_store_id": _S, "dest_store_id": _S,
        "shipped_date": _DATE, "delivered_date": _DATE, "delivery_days": _I, "carrier": _S,
        "tracking_number": _S, "status": _S, "shipping_cost": _D,
    }),
}

# Every field of every event type; `event_type` says which of them a line fills. Values stay
# text: the silver rules type them, the same way as for files.
EVENT = T.StructType(
    [
        T.StructField(name, _S, True)
        for name in (
            "event_type", "transaction_id", "user_id", "store_id", "timestamp",
            "name", "email", "city", "signup_date",
            "product_id", "product_name", "category", "price",
            "stock_level", "reorder_point", "last_restock_date", "stock_status",
            "shipment_id", "origin_store_id", "dest_store_id", "shipped_date", "delivered_date",
            "delivery_days", "carrier", "tracking_number", "status", "shipping_cost",
        )
    ]
    + [
        T.StructField("products", T.ArrayType(_struct({"product_id": _S, "amount": _S})), True),
        T.StructField("_corrupt", _S, True),
    ]
)

EMPTY_KPIS: dict[str, str] = {
    "clv": "user_id string, customer_name string, customer_city string, purchase_count bigint, "
           "total_spend double, avg_order_value double, customer_lifespan_days int, estimated_clv double",
    "market_basket": "product_a_name string, product_b_name string, times_bought_together bigint, "
                     "product_a int, product_b int",
    "summary_kpis": "total_revenue double, active_users bigint, total_orders bigint",
    "revenue_daily": "full_date date, day_of_week string, revenue double, order_count bigint",
    "revenue_monthly": "year int, month int, revenue double, order_count bigint",
    "revenue_yearly": "year int, revenue double, order_count bigint",
    "city_sales": "city string, order_count bigint, total_revenue double, avg_order_value double, "
                  "unique_customers bigint",
    "top_products": "product_name string, category string, price double, units_sold bigint, "
                    "total_revenue double, avg_sale_price double",
    "inventory_turnover": "product_name string, category string, units_sold bigint, avg_stock double, "
                          "turnover_ratio double, reorder_instances bigint",
    "delivery_metrics": "carrier string, origin_region string, avg_delivery_days double, "
                        "min_delivery_days int, max_delivery_days int, shipment_count bigint, "
                        "fast_deliveries bigint, delayed_deliveries bigint, avg_shipping_cost double",
    "seasonal_trends": "year int, quarter int, month int, category string, units_sold bigint, "
                       "revenue double, avg_transaction_value double",
    "customer_segmentation": "customer_type string, customer_count bigint, order_count bigint, "
                             "total_revenue double, avg_order_value double",
}

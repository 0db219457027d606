"""The given TPC-H-like tables as retail raw tables, so every operator runs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemart.functions.columns import stock_status


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """A file with fewer parts than the session has cores is dealt out before heavy work on its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *columns) if df.rdd.getNumPartitions() < cores else df


def _store(number: Column) -> Column:
    return F.concat(F.lit("STORE_"), F.lpad(number.cast("string"), 6, "0"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    sold = _spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"),
        _store(F.col("l_suppkey")).alias("store_id"),
    )


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat("c_name", F.lit("@example.com")).alias("email"),
        F.col("n_name").alias("city"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("signup_date"),
        F.col("r_name").alias("_region"),
        F.col("c_mktsegment").alias("_segment"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).drop("_region", "_segment")


def users_day1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First snapshot: the furniture segment has not signed up yet."""
    return _people(spark, sf_dir).filter("_segment <> 'FURNITURE'").drop("_region", "_segment")


def users_day2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second snapshot: furniture has joined, building is missing, machinery has moved."""
    city = F.when(F.col("_segment") == "MACHINERY", F.col("_region")).otherwise(F.col("city"))
    return (
        _people(spark, sf_dir).filter("_segment <> 'BUILDING'").withColumn("city", city).drop("_region", "_segment")
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, point = F.col("stock_level"), F.col("reorder_point")
    return (
        table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("_quantity"), F.max("l_shipdate").alias("_shipped"))
        .select(
            F.col("l_partkey").cast("string").alias("product_id"),
            _store(F.col("l_suppkey")).alias("store_id"),
            (F.col("_quantity").cast("int") % 500).alias("stock_level"),
            (F.lit(10) + F.col("l_partkey") % 41).cast("int").alias("reorder_point"),
            F.col("_shipped").cast("date").alias("last_restock_date"),
        )
        .withColumn("stock_status", stock_status(level, point))
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = table(spark, sf_dir, "supplier").count()
    flag = F.col("l_returnflag")
    status = (
        F.when(flag == "R", "delayed")
        .when((F.col("l_linestatus") == "O") & (flag == "A"), "shipped")
        .otherwise("delivered")
    )
    shipped = F.col("o_orderdate").cast("date")
    days = (F.lit(1) + F.abs(F.datediff(F.col("l_shipdate").cast("date"), shipped)) % 21).cast("int")
    delivered = F.when(F.col("status") == "delivered", F.col("_days"))
    number = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                         F.col("l_partkey").cast("string"))
    return _lines(spark, sf_dir).withColumns({"status": status, "_days": days}).select(
        (F.col("l_orderkey") - F.col("l_linenumber")).cast("string").alias("shipment_id"),
        F.col("l_orderkey").cast("string").alias("transaction_id"),
        _store(F.col("l_suppkey")).alias("origin_store_id"),
        _store(F.col("l_partkey") % stores).alias("dest_store_id"),
        shipped.alias("shipped_date"),
        F.date_add(shipped, delivered).alias("delivered_date"),
        delivered.alias("delivery_days"),
        F.col("o_orderpriority").alias("carrier"),
        F.concat(F.lit("TRK"), number).alias("tracking_number"),
        "status",
        # + 0.0 turns a negative zero into zero
        (F.round(F.col("l_extendedprice") * F.col("l_tax") / 100, 2) + 0.0).alias("shipping_cost"),
    )


RAW = {"transactions": transactions, "users": users, "products": products, "inventory": inventory,
       "shipments": shipments}


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {entity: bind(spark, sf_dir) for entity, bind in RAW.items()}


def foreign_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines under the headers of a web shop export, with prices and quantities."""
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("Invoice"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("l_quantity").cast("int").cast("string").alias("Quantity"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "M/d/yyyy H:mm").alias("InvoiceDate"),
        F.col("l_extendedprice").cast("string").alias("Price"),
        F.col("o_custkey").cast("string").alias("Customer_ID"),
        F.concat(F.lit("Country "), F.col("l_suppkey").cast("string")).alias("Country"),
        "l_returnflag",
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per row of the events table, as the stream would carry it.

    purchase -> an order with k % 6 products, signup -> user, view -> product, click -> inventory or
    shipment, error -> a cut-off line or an unknown event type.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value")
    ts = F.col("ts").cast("timestamp")
    eid = F.col("event_id").cast("string")
    uid = F.col("user_id").cast("string")
    day = F.date_format(ts, "yyyy-MM-dd")
    item = F.concat(F.lit("P"), k.cast("string"))
    store = F.concat(F.lit("S"), F.lpad((F.col("user_id") % 50).cast("string"), 3, "0"))
    basket = F.transform(
        F.sequence(F.lit(0), k % 6),
        lambda i: F.struct(F.concat(F.lit("P"), (k + i).cast("string")).alias("product_id"),
                           (value + i).alias("amount")))

    def line(event_type: str, **fields: Column) -> Column:
        return F.to_json(F.struct(F.lit(event_type).alias("event_type"), *[c.alias(n) for n, c in fields.items()]))

    order = line(
        "order_created", transaction_id=F.concat(F.lit("T"), eid), user_id=uid, store_id=store,
        timestamp=F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        # entries 0 .. k % 6 without the first: k % 6 products
        products=F.slice(basket, F.lit(2), F.lit(6)))
    user = line("user_update", user_id=uid, name=F.concat(F.lit("User "), uid),
                email=F.concat(F.lit("u"), uid, F.lit("@example.com")),
                city=F.concat(F.lit("City "), (k % 10).cast("string")), signup_date=day)
    product = line("product_update", product_id=item, product_name=F.concat(F.lit("Item "), k.cast("string")),
                   category=F.concat(F.lit("C"), (k % 7).cast("string")), price=value)
    inventory = line("inventory_update", product_id=item, store_id=store, stock_level=k, reorder_point=F.lit(20),
                     last_restock_date=day, stock_status=stock_status(k, F.lit(20)))
    shipment = line("shipment_update", shipment_id=F.concat(F.lit("H"), eid), transaction_id=F.concat(F.lit("T"), eid),
                    origin_store_id=store, dest_store_id=F.lit("S000"), shipped_date=day,
                    carrier=F.lit("post"), tracking_number=F.concat(F.lit("K"), eid), status=F.lit("shipped"),
                    shipping_cost=value)
    broken = F.concat(F.lit('{"event_type": "order_created", "transaction_id": "T'), eid)
    unknown = line("price_alert", product_id=item)
    kind = F.col("event_type")
    text = (
        F.when(kind == "purchase", order).when(kind == "signup", user).when(kind == "view", product)
        .when((kind == "click") & (k < 50), inventory).when(kind == "click", shipment)
        .when(k < 50, broken).otherwise(unknown)
    )
    return _spread(table(spark, sf_dir, "events"), "event_id").select("event_id", text.alias("value"))

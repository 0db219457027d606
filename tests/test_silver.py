import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemart.operators import silver
from tidemart.sources import raw

AS_OF = "2024-06-01"


def _frame(spark, columns, data):
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))


def test_own_and_foreign_headers_together(spark, lines_in):
    root = lines_in({
        "transactions_1.csv": "transaction_id,user_id,product_id,timestamp,amount,store_id\n"
                              "T1,U1,P1,2024-01-05T10:00:00,9.5,S1\n",
        "transactions_2.csv": "Invoice,StockCode,Price,Quantity,InvoiceDate,CustomerID,Country\n"
                              "536365,85123A,2.55,6,12/1/2010 8:26,17850,United Kingdom\n",
    })
    got = silver.clean("transactions", raw.read_delimited(spark, root, "transactions_*"), AS_OF)
    assert rows(got) == sorted([
        ("T1", "U1", "P1", dt.datetime(2024, 1, 5, 10), 9.5, "S1"),
        ("536365", "17850", "85123A", dt.datetime(2010, 12, 1, 8, 26), 2.55 * 6, "United Kingdom"),
    ], key=repr)


def test_defaults_without_synonyms(spark):
    got = silver.clean("transactions", _frame(spark, ["total", "extra"], [("3.5", "a"), ("4", "b"), ("4", "b")]), AS_OF).collect()
    assert len({r.transaction_id for r in got}) == 3
    assert {(r.user_id, r.product_id, r.store_id) for r in got} == {("U001", "UNKNOWN", "S001")}
    assert {r.timestamp for r in got} == {dt.datetime(2024, 6, 1)}
    assert sorted(r.amount for r in got) == [3.5, 4.0, 4.0]


def test_amount_chain(spark):
    df = _frame(spark, ["k", "amount", "price", "quantity", "total"], [
        ("a", "5", "2", "3", "9"), ("b", None, "2", "3", "9"), ("c", "bad", "2", None, "9"),
        ("d", None, None, "3", "9"), ("e", None, None, None, None)])
    assert rows(df.select("k", silver.derive_amount(df).alias("x"))) == [
        ("a", 5.0), ("b", 6.0), ("c", 2.0), ("d", 9.0), ("e", 0.0)]


def test_bad_values_are_rejected_with_a_reason_not_fatal(spark):
    columns = ["transaction_id", "product_id", "amount", "timestamp"]
    df = _frame(spark, columns, [
        ("T1", "P1", "abc", "2024-01-01"), ("T2", "P1", "1.5", "n/a"), (None, "P1", "1", None), ("T3", None, "1", None),
        ("T4", "P1", "-2", None), ("T5", "P1", "NaN", None), ("T6", "P1", "Infinity", None)])
    good = silver.clean("transactions", df, AS_OF).select("transaction_id", "timestamp")
    assert rows(good) == [("T2", None)]
    assert rows(silver.reject_counts({"transactions": df}, AS_OF)) == [
        ("transactions", "amount is not finite", 2), ("transactions", "amount is not positive", 2),
        ("transactions", "product_id is null", 1),
        ("transactions", "transaction_id is null", 1)]


def test_duplicate_lines_keep_the_earliest_and_ties_are_stable(spark):
    columns = ["transaction_id", "product_id", "amount", "timestamp"]
    data = [("T1", "P1", "3", "2024-01-02"), ("T1", "P1", "7", "2024-01-01"), ("T1", "P1", "5", "2024-01-01"),
            ("T1", "P1", "1", None), ("T2", "P1", "2", None), ("T2", "P1", "4", "2024-01-09")]
    for partitions in (1, 2, 6):
        for order in (data, data[::-1]):
            df = _frame(spark, columns, order).repartition(partitions)
            assert rows(silver.clean("transactions", df, AS_OF).select("transaction_id", "amount")) == [
                ("T1", 5.0), ("T2", 4.0)]


def test_users_keep_the_latest_file(spark, lines_in):
    head = "user_id,name,email,city,signup_date\n"
    root = lines_in({
        "users_20240101.csv": head + "U1,Ann,a@x,Rome,2024-03-01\nU2,Bob,b@x,,2020-01-01\n",
        "users_20240102.csv": head + "U1,Ann,a@x,Oslo,2023-01-01\nU1,Ann,a@x,Bern,2023-01-02\n,No,n@x,Rome,2020-01-01\n",
    })
    got = silver.clean("users", raw.read_delimited(spark, root, "users_*"), AS_OF)
    assert rows(got.select("user_id", "city")) == [("U1", "Bern"), ("U2", "Unknown")]


def test_rules_of_the_other_tables(spark):
    products = _frame(spark, ["product_id", "product_name", "category", "price"], [
        ("P1", "a", "c", "1.5"), ("P2", "b", "c", "0"), ("P3", "b", "c", None), (None, "b", "c", "1")])
    assert rows(silver.clean("products", products).select("product_id")) == [("P1",)]
    inventory = _frame(spark, ["product_id", "store_id", "stock_level", "reorder_point"], [
        ("P1", "S1", "0", "5"), ("P1", "S2", "-1", "5"), ("P1", None, "3", "5"), ("P2", "S1", "12.0", "5")])
    assert rows(silver.clean("inventory", inventory).select("product_id", "stock_level")) == [("P1", 0), ("P2", 12)]
    shipments = _frame(spark, ["shipment_id", "shipping_cost", "delivered_date"], [
        ("H1", None, "2024-01-02"), ("H2", "-1", None), ("H3", "0", None), (None, "1", None)])
    assert rows(silver.clean("shipments", shipments).select("shipment_id", "delivered_date")) == [
        ("H1", dt.date(2024, 1, 2)), ("H3", None)]


def test_folding_batches_equals_cleaning_all_at_once(spark, sf):
    from tidemart.plans import bindings

    raw_rows = bindings.transactions(spark, sf)
    typed = silver.valid_rows("transactions", silver.typed("transactions", raw_rows))
    parts = typed.randomSplit([1.0, 1.0, 1.0], seed=5)
    folded = parts[0]
    for part in parts[1:]:
        folded = silver.unique_rows("transactions", folded.unionByName(part))
    assert rows(folded) == rows(silver.clean("transactions", raw_rows))


def test_amounts_of_any_size_count(spark):
    from tidemart.functions.columns import money_parts, money_sum, money_total

    df = spark.createDataFrame([(0.004, 1), (1e16, 1), (3e30, 2), (2.0, 2), (None, 3)], "a double, k int")
    raw = df.selectExpr("concat('T', k, a) as transaction_id", "'P' as product_id", "a as amount")
    assert silver.clean("transactions", raw, AS_OF).count() == 4
    want = [(1, 1e16 + 0.004), (2, 3e30), (3, None)]
    assert rows(df.groupBy("k").agg(money_sum(F.col("a")))) == want
    assert rows(df.groupBy("k", "a").agg(*money_parts(F.col("a"))).groupBy("k").agg(money_total())) == want
    assert rows(df.filter("a < 1").agg(money_sum(F.col("a")))) == [(0.004,)]


def test_generated_ids(spark):
    from tidemart.operators.keys import with_row_id

    df = spark.createDataFrame([("f1", "x")] * 3 + [("f1", None), ("f2", "x")], "source_file string, v string")
    ids = rows(with_row_id(df.repartition(4), "id").select("id"))
    assert len(set(ids)) == 5 and ids == rows(with_row_id(df.coalesce(1), "id").select("id"))

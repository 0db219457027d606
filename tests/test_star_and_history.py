import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from tests.conftest import rows
from tidemart.operators import history, star
from tidemart.operators.keys import dense_key, keep_one
from tidemart.plans import lakehouse
from tidemart.sources import tables

D = dt.date
USERS = "user_id string, name string, email string, city string, signup_date date"


def _users(spark, *people):
    return spark.createDataFrame([(u, n, f"{u}@x", c, D(2024, 1, 1)) for u, n, c in people], USERS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_key_equals_a_global_row_number(spark):
    df = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    want = df.withColumn("n", F.row_number().over(Window.orderBy("k")) + 7)
    got = dense_key(df, ["k"], "n", base=7)
    assert got.schema["n"].dataType.simpleString() == "int"
    assert rows(got.select("k", "n")) == rows(want.select("k", "n"))


def test_dense_key_does_not_sort_in_one_task(spark):
    plan = _plan(dense_key(spark.range(100), ["id"], "n", kind="bigint"))
    # the only single-partition step is over one row per partition
    assert "rangepartitioning" not in plan and plan.count("Exchange SinglePartition") <= 1
    assert "BroadcastHashJoin" in plan


def test_keep_one_limits_hot_keys_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = _plan(keep_one(df, ["k"], [F.col("id").asc()]))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_dates_are_gap_free_with_weekends(spark):
    txn = spark.createDataFrame(
        [(dt.datetime(2024, 1, 8, 23),), (dt.datetime(2024, 1, 5, 1),)], "timestamp timestamp")
    got = star.dim_dates(txn).orderBy("date_key").select("date_key", "day_of_week", "is_weekend").collect()
    assert [tuple(r) for r in got] == [
        (20240105, "Friday", False), (20240106, "Saturday", True), (20240107, "Sunday", True),
        (20240108, "Monday", False)]
    assert star.dim_dates(txn.filter("timestamp is null")).count() == 0


def test_facts_without_dimensions_use_unknown_members(spark):
    txn = spark.createDataFrame(
        [("T1", "U1", "P1", dt.datetime(2024, 1, 5), 2.0, "S1"), ("T2", None, "P2", None, 3.0, None)],
        "transaction_id string, user_id string, product_id string, timestamp timestamp, amount double, store_id string")
    got = star.fact_transactions(txn)
    assert rows(got.select("transaction_id", "date_key", "user_key", "product_key", "store_key", "region")) == [
        ("T1", 20240105, -1, -1, -1, "Unknown"), ("T2", None, -1, -1, -1, "Unknown")]
    stores = star.dim_stores(txn)
    assert rows(stores) == [(1, "S1", "Region_S1")]
    assert rows(star.fact_transactions(txn, stores=stores).select("transaction_id", "store_key", "region")) == [
        ("T1", 1, "Region_S1"), ("T2", -1, "Unknown")]


@pytest.mark.parametrize("status,days,want", [
    ("delivered", 3, "fast"), ("delivered", 4, "normal"), ("delivered", 7, "normal"), ("delivered", 8, "slow"),
    ("delivered", None, "slow"), ("delayed", 1, "delayed"), ("shipped", None, "pending"), (None, 2, "pending")])
def test_delivery_category(spark, status, days, want):
    df = spark.createDataFrame([(status, days)], "s string, d int")
    assert df.select(star.delivery_category(F.col("s"), F.col("d"))).first()[0] == want


def test_facts_never_fan_out_and_amounts_survive(spark, sf):
    from tidemart.plans import registry

    clean, gold = registry.clean_tables(spark, sf), registry.gold(spark, sf)
    for fact, source in (("fact_transactions", "transactions"), ("fact_inventory", "inventory"),
                         ("fact_shipments", "shipments")):
        assert gold[fact].count() == clean[source].count()
    total = F.sum(F.col("amount").cast("decimal(18,2)"))
    assert gold["fact_transactions"].agg(total).first() == clean["transactions"].agg(total).first()
    for dim, key in (("dim_users", "surrogate_key"), ("dim_products", "product_key"), ("dim_stores", "store_key")):
        n, lo, hi, distinct = gold[dim].agg(F.count("*"), F.min(key), F.max(key), F.count_distinct(key)).first()
        assert (lo, hi, distinct) == (1, n, n)


# -- history ------------------------------------------------------------------------------------

def _settled(spark, df, root):
    tables.publish(df, root, "dim_users")
    return tables.read_current(spark, root, "dim_users")


def _brief(df):
    return rows(df.select("surrogate_key", "user_id", "name", "city", "effective_date", "end_date", "is_current"))


def test_history_over_three_days(spark, tmp_path):
    root = str(tmp_path)
    day1 = _users(spark, ("U1", "Ann", "Rome"), ("U2", "Bob", "Oslo"), ("U3", "Cy", "Bern"), ("U5", "Eve", "Nice"))
    day2 = _users(spark, ("U1", "Ann", "Rome"), ("U2", "Bob", "Bonn"), ("U4", "Dee", "Lyon"), ("U5", "Eva", "Nice"))
    first = _settled(spark, history.first_load(day1), root)
    second = _settled(spark, history.merge(first, day2, "2024-02-01"), root)
    start, change = D(2024, 1, 1), D(2024, 2, 1)
    assert _brief(second) == [
        (1, "U1", "Ann", "Rome", start, None, True),
        (2, "U2", "Bob", "Oslo", start, change, False),
        (3, "U3", "Cy", "Bern", start, None, True),       # missing from the snapshot: stays
        (4, "U5", "Eve", "Nice", start, None, True),      # only the name changed: not tracked
        (5, "U2", "Bob", "Bonn", change, None, True),
        (6, "U4", "Dee", "Lyon", start, None, True),
    ]
    assert _brief(history.merge(second, day2, "2024-02-01")) == _brief(second)
    third = history.merge(second, _users(spark, ("U2", "Bob", "Oslo")), "2024-03-01")
    u2 = [r for r in _brief(third) if r[1] == "U2"]
    assert u2 == [
        (2, "U2", "Bob", "Oslo", start, change, False), (5, "U2", "Bob", "Bonn", change, D(2024, 3, 1), False),
        (7, "U2", "Bob", "Oslo", D(2024, 3, 1), None, True)]
    current = third.filter("is_current").groupBy("user_id").count().filter("count <> 1").count()
    assert current == 0


def test_history_options(spark, tmp_path):
    day1 = _users(spark, ("U1", "Ann", "Rome"), ("U2", "Bob", "Oslo"))
    first = _settled(spark, history.first_load(day1), str(tmp_path))
    gone = history.merge(first, _users(spark, ("U1", "Ann", "Bonn")), "2024-02-01", drop_missing=True)
    assert [r[1] for r in _brief(gone)] == ["U1", "U1"]
    back = history.merge(_settled(spark, gone, str(tmp_path)),
                         _users(spark, ("U1", "Ann", "Bonn"), ("U2", "Bob", "Oslo")), "2024-03-01", drop_missing=True)
    assert [r[1] for r in _brief(back)] == ["U1", "U1", "U2"]
    renamed = history.merge(first, _users(spark, ("U1", "Anna", "Rome"), ("U2", "Bob", "Oslo")), "2024-02-01",
                            tracked=("city", "name"))
    assert renamed.filter("user_id = 'U1'").count() == 2
    no_city = history.merge(first, _users(spark, ("U1", "Ann", None), ("U2", "Bob", "Oslo")), "2024-02-01")
    assert no_city.filter("user_id = 'U1'").count() == 2


def test_upsert_and_remove(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame([(2, "B"), (4, "D")], "k int, v string")
    merged = history.upsert(table, changes, ["k"])
    assert rows(merged) == [(1, "a"), (2, "B"), (3, "c"), (4, "D")]
    assert rows(history.remove(merged, changes, ["k"])) == [(1, "a"), (3, "c")]


# -- whole builds -------------------------------------------------------------------------------

def test_build_from_files_skips_what_is_missing_and_survives_what_fails(spark, lines_in, tmp_path):
    raw_root = lines_in({
        "transactions_1.csv": "transaction_id,user_id,product_id,timestamp,amount,store_id\n"
                              "T1,U1,P1,2024-01-05 10:00:00,9.5,ST_001\nT1,U1,P2,2024-01-05 10:00:00,1,ST_001\n",
        "users_1.csv": "user_id,name,email,city,signup_date\nU1,Ann,a@x,Rome,2024-01-01\n",
    })
    lake = str(tmp_path / "lake")
    status = {(r.layer, r.table): (r.rows, r.status)
              for r in lakehouse.build_from_files(spark, raw_root, lake, "2024-02-01").collect()}
    assert status[("silver", "transactions")] == (2, "built")
    assert status[("silver", "products")] == (None, "skipped")
    assert status[("gold", "fact_transactions")] == (2, "built")
    assert status[("gold", "fact_shipments")] == (None, "skipped")
    gold = lakehouse.read_gold(spark, lake)
    assert rows(lakehouse.read_silver(spark, lake)["users"].select("user_id")) == [("U1",)]
    assert rows(gold["fact_transactions"].select("user_key", "product_key", "region")) == [(1, -1, "Region_001")] * 2

    bad = {"transactions": spark.range(3).selectExpr("raise_error('broken') as amount"),
           "users": lakehouse.read_raw(spark, raw_root, "users")}
    report = {(r.layer, r.table): r.status for r in lakehouse.build_lakehouse(spark, bad, str(tmp_path / "l2")).collect()}
    assert report[("silver", "transactions")].startswith("failed")
    assert report[("gold", "dim_users")] == "built"


def test_large_facts_are_laid_out_by_month(spark, sf, tmp_path):
    from tidemart.plans import bindings

    raw_tables = {"transactions": bindings.transactions(spark, sf)}
    lakehouse.build_lakehouse(spark, raw_tables, str(tmp_path), "2002-01-01")
    fact = lakehouse.read_gold(spark, str(tmp_path))["fact_transactions"]
    pruned = fact.filter("month_key = 199601")
    assert "PartitionFilters: [isnotnull(month_key" in _plan(pruned)
    assert pruned.count() > 0
    assert fact.count() == 5942


def test_a_failed_build_leaves_the_whole_previous_gold(spark, tmp_path, monkeypatch):
    from tidemart.operators import star
    from tidemart.plans import kpi, lakehouse

    def raw(*products):
        sold = spark.createDataFrame([("T1", "U1", "P5", "2024-01-05", "10", "S1")],
                                     "transaction_id string, user_id string, product_id string, timestamp string, amount string, store_id string")
        listed = spark.createDataFrame([(p, f"name {p}", "c", "1") for p in products], "product_id string, product_name string, category string, price string")
        return {"transactions": sold, "products": listed}

    def top():
        return [r.product_name for r in kpi.top_products(lakehouse.read_gold(spark, str(tmp_path))).collect()]

    lakehouse.build_lakehouse(spark, raw("P5"), str(tmp_path), "2024-06-01")
    assert top() == ["name P5"]
    before = lakehouse.read_gold(spark, str(tmp_path))
    fact = star.fact_transactions
    monkeypatch.setattr(star, "fact_transactions", lambda *a: (_ for _ in ()).throw(ValueError("no")))
    report = lakehouse.build_lakehouse(spark, raw("P1", "P5"), str(tmp_path), "2024-06-01")
    assert report.filter("status like 'failed%'").count() == 1
    assert top() == ["name P5"] and lakehouse.read_gold(spark, str(tmp_path))["dim_products"].count() == 1
    monkeypatch.setattr(star, "fact_transactions", fact)
    lakehouse.build_lakehouse(spark, raw("P1", "P5"), str(tmp_path), "2024-06-01")
    assert top() == ["name P5"] and lakehouse.read_gold(spark, str(tmp_path))["dim_products"].count() == 2
    assert kpi.top_products(before).count() == 1  # a reader keeps what it opened

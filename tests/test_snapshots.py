"""Snapshots that share folders, folds that rewrite only the folders they touch, gold that follows the batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemart.operators import history
from tidemart.operators.keys import keep_one
from tidemart.plans import kpi, lakehouse
from tidemart.sources import files, keyed, tables
from tidemart.streaming import ingest

AS_OF = "2024-06-01"


def _parts(spark, n, months=4):
    return spark.range(n).selectExpr("id", f"202401 + id % {months} as month_key")


def _written(root, table, version):
    """Bytes of data files that a version wrote."""
    top = os.path.join(root, table, "data", f"_v={version}")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


def _names(root, table):
    found = set()
    for d, _, names in os.walk(os.path.join(root, table, "data")):
        found |= {os.path.join(d, f) for f in names if f.endswith(".parquet")}
    return found


# -- snapshots ----------------------------------------------------------------------------------

def test_places_are_replaced_and_the_rest_is_shared(spark, tmp_path):
    root = str(tmp_path)
    tables.commit(_parts(spark, 100), root, "t", ["month_key"])
    before, names = tables.read_current(spark, root, "t"), _names(root, "t")
    changed = _parts(spark, 100).filter("month_key = 202402").withColumn("id", -F.col("id"))
    tables.commit(changed, root, "t", ["month_key"], {"month_key=202402"})
    now = tables.read_current(spark, root, "t")
    assert now.filter("month_key = 202402").agg(F.max("id")).first()[0] < 0
    assert rows(now.filter("month_key <> 202402")) == rows(before.filter("month_key <> 202402"))
    assert names < _names(root, "t") and len(_names(root, "t")) == len(names) + 1  # one folder was written, none rewritten
    assert rows(before) == rows(_parts(spark, 100).select("id", "month_key"))  # an open reader keeps its files
    plan = now.filter("month_key = 202403")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan


def test_folders_are_added_and_places_can_vanish(spark, tmp_path):
    root = str(tmp_path)
    tables.commit(_parts(spark, 8, 2), root, "t", ["month_key"])
    tables.commit(_parts(spark, 8, 2), root, "t", ["month_key"], ())
    assert tables.read_current(spark, root, "t").count() == 16
    tables.commit(_parts(spark, 0, 2), root, "t", ["month_key"], {"month_key=202401"})
    assert rows(tables.read_current(spark, root, "t").groupBy("month_key").count()) == [(202402, 8)]
    tables.commit(_parts(spark, 0, 2), root, "t", ["month_key"])
    now = tables.read_current(spark, root, "t")
    assert now.count() == 0 and now.columns == ["id", "month_key"]


def test_rows_without_month_and_odd_types(spark, tmp_path):
    root = str(tmp_path)
    df = spark.sql("SELECT * FROM VALUES (1, null, true), (2, 202401, false), (3, 202401, true) t(id, month_key, flag)")
    tables.commit(df, root, "t", ["month_key", "flag"])
    assert rows(tables.read_current(spark, root, "t")) == rows(df)
    assert tables.read_current(spark, root, "t").dtypes == df.dtypes
    none = "month_key=__HIVE_DEFAULT_PARTITION__/flag=true"
    tables.commit(df.filter("month_key is null").withColumn("id", F.lit(9)), root, "t", ["month_key", "flag"], {none})
    assert [r.id for r in tables.read_current(spark, root, "t").orderBy("id").collect()] == [2, 3, 9]


def test_what_was_dropped_goes_after_its_time(spark, tmp_path):
    root = str(tmp_path)
    for i in range(4):
        tables.commit(spark.range(i + 1), root, "t", retain_hours=0)
    assert len(_names(root, "t")) <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(d for d in os.listdir(tmp_path / "t" / "data")) == ["_v=3", "_v=4"]
    for i in range(3):
        tables.commit(spark.range(i + 1), root, "u")
    assert len(os.listdir(tmp_path / "u" / "data")) == 3  # readers may still have them
    assert len(list((tmp_path / "u").glob("v=*"))) == 2 and tables.read_current(spark, root, "u").count() == 3


def test_a_write_that_died_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    tables.commit(spark.range(3), root, "t")
    spark.range(99).write.parquet(f"{root}/t/data/_v=2")  # no listing names it
    assert tables.read_current(spark, root, "t").count() == 3
    tables.commit(spark.range(5), root, "t")
    assert tables.read_current(spark, root, "t").count() == 5


def test_sealed_sets_keep_their_versions(spark, tmp_path):
    root = str(tmp_path)

    def version(n):
        path = tables.commit(spark.range(n).withColumn("month_key", F.lit(202400 + n)), root, "t", ["month_key"], (), retain_hours=None)
        tables.seal(spark, root, {"t": path}, retain_hours)

    retain_hours = 24
    version(1)
    layer = tables.layer(spark, root)
    version(2)
    tables.commit(spark.range(50).withColumn("month_key", F.lit(1)), root, "t", ["month_key"], None, retain_hours=None)  # never sealed
    assert layer["t"].count() == 1 and tables.layer(spark, root)["t"].count() == 3
    retain_hours = 0
    version(4)
    assert tables.layer(spark, root)["t"].count() == 54 and len(list((tmp_path / "t").glob("v=*"))) == 1  # nothing before the newest set


def test_tables_of_the_older_layout_are_read(spark, tmp_path):
    root = str(tmp_path)
    spark.range(7).write.parquet(f"{root}/t/v=000001")
    assert tables.read_current(spark, root, "t").count() == 7
    tables.publish(tables.read_current(spark, root, "t").selectExpr("id + 1 as id"), root, "t")
    assert tables.read_current(spark, root, "t").agg(F.max("id")).first()[0] == 7


# -- folds by key -------------------------------------------------------------------------------

def _keyed_rows(spark, ids, value):
    return spark.createDataFrame([(i, value) for i in ids], "k long, v long")


def _latest(df):
    return keep_one(df, ["k"], [F.desc("v")])


def _fold(spark, root, ids, value, folder_bytes):
    return keyed.fold(_keyed_rows(spark, ids, value), root, "t", ["k"], _latest, 40 * len(ids), folder_bytes)


def _wide(spark, n, value):
    return spark.range(n).select(F.col("id").alias("k"), F.lit(value).cast("long").alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("pad"))


@pytest.mark.parametrize("folder_bytes", [1 << 20, 400])
def test_folds_equal_one_resolve(spark, tmp_path, folder_bytes):
    root, want = str(tmp_path), {}
    for step, ids in enumerate([range(0, 60), range(50, 64), [3], range(100, 300), [3, 59, 299], []]):
        _fold(spark, root, list(ids), step, folder_bytes)
        want |= {i: step for i in ids}
        assert dict(rows(tables.read_current(spark, root, "t"))) == want
    leaves = tables.snapshot(spark, root, "t").facts["leaves"]
    assert (len(leaves) > 8) == (folder_bytes == 400) and abs(sum(2.0 ** -d for d, _ in leaves) - 1) < 1e-9
    assert tables.read_current(spark, root, "t").columns == ["k", "v"]


def test_bytes_of_a_refresh_follow_the_batch_not_the_table(spark, tmp_path):
    """Ten changed keys cost about the same in a table of 4,000 rows and in one of 64,000."""
    cost = {}
    for n in (4_000, 64_000):
        root = str(tmp_path / str(n))
        keyed.fold(_wide(spark, n, 0), root, "t", ["k"], _latest, 160 * n, 16 << 10)
        whole = _written(root, "t", 1)
        keyed.fold(_wide(spark, n, 1).filter(f"k % {n // 10} = 0"), root, "t", ["k"], _latest, 1600, 16 << 10)
        cost[n] = _written(root, "t", 2)
        assert tables.read_current(spark, root, "t").count() == n
        assert tables.read_current(spark, root, "t").filter("v = 1").count() == 10
        assert cost[n] < whole
    assert cost[64_000] < 1.6 * cost[4_000]


def test_the_rows_that_are_replaced_are_told_before(spark, tmp_path):
    root, told = str(tmp_path), []

    def fold(ids):
        keyed.fold(_keyed_rows(spark, ids, 8), root, "t", ["k"], _latest, 40, 300, before=lambda have: told.append(None if have is None else rows(have)))

    fold([1])
    _fold(spark, root, list(range(100)), 7, 300)
    _fold(spark, root, list(range(100)), 7, 300)
    fold([5, 5, 99, 400])
    assert told == [None, [(5, 7), (99, 7)]]


# -- gold follows the batch ---------------------------------------------------------------------

def _order(n, product, day, user="U1", amount=5.0):
    return {"event_type": "order_created", "transaction_id": f"T{n}", "user_id": user, "store_id": "ST_001",
            "timestamp": f"{day}T10:00:00", "products": [{"product_id": product, "amount": amount}]}


def _product(p, price=1.0):
    return {"event_type": "product_update", "product_id": p, "product_name": f"name {p}", "category": "c", "price": price}


def _user(u, city):
    return {"event_type": "user_update", "user_id": u, "name": u, "email": f"{u}@x", "city": city, "signup_date": "2024-01-01"}


class Lake:
    def __init__(self, spark, path):
        self.spark, self.path, self.root, self.n = spark, path, str(path / "lake"), 0
        (path / "landing").mkdir()

    def batch(self, *events):
        (self.path / "landing" / f"{self.n}.jsonl").write_text("\n".join(json.dumps(e) for e in events) + "\n")
        self.n += 1
        ingest.run_available(self.spark, str(self.path / "landing"), self.root, str(self.path / "cp"), AS_OF)
        return lakehouse.read_gold(self.spark, self.root)

    def whole(self, name):
        """The same silver through a build from nothing."""
        other = str(self.path / name)
        raw = lakehouse.read_silver(self.spark, self.root)
        lakehouse.build_lakehouse(self.spark, raw, other, AS_OF)
        return lakehouse.read_gold(self.spark, other)

    def folders(self, table):
        return set(tables.snapshot(self.spark, lakehouse.gold_root(self.root), table).folders)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, tmp_path)


def _named_facts(gold):
    """Facts with ids in place of keys, which two builds may number differently."""
    fact = gold["fact_transactions"].drop("month_key")
    products = gold["dim_products"].select("product_key", "product_id")
    users = gold["dim_users"].selectExpr("surrogate_key as user_key", "user_id", "is_current")
    stores = gold["dim_stores"].select("store_key", "store_id")
    return rows(fact.join(products, "product_key", "left").join(users, "user_key", "left").join(stores, "store_key", "left")
                .drop("product_key", "user_key", "store_key"))


def test_a_batch_rewrites_only_its_months(lake):
    lake.batch(*[_order(i, f"P{i % 3}", f"2024-0{1 + i % 4}-05") for i in range(12)], _product("P1"), _product("P2"), _user("U1", "Rome"))
    first = lake.folders("fact_transactions")
    assert len(first) == 4
    keys = dict(rows(lakehouse.read_gold(lake.spark, lake.root)["dim_products"].select("product_id", "product_key")))
    lake.batch(_order(50, "P1", "2024-03-09"))
    second = lake.folders("fact_transactions")
    assert {f.partition("/")[2] for f in second - first} == {"month_key=202403"} and len(first & second) == 3
    # a product that sorts first: no key changes, and only months with its own lines are rewritten
    gold = lake.batch(_product("A0"), _order(51, "A0", "2024-02-01"))
    third = lake.folders("fact_transactions")
    assert {f.partition("/")[2] for f in third - second} == {"month_key=202402"}
    now = dict(rows(gold["dim_products"].select("product_id", "product_key")))
    assert {p: now[p] for p in keys} == keys and now["A0"] == 3
    assert _named_facts(gold) == _named_facts(lake.whole("whole"))
    assert rows(kpi.top_products(gold)) == rows(kpi.top_products(lake.whole("again")))


def test_rows_whose_ids_become_known_later(lake):
    """P0 is sold in January and March before it is listed; a user moves; an old line gets an earlier day."""
    gold = lake.batch(*[_order(i, f"P{i % 3}", f"2024-0{1 + i % 4}-05") for i in range(12)], _product("P1"), _user("U1", "Rome"))
    assert gold["fact_transactions"].filter("product_key = -1").count() == 8
    before = lake.folders("fact_transactions")
    gold = lake.batch(_product("P0"))
    after = lake.folders("fact_transactions")
    assert len(after - before) == 4 and gold["fact_transactions"].filter("product_key = -1").count() == 4
    gold = lake.batch(_user("U1", "Oslo"))
    assert rows(gold["dim_users"].select("city", "is_current")) == [("Oslo", True), ("Rome", False)]
    assert gold["fact_transactions"].select("user_key").distinct().count() == 1
    before = lake.folders("fact_transactions")
    gold = lake.batch(_order(3, "P0", "2023-12-24"))  # it stood in April
    moved = {f.partition("/")[2] for f in before ^ lake.folders("fact_transactions")}
    assert moved == {"month_key=202312", "month_key=202404"}
    assert _named_facts(gold) == _named_facts(lake.whole("whole"))


def test_a_refresh_that_dies_between_dimensions_and_facts(lake, monkeypatch):
    lake.batch(*[_order(i, f"P{i % 3}", f"2024-0{1 + i % 4}-05") for i in range(12)], _product("P1"), _user("U1", "Rome"))
    from tidemart.operators import star

    fact = star.fact_transactions
    monkeypatch.setattr(star, "fact_transactions", lambda *a: (_ for _ in ()).throw(ValueError("no")))
    with pytest.raises(Exception):
        lake.batch(_product("P0"), _product("P2"), _order(99, "P9", "2024-02-02"))
    monkeypatch.setattr(star, "fact_transactions", fact)
    gold = lake.batch(_user("U9", "Bern"))
    assert gold["fact_transactions"].filter("product_key = -1").count() == 1
    assert _named_facts(gold) == _named_facts(lake.whole("whole"))


def test_days_since_restock_follow_the_day(spark, tmp_path):
    raw = {"inventory": spark.createDataFrame([("P1", "S1", "4", "9", "2024-01-02")],
                                              "product_id string, store_id string, stock_level string, reorder_point string, last_restock_date string")}
    root = str(tmp_path)
    lakehouse.build_lakehouse(spark, raw, root, "2024-01-12")
    for day, want in (("2024-01-12", 10), ("2024-01-13", 11)):
        ingest.refresh_gold(spark, root, day, {})
        assert [r.days_since_restock for r in lakehouse.read_gold(spark, root)["fact_inventory"].collect()] == [want]


def test_closed_versions_stay_in_their_files(spark, tmp_path):
    def users(*found):
        return {"users": spark.createDataFrame([(u, u, f"{u}@x", c, "2024-01-01") for u, c in found],
                                               "user_id string, name string, email string, city string, signup_date string")}

    root, gold = str(tmp_path), lakehouse.gold_root(str(tmp_path))
    closed, history_of = [], []
    for day, found in (("2024-02-01", [("U1", "Rome"), ("U2", "Oslo")]), ("2024-03-01", [("U1", "Bern"), ("U2", "Oslo")]),
                       ("2024-04-01", [("U1", "Bern"), ("U2", "Nice")]), ("2024-05-01", [("U1", "Bern"), ("U2", "Nice")])):
        lakehouse.build_lakehouse(spark, users(*found), root, day)
        folders = tables.snapshot(spark, gold, "dim_users").folders
        closed.append({f for f in folders if f.endswith("is_current=false")})
        history_of.append(rows(lakehouse.read_gold(spark, root)["dim_users"].select("user_id", "city", "is_current")))
    assert closed[0] == set() and len(closed[1]) == 1 and closed[1] < closed[2] and closed[2] == closed[3]
    assert history_of[2] == [("U1", "Bern", True), ("U1", "Rome", False), ("U2", "Nice", True), ("U2", "Oslo", False)]
    assert history_of[3] == history_of[2]


def test_only_changes_are_written_for_a_merge(spark):
    users = spark.range(200).selectExpr("concat('U', id) as user_id", "'n' as name", "'e' as email", "'Rome' as city", "date'2024-01-01' as signup_date")
    first = history.first_load(users)
    moved = users.withColumn("city", F.when(F.col("user_id") == "U7", "Oslo").otherwise(F.col("city")))
    found = history.changes(first, moved, "2024-02-01")
    assert found.changed.count() == 2 and found.kept.count() == 199 and found.closed.count() == 1
    assert [r.surrogate_key for r in found.opened.collect()] == [201]

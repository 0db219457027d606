import pytest
from pyspark.sql import types as T

from tests.conftest import rows
from tidemart.operators import access, uploads
from tidemart.operators.silver import clean
from tidemart.plans import lakehouse, registry

SHOP = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
AS_OF = "2024-06-01"


def _frame(spark, columns, data):
    return spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in columns))


def test_standard_names():
    got = uploads.standard_names(SHOP + ["Email Address", "Order ID", "unit price", "Gift Wrap?"])
    assert got == {
        "InvoiceNo": "transaction_id", "StockCode": "product_id", "Description": "product_name",
        "Quantity": "quantity", "InvoiceDate": "timestamp", "UnitPrice": "price", "CustomerID": "user_id",
        "Country": "store_id", "Email Address": "email", "Order ID": "transaction_id", "unit price": "price",
        "Gift Wrap?": "gift_wrap"}


def test_recommended_names():
    got = uploads.recommended_names(["OrderID", "Customer", "Item", "Date", "Total"])
    assert got == {"transaction_id": "OrderID", "user_id": "Customer", "product_id": "Item", "timestamp": "Date",
                   "amount": "Total"}
    assert uploads.recommended_names(SHOP)["name"] == "Description"


def test_rule_names_and_kinds():
    schema = T.StructType([T.StructField(c, T.StringType()) for c in SHOP + ["Discount", "Units"]])
    got = uploads.rule_names(schema)
    assert got["InvoiceNo"] == "transaction_id" and got["CustomerID"] == "user_id"
    assert got["UnitPrice"] == "amount" and got["InvoiceDate"] == "timestamp" and got["Quantity"] == "quantity"
    assert got["Country"] == "store_id" and got["Description"] == "product_name" and got["Units"] == "quantity"
    assert "Discount" not in got
    assert uploads.column_kind("score", T.DoubleType()) == "float"
    assert uploads.column_kind("score", T.LongType()) == "int"
    assert uploads.column_kind("seen", T.TimestampType()) == "datetime"


@pytest.mark.parametrize("headers,scan,upload", [
    (SHOP, "transactions", "transactions"),
    (SHOP + ["Category"], "transactions", "combined"),
    (["OrderID", "Total"], "transactions", "transactions"),
    (["user_id", "email"], "users", "users"),
    (["sku", "category"], "products", "products"),
    (["sku", "stock_level"], "products", "inventory"),
    (["carrier", "tracking"], "unknown", "shipments"),
    (["warehouse"], "unknown", "inventory"),
    (["x", "y"], "unknown", "unknown"),
])
def test_entities(headers, scan, upload):
    assert uploads.scanned_entity(headers) == scan
    assert uploads.upload_entity(headers) == upload


def test_headers_with_the_same_target_are_coalesced(spark):
    df = _frame(spark, ["Invoice", "Order No", "x"], [("1", "9", "a"), (None, "2", "b")])
    got = uploads.rename(df, uploads.standard_names(df.columns), source="web")
    assert got.columns == ["transaction_id", "x", "data_source"]
    assert rows(got) == [("1", "a", "web"), ("2", "b", "web")]


def test_upload_of_prices_keeps_its_rows(spark):
    """price x quantity is derived before defaults are filled, so no row ends up with amount 0."""
    df = _frame(spark, ["id", "price", "quantity"], [("1", "2.5", "4"), ("2", "3", None)])
    mapped = uploads.mapped_upload(df, "transactions", {"transaction_id": "id"}, AS_OF)
    got = clean("transactions", mapped, AS_OF)
    assert rows(got.select("transaction_id", "product_id", "amount", "store_id")) == [
        ("1", "P001", 10.0, "S001"), ("2", "P001", 3.0, "S001")]


def test_one_header_can_serve_two_targets(spark):
    df = _frame(spark, ["o", "p"], [("1", "2.5")])
    mapped = uploads.mapped_upload(df, "transactions", {"transaction_id": "o", "amount": "p", "price": "p"}, AS_OF)
    assert mapped.select("amount", "price").first() == ("2.5", "2.5")


def test_required_columns(spark):
    df = _frame(spark, ["a"], [("1",)])
    with pytest.raises(ValueError, match="transaction_id, amount"):
        uploads.mapped_upload(df, "transactions", {"user_id": "a"}, AS_OF)
    filled = uploads.mapped_upload(df, "users", {"user_id": "a"}, AS_OF)
    assert rows(filled.select("user_id", "name", "email", "city", "signup_date")) == [
        ("1", "Unknown", "unknown@example.com", "Unknown", "2024-06-01")]


def test_split_combined_file(spark):
    df = _frame(spark, SHOP + ["Email", "Category"], [
        ("1", "A", "pen", "2", "12/1/2010 8:26", "1.5", "7", "France", "x@y", "office"),
        ("1", "B", "ink", "1", "12/1/2010 8:26", "4", "7", "France", "x@y", "office"),
        ("2", "A", "pen", "1", "12/2/2010 8:26", "1.5", "8", "Spain", "z@y", "office")])
    parts = uploads.normalize_upload(df, AS_OF)
    assert {k: v.count() for k, v in parts.items()} == {"users": 2, "products": 2, "transactions": 3}
    assert rows(clean("transactions", parts["transactions"]).select("transaction_id", "product_id", "amount", "store_id")) == [
        ("1", "A", 3.0, "France"), ("1", "B", 4.0, "France"), ("2", "A", 1.5, "Spain")]
    assert rows(clean("users", parts["users"]).select("user_id", "email")) == [("7", "x@y"), ("8", "z@y")]


def test_unknown_files_become_transactions(spark):
    df = _frame(spark, ["label", "row_key", "w1", "w2"], [("a", "k1", "n/a", "3.5"), ("b", "k2", "x", "4")])
    got = uploads.normalize_upload(df, AS_OF)["transactions"]
    assert rows(got.select("transaction_id", "amount", "user_id", "product_id", "store_id")) == [
        ("k1", 3.5, "U001", "P001", "S001"), ("k2", 4.0, "U001", "P001", "S001")]
    plain = uploads.best_effort(_frame(spark, ["v", "w"], [("a", "b"), ("c", "d")]), AS_OF)
    assert plain.select("transaction_id").distinct().count() == 2
    assert rows(plain.select("amount")) == [(1.0,), (1.0,)]


# -- access -------------------------------------------------------------------------------------

def test_roles(spark, sf):
    gold = registry.gold(spark, sf)
    assert access.secure_table(gold, "dim_users", "analyst").select("email").distinct().collect()[0][0] == "***MASKED***"
    assert access.secure_table(gold, "dim_users", "manager").filter("email like '%@%'").count() > 0
    hidden = access.secure_table(gold, "fact_transactions", "viewer")
    assert dict(hidden.dtypes)["amount"] == "string"
    with pytest.raises(PermissionError):
        access.secure_table(gold, "dim_users", "viewer")
    with pytest.raises(PermissionError):
        access.secure_table(gold, "dim_users", "nobody")


@pytest.mark.parametrize("sql", [
    "DROP TABLE x", "SELECT 1; DELETE FROM x", "insert into t values (1)", "SHOW TABLES", "", "WITHOUT x",
    "SELECT reflect('java.lang.System', 'exit', 1)", "WITH a AS (SELECT 1) MERGE INTO b USING a ON 1=1",
    "REPLACE TABLE x AS SELECT 1", "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t", "SELECT * FROM global_temp.t", "SELECT * FROM default.t",
    "SELECT * FROM parquet.`/tmp/t`", "SELECT * FROM range(3)", "SELECT * FROM other", "SELECT a FROM t WHERE a IN (SELECT b FROM other)",
    "SELECT (SELECT max(java_method('java.lang.Math', 'random')) FROM t) FROM t", "WITH c AS (SELECT * FROM other) SELECT * FROM c",
    "SELECT system.builtin.reflect('java.lang.System', 'exit')", "CACHE TABLE t", "SET x = 1", "EXPLAIN SELECT 1",
])
def test_unsafe_sql_is_refused(spark, sql):
    with pytest.raises(ValueError):
        access.validate(spark, sql, ["t"])


@pytest.mark.parametrize("sql", [
    "SELECT 1", "with a as (select 1) select * from a", "SELECT replace(a, 'x', 'y') FROM t;",
    "SELECT 'please drop; me' AS note", "SELECT updated, created_at FROM t", "SELECT `create`, t.update FROM T AS t",
    "SELECT a, count(*) FROM t LEFT JOIN (SELECT b FROM t) u ON a = b GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC LIMIT 3",
    "SELECT a, row_number() OVER (PARTITION BY b ORDER BY c) FROM t WHERE EXISTS (SELECT 1 FROM t x WHERE x.a = t.a)",
    "WITH c AS (SELECT * FROM t), d AS (SELECT * FROM c) SELECT * FROM d UNION SELECT * FROM c",
])
def test_reading_sql_is_accepted(spark, sql):
    access.validate(spark, sql, ["t"])


def test_owner_asks_about_all_tables(spark, sf):
    root = lakehouse.gold_root(registry.lake_root(spark, sf))
    sql = "SELECT store_id, sum(amount) AS revenue FROM fact_transactions JOIN dim_stores USING (store_key) GROUP BY 1 ORDER BY 2 DESC LIMIT 1"
    assert access.guarded_sql(spark, root, sql, access.OWNER).count() == 1
    with pytest.raises(ValueError):
        access.guarded_sql(spark, root, sql, "manager")


def test_guarded_sql_sees_only_its_role_and_its_cap(spark, sf):
    root = lakehouse.gold_root(registry.lake_root(spark, sf))
    run = lambda sql, role: access.guarded_sql(spark, root, sql, role)
    assert run("SELECT * FROM fact_transactions", "manager").count() == 100
    assert rows(run("SELECT DISTINCT email FROM dim_users", "analyst")) == [("***MASKED***",)]
    for sql in ("SELECT * FROM dim_users", f"SELECT * FROM parquet.`{root}/dim_users`"):
        with pytest.raises(Exception):
            run(sql, "viewer").collect()
    with pytest.raises(Exception):
        run("SELECT sum(amount) FROM fact_transactions", "viewer").collect()


@pytest.mark.parametrize("sql", [
    "SELECT identifier('reflect')('java.lang.Math', 'abs', -7) FROM t", "SELECT identifier('a') FROM t", "SELECT * FROM identifier('t')",
    "SELECT input_file_name() FROM t", "SELECT input_file_block_start() FROM t", "SELECT current_user()", "SELECT version()",
    "SELECT unheard_of(a) FROM t", "SELECT transform(array(a), x -> reflect('java.lang.Math', 'abs', x)) FROM t",
    "SELECT a FROM t WHERE a = (SELECT max(input_file_name()) FROM t)", "SELECT try_reflect('java.lang.Math', 'abs', a) FROM t",
    "SELECT count(*) FROM t GROUP BY identifier('input_file_name')()", "SELECT a FROM t ORDER BY java_method('java.lang.Math', 'random')",
])
def test_functions_that_do_not_compute_on_values_are_refused(spark, sql):
    with pytest.raises(ValueError):
        access.validate(spark, sql, ["t"])


@pytest.mark.parametrize("sql", [
    "SELECT region, sum(amount), avg(amount), count(DISTINCT user_key), median(amount), mode(region) FROM fact_transactions GROUP BY region",
    "SELECT date_trunc('month', timestamp), timestamp + interval 1 day, datediff(timestamp, timestamp - interval 2 days) FROM fact_transactions",
    "SELECT ceil(amount), round(amount, 1), lpad(region, 12), upper(region) LIKE 'R%', nvl(region, '-') FROM fact_transactions",
    "SELECT rank() OVER (PARTITION BY region ORDER BY amount DESC), lag(amount) OVER (ORDER BY timestamp) FROM fact_transactions",
    "SELECT * FROM fact_transactions WHERE product_key IN (SELECT product_key FROM dim_products WHERE contains(category, 'A'))",
    "SELECT x, size(g) FROM (SELECT array(product_key, 1) AS g FROM fact_transactions) LATERAL VIEW explode(g) e AS x",
    "SELECT store_key, category, grouping_id() FROM fact_transactions JOIN dim_products USING (product_key) GROUP BY ROLLUP (store_key, category)",
    "SELECT * FROM (SELECT region, amount, store_key % 2 AS s FROM fact_transactions) PIVOT (sum(amount) FOR s IN (0, 1))",
])
def test_ordinary_questions_are_answered(spark, sf, sql):
    root = lakehouse.gold_root(registry.lake_root(spark, sf))
    assert 0 < access.guarded_sql(spark, root, sql, access.OWNER, 5).count() <= 5


def test_the_resolved_plan_is_judged(spark, sf, monkeypatch):
    """What slips through the parsed plan is refused before it runs."""
    root = lakehouse.gold_root(registry.lake_root(spark, sf))
    monkeypatch.setattr(access, "validate", lambda own, sql, names: sql)
    for sql in ("SELECT identifier('reflect')('java.lang.Math', 'abs', -7)", "SELECT input_file_name() FROM fact_transactions",
                "SELECT 1 WHERE EXISTS (SELECT uuid() FROM dim_products)"):
        with pytest.raises(ValueError):
            access.guarded_sql(spark, root, sql, access.OWNER)
    with pytest.raises(ValueError, match="not a query"):
        access.guarded_sql(spark, root, "SELECT nothing FROM dim_products", access.OWNER)

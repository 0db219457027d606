"""The registered queries as DuckDB SQL over the given tables: what each result must equal."""

from __future__ import annotations

from tidemart.fixed_values import CONCEPT_COLUMNS
from tidemart.plans.registry import AS_OF, CATEGORY, CITY

MONEY = "CAST(sum(CAST({0} AS DECIMAL(34,9))) AS DOUBLE)"


def money(column: str) -> str:
    return MONEY.format(column)


def half_up(x: str, digits: int) -> str:
    scale = 10**digits
    return f"floor(({x}) * {scale}.0 + 0.5) / {scale}.0"


def unique(raw: str, keys: str, order: str) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn "
            f"FROM ({raw})) WHERE rn = 1")


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
STORE = "'STORE_' || lpad(CAST({0} AS VARCHAR), 6, '0')"

TXN_RAW = f"""SELECT CAST(l_orderkey AS VARCHAR) AS transaction_id, CAST(o_custkey AS VARCHAR) AS user_id,
  CAST(l_partkey AS VARCHAR) AS product_id, o_orderdate AS "timestamp", l_extendedprice AS amount,
  {STORE.format('l_suppkey')} AS store_id FROM {LINES}"""
TXN = unique(f"SELECT * FROM ({TXN_RAW}) WHERE amount > 0", "transaction_id, product_id",
             '"timestamp" NULLS LAST, user_id, amount, store_id')

PEOPLE = """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, c_name || '@example.com' AS email,
  n_name AS city, CAST(DATE '1995-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE) AS signup_date,
  r_name, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
USER_COLUMNS = "user_id, name, email, city, signup_date"
USERS = f"SELECT {USER_COLUMNS} FROM ({PEOPLE})"
DAY1 = f"SELECT {USER_COLUMNS} FROM ({PEOPLE}) WHERE c_mktsegment <> 'FURNITURE'"
DAY2 = f"""SELECT user_id, name, email, CASE WHEN c_mktsegment = 'MACHINERY' THEN r_name ELSE city END AS city,
  signup_date FROM ({PEOPLE}) WHERE c_mktsegment <> 'BUILDING'"""

PRODUCTS = """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS category,
  p_retailprice AS price FROM part WHERE p_retailprice > 0"""

STATUS = "CASE WHEN {0} = 0 THEN 'out_of_stock' WHEN {0} <= {1} THEN 'low_stock' ELSE 'in_stock' END"
INVENTORY = f"""SELECT *, {STATUS.format('stock_level', 'reorder_point')} AS stock_status FROM (
  SELECT CAST(l_partkey AS VARCHAR) AS product_id, {STORE.format('l_suppkey')} AS store_id,
    CAST(CAST(sum(l_quantity) AS INTEGER) % 500 AS INTEGER) AS stock_level,
    CAST(10 + l_partkey % 41 AS INTEGER) AS reorder_point, CAST(max(l_shipdate) AS DATE) AS last_restock_date
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""

SHIPMENTS_RAW = f"""SELECT shipment_id, transaction_id, origin_store_id, dest_store_id, shipped_date,
    CASE WHEN status = 'delivered' THEN CAST(shipped_date + days AS DATE) END AS delivered_date,
    CASE WHEN status = 'delivered' THEN days END AS delivery_days, carrier, tracking_number, status, shipping_cost
  FROM (SELECT CAST(l_orderkey - l_linenumber AS VARCHAR) AS shipment_id,
    CAST(l_orderkey AS VARCHAR) AS transaction_id, {STORE.format('l_suppkey')} AS origin_store_id,
    {STORE.format('l_partkey % (SELECT count(*) FROM supplier)')} AS dest_store_id,
    CAST(o_orderdate AS DATE) AS shipped_date,
    CAST(1 + abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 21 AS INTEGER) AS days,
    o_orderpriority AS carrier, 'TRK' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS tracking_number,
    CASE WHEN l_returnflag = 'R' THEN 'delayed' WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'shipped'
      ELSE 'delivered' END AS status,
    round(l_extendedprice * l_tax / 100, 2) + 0.0 AS shipping_cost FROM {LINES})"""
SHIPMENTS = unique(SHIPMENTS_RAW, "shipment_id", "transaction_id, origin_store_id, dest_store_id, shipped_date, "
                   "delivered_date NULLS LAST, delivery_days NULLS LAST, carrier, tracking_number, status, shipping_cost")

DAY_KEY = "CAST(strftime({0}, '%Y%m%d') AS INTEGER)"
CTES = {
    "t": TXN,
    "p": PRODUCTS,
    "inv": INVENTORY,
    "ship": SHIPMENTS,
    "du": f"""SELECT CAST(row_number() OVER (ORDER BY user_id) AS INTEGER) AS surrogate_key, user_id, name, email, city,
      signup_date AS effective_date, CAST(NULL AS DATE) AS end_date, TRUE AS is_current FROM ({USERS})""",
    "dp": """SELECT CAST(row_number() OVER (ORDER BY product_id) AS INTEGER) AS product_key, product_id,
      product_name, category, price FROM p""",
    "ds": """SELECT CAST(row_number() OVER (ORDER BY store_id) AS INTEGER) AS store_key, store_id,
      'Region_' || right(store_id, 3) AS region FROM (SELECT DISTINCT store_id FROM t)""",
    "dd": f"""SELECT {DAY_KEY.format('d')} AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS INTEGER) AS year,
      CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, dayname(d) AS day_of_week,
      dayofweek(d) IN (0, 6) AS is_weekend FROM (SELECT unnest(generate_series(
        (SELECT CAST(min("timestamp") AS DATE) FROM t), (SELECT CAST(max("timestamp") AS DATE) FROM t),
        INTERVAL 1 DAY)) AS d)""",
    "ft": f"""SELECT t.transaction_id, {DAY_KEY.format('t."timestamp"')} AS date_key, t."timestamp", t.amount,
      coalesce(du.surrogate_key, -1) AS user_key, coalesce(dp.product_key, -1) AS product_key,
      coalesce(ds.store_key, -1) AS store_key, coalesce(ds.region, 'Unknown') AS region
      FROM t LEFT JOIN du ON t.user_id = du.user_id AND du.is_current LEFT JOIN dp ON t.product_id = dp.product_id
      LEFT JOIN ds ON t.store_id = ds.store_id""",
    "fi": f"""SELECT coalesce(dp.product_key, -1) AS product_key, coalesce(ds.store_key, -1) AS store_key,
      coalesce(ds.region, 'Unknown') AS region, {DAY_KEY.format('last_restock_date')} AS date_key, stock_level,
      reorder_point, last_restock_date, stock_status, stock_level <= reorder_point AS needs_reorder,
      CAST(date_diff('day', last_restock_date, DATE '{AS_OF}') AS INTEGER) AS days_since_restock
      FROM inv LEFT JOIN dp ON inv.product_id = dp.product_id LEFT JOIN ds ON inv.store_id = ds.store_id""",
    "fs": f"""SELECT shipment_id, transaction_id, coalesce(o.store_key, -1) AS origin_store_key,
      coalesce(e.store_key, -1) AS dest_store_key, coalesce(o.region, 'Unknown') AS origin_region,
      coalesce(e.region, 'Unknown') AS dest_region, {DAY_KEY.format('shipped_date')} AS date_key, shipped_date,
      delivered_date, delivery_days, carrier, tracking_number, status, shipping_cost,
      CASE WHEN status = 'delivered' AND delivery_days <= 3 THEN 'fast'
        WHEN status = 'delivered' AND delivery_days <= 7 THEN 'normal' WHEN status = 'delivered' THEN 'slow'
        WHEN status = 'delayed' THEN 'delayed' ELSE 'pending' END AS delivery_category
      FROM ship LEFT JOIN ds o ON origin_store_id = o.store_id LEFT JOIN ds e ON dest_store_id = e.store_id""",
    "clv": f"""SELECT du.user_id, du.name AS customer_name, du.city AS customer_city, purchase_count, total_spend,
      total_spend / purchase_count AS avg_order_value,
      CAST(date_diff('day', f, l) AS INTEGER) AS customer_lifespan_days, total_spend AS estimated_clv
      FROM (SELECT user_key, count(DISTINCT transaction_id) AS purchase_count, {money('amount')} AS total_spend,
        CAST(min("timestamp") AS DATE) AS f, CAST(max("timestamp") AS DATE) AS l FROM ft WHERE user_key <> -1 GROUP BY 1)
      JOIN du ON user_key = surrogate_key WHERE is_current""",
    "pairs": """SELECT a.product_key AS product_a, b.product_key AS product_b, count(*) AS times_bought_together
      FROM ft a JOIN ft b ON a.transaction_id = b.transaction_id AND a.product_key < b.product_key
      WHERE a.product_key <> -1 AND b.product_key <> -1 GROUP BY 1, 2 HAVING count(*) >= 2""",
    "basket": """SELECT x.product_name AS product_a_name, y.product_name AS product_b_name, times_bought_together,
      product_a, product_b FROM pairs LEFT JOIN dp x ON product_a = x.product_key
      LEFT JOIN dp y ON product_b = y.product_key""",
    "city": f"""SELECT city, count(DISTINCT transaction_id) AS order_count, {money('amount')} AS total_revenue,
      {money('amount')} / count(amount) AS avg_order_value, count(DISTINCT user_key) AS unique_customers
      FROM ft JOIN du ON user_key = surrogate_key WHERE is_current AND user_key <> -1 GROUP BY city""",
    "top": f"""SELECT product_name, category, price, count(*) AS units_sold, {money('amount')} AS total_revenue,
      {money('amount')} / count(amount) AS avg_sale_price FROM ft JOIN dp USING (product_key)
      WHERE product_key <> -1 GROUP BY product_name, category, price""",
    "turn": """SELECT dp.product_key, product_name, category, coalesce(units_sold, 0) AS units_sold,
      coalesce(avg_stock, 0.0) AS avg_stock,
      coalesce(units_sold / nullif(avg_stock, 0.0), 0.0) AS turnover_ratio, reorder_instances
      FROM dp LEFT JOIN (SELECT product_key, count(*) AS units_sold FROM ft WHERE product_key <> -1 GROUP BY 1) s
        ON dp.product_key = s.product_key
      LEFT JOIN (SELECT product_key, CAST(sum(stock_level) AS DOUBLE) / count(stock_level) AS avg_stock,
          CAST(sum(CASE WHEN needs_reorder THEN 1 ELSE 0 END) AS BIGINT) AS reorder_instances
        FROM fi WHERE product_key <> -1 GROUP BY 1) i ON dp.product_key = i.product_key""",
    "deliv": f"""SELECT carrier, region AS origin_region,
      CAST(sum(delivery_days) AS DOUBLE) / count(delivery_days) AS avg_delivery_days,
      min(delivery_days) AS min_delivery_days, max(delivery_days) AS max_delivery_days, count(*) AS shipment_count,
      CAST(sum(CASE WHEN delivery_category = 'fast' THEN 1 ELSE 0 END) AS BIGINT) AS fast_deliveries,
      CAST(sum(CASE WHEN delivery_category = 'delayed' THEN 1 ELSE 0 END) AS BIGINT) AS delayed_deliveries,
      {money('shipping_cost')} / count(shipping_cost) AS avg_shipping_cost
      FROM fs JOIN ds ON origin_store_key = store_key WHERE status = 'delivered' AND origin_store_key <> -1
      GROUP BY carrier, region""",
    "season": f"""SELECT year, quarter, month, category, count(*) AS units_sold, {money('amount')} AS revenue,
      {money('amount')} / count(amount) AS avg_transaction_value FROM ft JOIN dd USING (date_key)
      JOIN dp USING (product_key) WHERE product_key <> -1 GROUP BY year, quarter, month, category""",
    "seg": f"""SELECT customer_type, count(DISTINCT user_key) AS customer_count,
      count(DISTINCT transaction_id) AS order_count, {money('amount')} AS total_revenue,
      {money('amount')} / count(amount) AS avg_order_value FROM (
        SELECT ft.*, CASE WHEN date_diff('day', f, CAST("timestamp" AS DATE)) <= 7 THEN 'New' ELSE 'Returning' END
          AS customer_type FROM ft JOIN (SELECT user_key, CAST(min("timestamp") AS DATE) AS f FROM ft
          WHERE user_key <> -1 GROUP BY 1) x USING (user_key)) GROUP BY customer_type""",
}
NEEDS = {
    "dp": ["p"], "ds": ["t"], "dd": ["t"], "ft": ["t", "du", "dp", "ds"], "fi": ["inv", "dp", "ds"],
    "fs": ["ship", "ds"], "clv": ["ft", "du"], "pairs": ["ft"], "basket": ["pairs", "dp"], "city": ["ft", "du"],
    "top": ["ft", "dp"], "turn": ["dp", "ft", "fi"], "deliv": ["fs", "ds"], "season": ["ft", "dd", "dp"],
    "seg": ["ft"],
}


def over(body: str, *names: str) -> str:
    """``body`` with the common table expressions it uses, and those they use, before it."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in wanted) + "\n" + body


def all_of(name: str) -> str:
    return over(f"SELECT * FROM {name}", name)


# -- raw files and uploads ------------------------------------------------------------------------
NO = "CAST(NULL AS VARCHAR)"
FOREIGN = f"""SELECT CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_partkey AS VARCHAR) AS stockcode,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity,
  strftime(o_orderdate, '%-m/%-d/%Y %-H:%M') AS invoicedate, CAST(l_extendedprice AS VARCHAR) AS price,
  CAST(o_custkey AS VARCHAR) AS customer_id, 'Country ' || l_suppkey AS country,
  l_extendedprice * CAST(l_quantity AS INTEGER) AS value, o_orderdate FROM {LINES}"""
BRONZE = f"""SELECT transaction_id, user_id, product_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
    CAST(amount AS VARCHAR) AS amount, store_id, {NO} AS invoice, {NO} AS stockcode, {NO} AS quantity,
    {NO} AS invoicedate, {NO} AS price, {NO} AS customer_id, {NO} AS country FROM ({TXN_RAW})
  UNION ALL SELECT {NO}, {NO}, {NO}, {NO}, {NO}, {NO}, invoice, stockcode, quantity, invoicedate, price, customer_id,
    country FROM ({FOREIGN})"""

WIDE = f"""SELECT x.*, u.name, u.email, u.city, u.signup_date, p.product_name, p.category
  FROM ({TXN_RAW}) x JOIN ({USERS}) u USING (user_id) JOIN ({PRODUCTS}) p USING (product_id)"""

# -- history --------------------------------------------------------------------------------------
HISTORY = f"""WITH d1 AS ({DAY1}), d2 AS ({DAY2}),
  e AS (SELECT CAST(row_number() OVER (ORDER BY user_id) AS INTEGER) AS surrogate_key, *, signup_date AS effective_date
        FROM d1),
  moved AS (SELECT e.* FROM e JOIN d2 i USING (user_id) WHERE e.city <> i.city),
  fresh AS (SELECT i.*, 1 AS g, DATE '{AS_OF}' AS effective_date FROM d2 i WHERE user_id IN (SELECT user_id FROM moved)
    UNION ALL SELECT i.*, 2, signup_date FROM d2 i WHERE user_id NOT IN (SELECT user_id FROM e))
  SELECT surrogate_key, user_id, name, email, city, effective_date, CAST(NULL AS DATE) AS end_date, TRUE AS is_current
    FROM e WHERE user_id NOT IN (SELECT user_id FROM moved) {{keep}}
  UNION ALL SELECT surrogate_key, user_id, name, email, city, effective_date, DATE '{AS_OF}', FALSE FROM moved
  UNION ALL SELECT CAST((SELECT max(surrogate_key) FROM e) + row_number() OVER (ORDER BY g, user_id) AS INTEGER),
    user_id, name, email, city, effective_date, NULL, TRUE FROM fresh"""

# -- quality --------------------------------------------------------------------------------------
GOLD = {"dim_users": "du", "dim_products": "dp", "dim_stores": "ds", "dim_dates": "dd", "fact_transactions": "ft",
        "fact_inventory": "fi", "fact_shipments": "fs"}
LAYOUT = {
    "dim_users": "surrogate_key int, user_id string, name string, email string, city string, effective_date date, "
                 "end_date date, is_current boolean",
    "dim_products": "product_key int, product_id string, product_name string, category string, price double",
    "dim_stores": "store_key int, store_id string, region string",
    "dim_dates": "date_key int, full_date date, year int, quarter int, month int, day_of_week string, "
                 "is_weekend boolean",
    "fact_transactions": "transaction_id string, date_key int, timestamp timestamp, amount double, user_key int, "
                         "product_key int, store_key int, region string, month_key int",
    "fact_inventory": "product_key int, store_key int, region string, date_key int, stock_level int, "
                      "reorder_point int, last_restock_date date, stock_status string, needs_reorder boolean, "
                      "days_since_restock int, month_key int",
    "fact_shipments": "shipment_id string, transaction_id string, origin_store_key int, dest_store_key int, "
                      "origin_region string, dest_region string, date_key int, shipped_date date, delivered_date date, "
                      "delivery_days int, carrier string, tracking_number string, status string, "
                      "shipping_cost double, delivery_category string, month_key int",
}
SIZES = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {c}" for n, c in GOLD.items())
FIELDS = ", ".join(f"('{n}', {i}, '{f.split()[0]}', '{f.split()[1]}')"
                   for n, fields in LAYOUT.items() for i, f in enumerate(fields.split(", ")))
PROFILE_KINDS = {"shipment_id": "id", "transaction_id": "id", "origin_store_id": "id", "dest_store_id": "id",
                 "shipped_date": "date", "delivered_date": "date", "delivery_days": "int", "carrier": "string",
                 "tracking_number": "id", "status": "string", "shipping_cost": "price"}
PROFILE = " UNION ALL ".join(
    f"""SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS "column", '{k}' AS kind, count(*) - count({c}) AS null_count,
      CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_rate, count(DISTINCT {c}) AS unique_count,
      (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM ship
        WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS samples FROM ship"""
    for i, (c, k) in enumerate(PROFILE_KINDS.items()))
PCT = "sum(CASE WHEN {0} THEN 1 ELSE 0 END) * 100.0 / count(*)"


def pct(condition: str) -> str:
    return f"CAST({PCT.format(condition)} AS DOUBLE)"


def exact_pct(condition: str) -> str:
    return f"CAST(CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(*) AS DOUBLE)"


# -- vectors --------------------------------------------------------------------------------------
CENTROIDS = """c AS (SELECT label, list(m ORDER BY i) AS v FROM (
    SELECT label, i, floor(avg(x) * 1000000.0 + 0.5) / 1000000.0 AS m FROM (
      SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    GROUP BY label, i) GROUP BY label),
  e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
COSINE = "list_cosine_similarity(c.v, e.v)"
L2 = "-(list_distance(c.v, e.v) * list_distance(c.v, e.v))"
CONCEPTS = ", ".join(f"({i}, '{n}', '{column}')" for i, (n, column) in enumerate(CONCEPT_COLUMNS.items()))

# -- events ---------------------------------------------------------------------------------------
EVENTS = """SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  'S' || lpad(CAST(user_id % 50 AS VARCHAR), 3, '0') AS store FROM events"""
EVENT_KIND = """CASE WHEN event_type = 'purchase' THEN 'order_created' WHEN event_type = 'signup' THEN 'user_update'
  WHEN event_type = 'view' THEN 'product_update' WHEN event_type = 'click' AND k < 50 THEN 'inventory_update'
  WHEN event_type = 'click' THEN 'shipment_update' WHEN k < 50 THEN 'malformed' ELSE 'price_alert' END"""
KINDS = f"SELECT {EVENT_KIND} AS event_type, count(*) AS events FROM ({EVENTS}) GROUP BY 1"
ORDER_LINES = f"""SELECT 'T' || event_id AS transaction_id, CAST(user_id AS VARCHAR) AS user_id,
  'P' || (k + i) AS product_id, date_trunc('second', ts) AS ts, value + i AS amount, store AS store_id
  FROM (SELECT *, unnest(range(1, CAST(k % 6 AS BIGINT) + 1)) AS i FROM ({EVENTS}) WHERE event_type = 'purchase')"""

RAW_COLUMNS = {  # the given tables' columns, and the kind that follows from a name
    "region": {"r_regionkey": "id", "r_name": "name"},
    "nation": {"n_nationkey": "id", "n_name": "name", "n_regionkey": "id"},
    "customer": {"c_custkey": "id", "c_name": "name", "c_nationkey": "id", "c_acctbal": None, "c_mktsegment": None},
    "supplier": {"s_suppkey": "id", "s_name": "name", "s_nationkey": "id", "s_acctbal": None},
    "part": {"p_partkey": "id", "p_name": "name", "p_brand": None, "p_type": "category", "p_size": None,
        "p_retailprice": "price"},
    "orders": {"o_orderkey": "id", "o_custkey": "id", "o_orderstatus": None, "o_totalprice": "price", "o_orderdate":
        "date", "o_orderpriority": None},
    "lineitem": {"l_orderkey": "id", "l_partkey": "id", "l_suppkey": "id", "l_linenumber": "id", "l_quantity":
        "quantity", "l_extendedprice": "price", "l_discount": None, "l_tax": None, "l_returnflag": None,
        "l_linestatus": None, "l_shipdate": "date"},
    "events": {"event_id": "id", "ts": None, "user_id": "id", "event_type": "category", "value": None, "props": None},
}
VALUE_KIND = """CASE WHEN count(v) = 0 THEN 'string' WHEN count(*) FILTER (v IS NOT NULL AND NOT regexp_full_match(v, '[+-]?[0-9]+')) = 0 THEN 'int'
  WHEN count(*) FILTER (v IS NOT NULL AND NOT regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) = 0 THEN 'float'
  WHEN count(*) FILTER (v IS NOT NULL AND TRY_CAST(v AS TIMESTAMP) IS NULL) = 0 THEN 'datetime' ELSE 'string' END"""
RAW_KINDS = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", {f"'{kind}'" if kind else VALUE_KIND} AS kind,
      count(*) - count(v) AS null_count, count(DISTINCT v) AS unique_count FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t})"""
    for t, columns in RAW_COLUMNS.items() for c, kind in columns.items())


def _first_rows(table: str, cte: str, key: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", {i} AS ordinal, '{c}' AS "column", (SELECT count(*) FROM {cte}) AS row_count,
          (SELECT string_agg(coalesce(CAST({c} AS VARCHAR), '-'), '|' ORDER BY {key}) FROM {cte} WHERE {key} <= 3) AS samples"""
        for i, c in enumerate(columns))


#: Table, what a scan and an upload take it for by the words in its headers, and the required columns it lacks.
UPLOADED = [
    ("region", "users", "users", "user_id"), ("nation", "users", "users", "user_id"), ("customer", "users", "users", "user_id"),
    ("supplier", "users", "users", "user_id"), ("part", "transactions", "combined", ""),
    ("orders", "transactions", "transactions", "transaction_id,amount"), ("lineitem", "transactions", "transactions", "transaction_id,amount"),
    ("events", "users", "users", ""),
]

ORACLE: dict[str, str] = {
    "bronze_union_by_name": BRONZE,
    "bronze_file_profile": f"""SELECT f AS source_file, n AS row_count, CAST(c AS INTEGER) AS column_count, cols AS columns
        FROM (SELECT 'transactions_a.csv' AS f, 6 AS c, 'transaction_id,user_id,product_id,timestamp,amount,store_id' AS cols
        UNION ALL SELECT 'transactions_b.csv', 7, 'invoice,stockcode,quantity,invoicedate,price,customer_id,country')
        JOIN (SELECT count(*) AS n FROM ({TXN_RAW})) ON TRUE""",
    "users_latest_by_file": f"""SELECT * FROM ({DAY2}) UNION ALL
        SELECT * FROM ({DAY1}) WHERE user_id NOT IN (SELECT user_id FROM ({DAY2}))""",
    "tsv_scan": f"SELECT user_id, name, email, city, CAST(signup_date AS VARCHAR) AS signup_date FROM ({USERS})",
    "json_scan": PRODUCTS,
    "parquet_scan": PRODUCTS,
    "latin1_scan": f"SELECT product_id, product_name || ' café' AS product_name FROM ({PRODUCTS})",
    "dataset_ingest": f"""SELECT 'dataset' AS data_source, store_id, count(*) AS rows, count(*) AS with_order,
          count(*) AS with_time FROM ({TXN_RAW}) GROUP BY store_id
        UNION ALL SELECT 'dataset', country, count(*), 0, count(*) FROM ({FOREIGN}) GROUP BY country""",
    "scan_partition_pruned": over("""SELECT CAST(date_key // 100 AS INTEGER) AS month_key, count(*) AS lines FROM ft
        WHERE date_key // 100 BETWEEN 199601 AND 199606 GROUP BY 1""", "ft"),
    "fact_inventory_roundtrip": all_of("fi"),
    "table_publish": PRODUCTS.replace("p_retailprice AS price", "p_retailprice + 1 + 1 AS price"),
    "layer_tables": over(f'SELECT "table", n AS row_count FROM ({SIZES})', *GOLD.values()),
    "layer_profile": over(f"""SELECT v."table", CAST(ordinal AS INTEGER) AS ordinal, "column", "type", n AS row_count
        FROM (VALUES {FIELDS}) v("table", ordinal, "column", "type") JOIN ({SIZES}) s ON v."table" = s."table" """,
                          *GOLD.values()),
    "synonym_coalesce": f"""SELECT transaction_id, user_id, product_id, "timestamp", store_id FROM ({TXN_RAW})
        UNION ALL SELECT invoice, customer_id, stockcode, o_orderdate, country FROM ({FOREIGN})""",
    "layer_samples": over(" UNION ALL ".join([
        _first_rows("dim_users", "du", "surrogate_key", ["surrogate_key", "user_id", "name", "email", "city", "effective_date", "end_date", "is_current"]),
        _first_rows("dim_products", "dp", "product_key", ["product_key", "product_id", "product_name", "category", "price"]),
        _first_rows("dim_stores", "ds", "store_key", ["store_key", "store_id", "region"])]), "du", "dp", "ds"),
    "table_refresh": f"""SELECT product_id, product_name, category, CASE WHEN CAST(product_id AS BIGINT) % 3 = 0 THEN price * 2 ELSE price END AS price,
          CAST(CAST(product_id AS BIGINT) % 3 = 0 AS INTEGER) AS version FROM ({PRODUCTS})
        UNION ALL SELECT 'N' || product_id, product_name, category, price, 0 FROM ({PRODUCTS})""",
    "generated_id_lines": """SELECT md5(d || '#' || row_number() OVER (PARTITION BY d)) AS transaction_id, product_id, source_file FROM (
        SELECT *, md5('{"product_id":"' || product_id || '","quantity":"' || quantity || '","source_file":"' || source_file || '"}') AS d
        FROM (SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity FROM lineitem),
          (VALUES ('a.csv'), ('b.csv')) f(source_file))""",
    "upload_entities": " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{scanned}' AS scanned, '{uploaded}' AS uploaded, '{missing}' AS missing, count(*) AS rows FROM {t}"""
        for t, scanned, uploaded, missing in UPLOADED),
    "generated_ids": "SELECT 2 * count(*) AS rows, 2 * count(*) AS ids FROM lineitem",
    "odd_amounts": f"""SELECT l_returnflag AS store_id, count(*) AS lines, {money('a')} AS revenue FROM (
        SELECT l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice * 1e11 WHEN 1 THEN l_extendedprice / 1e5
          ELSE l_extendedprice END AS a FROM lineitem) GROUP BY 1""",
    "amount_derivation": f"""SELECT transaction_id, product_id, amount FROM ({TXN_RAW})
        UNION ALL SELECT invoice, stockcode, value FROM ({FOREIGN})""",
    "column_defaults": f"""SELECT CAST(l_orderkey AS VARCHAR) AS transaction_id, 'U001' AS user_id,
        'UNKNOWN' AS product_id, TIMESTAMP '{AS_OF}' AS "timestamp", l_extendedprice AS amount, 'S001' AS store_id
        FROM lineitem""",
    "normalized_upload": f"""SELECT invoice AS transaction_id, stockcode AS product_id, quantity,
        invoicedate AS "timestamp", price, customer_id AS user_id, country AS store_id,
        CAST(value AS VARCHAR) AS amount FROM ({FOREIGN})""",
    "rule_mapped_upload": f"""SELECT invoice AS "Invoice", stockcode AS "StockCode", quantity,
        invoicedate AS "timestamp", price AS amount, customer_id AS user_id, country AS store_id FROM ({FOREIGN})""",
    "recommended_upload": f"""SELECT invoice AS transaction_id, stockcode AS product_id, quantity,
        invoicedate AS "timestamp", price AS amount, customer_id AS user_id, country AS store_id FROM ({FOREIGN})""",
    "rename_with_provenance": f"""SELECT user_id, name AS user_name, email, city AS store_id,
          CAST(signup_date AS VARCHAR) AS signup_date, 'dataset' AS data_source,
          'users_20240101.csv' AS source_file FROM ({DAY1})
        UNION ALL SELECT user_id, name, email, city, CAST(signup_date AS VARCHAR), 'dataset', 'users_20240102.csv'
          FROM ({DAY2})""",
    "upload_defaults": f"""SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name,
        'unknown@example.com' AS email, 'Unknown' AS city, '{AS_OF}' AS signup_date FROM customer""",
    "split_combined_users": f"SELECT DISTINCT user_id, name AS full_name, email, city, signup_date FROM ({WIDE})",
    "split_combined_products": f"SELECT DISTINCT product_id, product_name, category FROM ({WIDE})",
    "split_combined_transactions": TXN_RAW,
    "best_effort_upload": f"""SELECT CAST(s_suppkey AS VARCHAR) AS transaction_id, s_acctbal AS amount,
        'U001' AS user_id, 'P001' AS product_id, '{AS_OF} 00:00:00' AS "timestamp", 'S001' AS store_id FROM supplier""",
    "stock_status": f"SELECT stock_status, count(*) AS rows FROM ({INVENTORY}) GROUP BY 1",
    "silver_transactions": TXN,
    "silver_users": USERS,
    "silver_products": PRODUCTS,
    "silver_inventory": INVENTORY,
    "silver_shipments": SHIPMENTS,
    "dense_key": """SELECT row_number() OVER (ORDER BY l_orderkey) AS order_key, l_orderkey
        FROM (SELECT DISTINCT l_orderkey FROM lineitem)""",
    "dim_products": all_of("dp"),
    "dim_stores": all_of("ds"),
    "dim_dates": all_of("dd"),
    "scd2_initial": f"""SELECT CAST(row_number() OVER (ORDER BY user_id) AS INTEGER) AS surrogate_key, user_id, name,
        email, city, signup_date AS effective_date, CAST(NULL AS DATE) AS end_date, TRUE AS is_current FROM ({DAY1})""",
    "scd2_merge": HISTORY.format(keep=""),
    "scd2_merge_drop_missing": HISTORY.format(keep="AND user_id IN (SELECT user_id FROM d2)"),
    "scd2_replay": HISTORY.format(keep=""),
    "fact_transactions": all_of("ft"),
    "fact_inventory": all_of("fi"),
    "fact_shipments": all_of("fs"),
    "medallion_status": over(f"""SELECT layer, "table", rows, 'built' AS status FROM (
        SELECT 'silver' AS layer, 'transactions' AS "table", count(*) AS rows FROM t
        UNION ALL SELECT 'silver', 'users', count(*) FROM ({USERS})
        UNION ALL SELECT 'silver', 'products', count(*) FROM p UNION ALL SELECT 'silver', 'inventory', count(*) FROM inv
        UNION ALL SELECT 'silver', 'shipments', count(*) FROM ship
        UNION ALL SELECT 'gold', "table", n FROM ({SIZES}))""", *GOLD.values(), "p", "inv", "ship"),
    "clv": all_of("clv"),
    "market_basket": all_of("basket"),
    "summary_kpis": over(f"""SELECT {money('amount')} AS total_revenue,
        count(DISTINCT user_key) FILTER (WHERE user_key <> -1) AS active_users,
        count(DISTINCT transaction_id) AS total_orders FROM ft""", "ft"),
    "revenue_daily": over(f"""SELECT full_date, day_of_week, {money('amount')} AS revenue,
        count(DISTINCT transaction_id) AS order_count FROM ft JOIN dd USING (date_key) GROUP BY 1, 2""", "ft", "dd"),
    "revenue_monthly": over(f"""SELECT year, month, {money('amount')} AS revenue,
        count(DISTINCT transaction_id) AS order_count FROM ft JOIN dd USING (date_key) GROUP BY 1, 2""", "ft", "dd"),
    "revenue_yearly": over(f"""SELECT year, {money('amount')} AS revenue,
        count(DISTINCT transaction_id) AS order_count FROM ft JOIN dd USING (date_key) GROUP BY 1""", "ft", "dd"),
    "city_sales": all_of("city"),
    "top_products": over("""SELECT * FROM top ORDER BY total_revenue DESC, product_name, category, price LIMIT 10""",
                         "top"),
    "inventory_turnover": over("SELECT * EXCLUDE (product_key) FROM turn", "turn"),
    "delivery_metrics": all_of("deliv"),
    "seasonal_trends": all_of("season"),
    "customer_segmentation": all_of("seg"),
    "dq_scores": over(f"""SELECT {half_up('(count(transaction_id) + count(amount) + count(user_key)) * 100.0 / (count(*) * 3)', 1)}
          AS completeness, {half_up(pct('amount > 0'), 1)} AS accuracy,
        {half_up(pct('user_key <> -1 AND product_key <> -1'), 1)} AS consistency,
        {half_up(pct("date_diff('day', CAST(\"timestamp\" AS DATE), DATE '2001-08-01') <= 365"), 1)} AS timeliness
        FROM ft""", "ft"),
    "dq_trend": over(f"""SELECT strftime("timestamp", '%Y-%m') AS month, {exact_pct('amount IS NOT NULL')} AS completeness,
        {exact_pct('amount > 0')} AS accuracy, {exact_pct('user_key <> -1')} AS consistency FROM ft GROUP BY 1""", "ft"),
    "dq_checks": over(f"""SELECT "table" AS "check", CASE WHEN n > 0 THEN 'pass' ELSE 'warning' END AS status,
        n AS records, CAST(0 AS INTEGER) AS issues FROM ({SIZES})""", *GOLD.values()),
    "dq_rejects": over("""SELECT 'transactions' AS entity, reason, count(*) AS rows FROM (SELECT CASE
          WHEN l_returnflag = 'A' THEN 'transaction_id is null' WHEN l_discount = 0 OR l_extendedprice * (l_tax - 0.01) <= 0
          THEN 'amount is not positive' END AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY reason
        UNION ALL SELECT 'inventory', 'stock is negative', count(*) FROM inv WHERE stock_level - 20 < 0""", "inv"),
    "dq_rejects_more": """SELECT 'users' AS entity, 'user_id is null' AS reason, count(*) AS rows FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT 'products', reason, count(*) FROM (SELECT CASE WHEN p_size = 7 THEN 'product_id is null'
          WHEN p_size % 5 = 0 THEN 'price is not positive' WHEN p_size % 5 = 1 THEN 'price is not finite' END AS reason FROM part)
          WHERE reason IS NOT NULL GROUP BY reason
        UNION ALL SELECT 'shipments', reason, count(*) FROM (SELECT CASE WHEN l_linenumber = 2 THEN 'shipment_id is null'
          WHEN l_extendedprice * (l_tax - 0.02) < 0 THEN 'cost is negative' END AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY reason""",
    "column_profile": over(PROFILE, "ship"),
    "raw_column_kinds": RAW_KINDS,
    "finite_values": """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN l_extendedprice END AS amount FROM lineitem""",
    "missing_sources": over("""SELECT 'top_products' AS report, 0 AS row_count UNION ALL SELECT 'seasonal_trends', 0
        UNION ALL SELECT 'inventory_turnover', 0 UNION ALL SELECT 'clv', count(*) FROM clv
        UNION ALL SELECT 'city_sales', count(*) FROM city UNION ALL SELECT 'delivery_metrics', count(*) FROM deliv""", "clv", "city", "deliv"),
    "clv_headline": over("""SELECT CAST(sum(CAST(estimated_clv AS DECIMAL(34,9))) AS DOUBLE) / count(estimated_clv) AS avg_clv,
        max(estimated_clv) AS max_clv, count(*) AS customers FROM clv""", "clv"),
    "top_customers": over("SELECT * FROM clv ORDER BY estimated_clv DESC, user_id LIMIT 10", "clv"),
    "top_pairs": over("SELECT * FROM basket ORDER BY times_bought_together DESC, product_a, product_b LIMIT 15", "basket"),
    "segment_share": over(f"""SELECT CAST(total AS BIGINT) AS total_customers, CAST(new AS INTEGER) AS new_pct,
        CAST(100 - new AS INTEGER) AS returning_pct FROM (SELECT sum(customer_count) AS total,
          {half_up("CAST(sum(order_count) FILTER (WHERE customer_type = 'New') AS DOUBLE) / sum(order_count) * 100", 0)} AS new
        FROM seg)""", "seg"),
    "delivery_headline": over(f"""SELECT n AS total_shipments, {half_up('days / timed', 1)} AS avg_delivery_days,
        fast AS fast_deliveries, delayed AS delayed_deliveries,
        {half_up('(n - delayed) * 100.0 / n', 1)} AS on_time_pct FROM (SELECT count(*) AS n,
          CAST(sum(delivery_days) FILTER (WHERE status = 'delivered') AS DOUBLE) AS days,
          count(delivery_days) FILTER (WHERE status = 'delivered') AS timed,
          count(*) FILTER (WHERE delivery_category = 'fast') AS fast,
          count(*) FILTER (WHERE delivery_category = 'delayed') AS delayed FROM fs)""", "fs"),
    "region_bottlenecks": over(f"""SELECT origin_region AS region,
        {half_up("count(*) FILTER (WHERE delivery_category = 'delayed') * 100.0 / count(*)", 1)} AS delayed_pct
        FROM fs GROUP BY 1""", "fs"),
    "carrier_performance": over(f"""SELECT carrier,
        {half_up('sum(avg_delivery_days * shipment_count) / sum(shipment_count)', 1)} AS avg_days
        FROM deliv GROUP BY 1""", "deliv"),
    "inventory_headline": over(f"""SELECT
        {half_up('CAST(sum(CAST(turnover_ratio AS DECIMAL(18,6))) AS DOUBLE) / count(*)', 2)} AS avg_turnover,
        count(*) FILTER (WHERE avg_stock < 30) AS low_stock, count(*) FILTER (WHERE turnover_ratio > 0.8) AS high_turnover,
        count(*) FILTER (WHERE reorder_instances > 0) AS needs_reorder FROM turn""", "turn"),
    "stock_by_category": over(f"""SELECT category,
        CAST({half_up('CAST(sum(CAST(avg_stock AS DECIMAL(18,6))) AS DOUBLE)', 0)} AS BIGINT) AS in_stock
        FROM turn GROUP BY 1""", "turn"),
    "seasonal_pivot": over("SELECT month, " + ", ".join(
        f"CAST(sum(units_sold) FILTER (WHERE category = '{c}') AS BIGINT) AS \"{c}\""
        for c in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]) + " FROM season GROUP BY month", "season"),
    "seasonal_units": over("""SELECT month, '{' || string_agg('"' || category || '":' || CAST(units AS BIGINT), ',' ORDER BY category) || '}' AS units
        FROM (SELECT month, category, sum(units_sold) AS units FROM season WHERE category IS NOT NULL GROUP BY ALL) GROUP BY month""", "season"),
    "reorder_alerts": over("""SELECT * EXCLUDE (product_key) FROM (SELECT * FROM turn WHERE avg_stock < 30
        ORDER BY avg_stock, product_key LIMIT 6)""", "turn"),
    "ask_total_revenue": over(f"SELECT {money('amount')} AS total_revenue FROM ft", "ft"),
    "ask_order_count": over("SELECT count(DISTINCT transaction_id) AS orders FROM ft", "ft"),
    "ask_average_order_value": over(
        f"SELECT {money('amount')} / count(DISTINCT transaction_id) AS avg_order_value FROM ft", "ft"),
    "ask_city_revenue": over(f"""SELECT {money('amount')} AS total_revenue FROM ft JOIN du ON user_key = surrogate_key
        WHERE is_current AND city = '{CITY}'""", "ft", "du"),
    "ask_category_product_count": over(f"SELECT count(*) AS products FROM dp WHERE category = '{CATEGORY}'", "dp"),
    "ask_top_customers": over("""SELECT user_id, customer_name, total_spend FROM clv
        ORDER BY total_spend DESC, user_id LIMIT 5""", "clv"),
    "ask_top_products": over("""SELECT product_name, category, price, total_revenue FROM top
        ORDER BY total_revenue DESC, product_name, category, price LIMIT 5""", "top"),
    "ask_category_revenue": over(f"""SELECT category, {money('amount')} AS total_revenue FROM ft
        JOIN dp USING (product_key) GROUP BY 1""", "ft", "dp"),
    "ask_best_store": over(f"""SELECT store_id, {money('amount')} AS total_revenue FROM ft JOIN ds USING (store_key)
        GROUP BY store_id ORDER BY 2 DESC, 1 LIMIT 1""", "ft", "ds"),
    "revenue_prev_month": over(f"""SELECT {money('amount')} AS total_revenue FROM ft
        WHERE "timestamp" >= TIMESTAMP '2001-07-01' AND "timestamp" < TIMESTAMP '2001-08-01'""", "ft"),
    "city_top_customers": over(f"""SELECT name, total_spend, orders FROM (SELECT user_id, name,
        {money('amount')} AS total_spend, count(*) AS orders FROM ft JOIN du ON user_key = surrogate_key
        WHERE is_current AND city = '{CITY}' GROUP BY user_id, name ORDER BY total_spend DESC, user_id LIMIT 10)""",
                               "ft", "du"),
    "role_access": over("""SELECT 'analyst' AS role, 'fact_transactions' AS "table", '' AS masked, count(*) AS rows, 0 AS masked_rows FROM ft
        UNION ALL SELECT 'analyst', 'dim_users', 'email', count(*), count(*) FROM du
        UNION ALL SELECT 'analyst', 'dim_products', '', count(*), 0 FROM dp
        UNION ALL SELECT 'manager', 'fact_transactions', '', count(*), 0 FROM ft
        UNION ALL SELECT 'manager', 'dim_users', '', count(*), 0 FROM du
        UNION ALL SELECT 'manager', 'dim_products', '', count(*), 0 FROM dp
        UNION ALL SELECT 'viewer', 'fact_transactions', 'amount', count(*), count(*) FROM ft""", "ft", "du", "dp"),
    "masked_view": over("SELECT * REPLACE ('***MASKED***' AS email) FROM du", "du"),
    "guarded_sql": over(f"""SELECT replace(region, 'Region_', 'R') AS region, orders, revenue FROM (
        SELECT region, count(DISTINCT transaction_id) AS orders, {money('amount')} AS revenue FROM ft
        WHERE user_key <> -1 GROUP BY region) ORDER BY revenue DESC, region LIMIT 100""", "ft"),
    "cosine_topk": f"""WITH {CENTROIDS} SELECT query_id, id, {half_up('score', 6)} AS score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
          SELECT CAST(c.label AS BIGINT) AS query_id, vec_id AS id, {COSINE} AS score FROM c JOIN e ON TRUE))
        WHERE rank <= 3""",
    "l2_topk_filtered": f"""WITH {CENTROIDS} SELECT query_id, id, -({half_up('score', 6)}) AS distance, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
          SELECT CAST(c.label AS BIGINT) AS query_id, vec_id AS id, {L2} AS score FROM c JOIN e ON c.label = e.label))
        WHERE rank <= 3""",
    "concept_match": f"""WITH {CENTROIDS}, k AS (SELECT * FROM (VALUES {CONCEPTS}) v(label, concept, column_name))
        SELECT id, concept, column_name, {half_up('score', 6)} AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, concept) AS rank FROM (
            SELECT vec_id AS id, concept, column_name, {COSINE} AS score FROM k JOIN c USING (label) JOIN e ON TRUE))
        WHERE rank = 1 AND score > 0.3""",
    "corpus_upsert": """SELECT vec_id, label, CAST(CASE WHEN label IN (0, 2, 4, 6, 8) THEN embedding[1] * 2
        ELSE embedding[1] END AS DOUBLE) AS first_value FROM embeddings WHERE label <> 9""",
    "events_malformed_split": f"""SELECT CASE WHEN event_type = 'malformed' THEN 'malformed' ELSE 'event' END AS state,
        CAST(sum(events) AS BIGINT) AS lines FROM ({KINDS}) GROUP BY 1""",
    "event_type_counts": KINDS,
    "route_events": f"""SELECT 'transactions' AS entity, count(*) AS row_count FROM ({ORDER_LINES})
        UNION ALL SELECT CASE event_type WHEN 'user_update' THEN 'users' WHEN 'product_update' THEN 'products'
          WHEN 'inventory_update' THEN 'inventory' ELSE 'shipments' END, events FROM ({KINDS})
        WHERE event_type IN ('user_update', 'product_update', 'inventory_update', 'shipment_update')""",
    "explode_orders": f"""SELECT transaction_id, user_id, product_id,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", amount, store_id FROM ({ORDER_LINES})""",
    "guarded_best_store": over(f"""SELECT store_id, {money('amount')} AS total_revenue FROM ft JOIN ds USING (store_key)
        GROUP BY store_id ORDER BY total_revenue DESC, store_id LIMIT 1""", "ft", "ds"),
    "stream_batch_counts": KINDS.replace("count(*) AS events", "CAST(count(*) AS BIGINT) AS events"),
    "stream_equals_batch": f"""SELECT transaction_id, user_id, product_id, ts AS "timestamp", amount, store_id
        FROM ({ORDER_LINES}) WHERE amount > 0""",
    "stream_inventory": f"""SELECT store AS store_id, 'P' || k AS product_id, arg_max(k, event_id) AS stock_level,
        arg_max(CAST(ts AS DATE), event_id) AS last_restock_date FROM ({EVENTS})
        WHERE event_type = 'click' AND k < 50 GROUP BY store, k""",
    "stream_summary": f"""SELECT {money('amount')} AS total_revenue,
        (SELECT count(DISTINCT x.user_id) FROM ({ORDER_LINES}) x
         JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'signup') u
         ON x.user_id = u.user_id WHERE amount > 0) AS active_users,
        count(DISTINCT transaction_id) AS total_orders FROM ({ORDER_LINES}) WHERE amount > 0""",
    "stream_running_totals": KINDS.replace("count(*) AS events", "CAST(count(*) AS BIGINT) AS events"),
    "stream_orders_once": f"""SELECT transaction_id, product_id, ts AS "timestamp", amount FROM ({ORDER_LINES})""",
}

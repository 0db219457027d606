"""Every operator as a named query over the given tables: name -> (session, folder) -> DataFrame.

Reports read a lakehouse that is built from the given tables once per session and folder, each table
when a report first needs it; the build of all of them at once is the query ``medallion_status``.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart import fixed_values as fixed
from tidemart.functions.columns import finite, money_sum
from tidemart.operators import access, history, neighbours, silver, star, uploads
from tidemart.operators.keys import dense_key, keep_one
from tidemart.plans import bindings, kpi, lakehouse, quality, questions, rollups
from tidemart.session import pin_utc, scratch_dir, settle
from tidemart.sources import files, keyed, raw, tables
from tidemart.streaming import events as ev, ingest, state

AS_OF = "2002-01-01"
CITY = "NATION_7"
CATEGORY = "ECONOMY"
JSON_FILE_BYTES = 1 << 20  # of the products table that are written as one JSON file
EVENT_FILE_BYTES = 32 << 20  # of the events table that land as one file
RELATIONAL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SALES = ["transactions", "users", "products"]  # what the dimensions and the sales are made of
GOLD = ["dim_users", "dim_products", "dim_stores", "dim_dates", *(fact for fact, _, _ in lakehouse.FACTS.values())]
Query = Callable[[SparkSession, str], DataFrame]

_built: dict[tuple[str, str, str], str] = {}
_opened: dict[str, tuple[_Tables, _Tables]] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[str], None]) -> str:
    """Folder of something derived from the given tables, made on first use in this session, and again when it was deleted."""
    slot = (spark.sparkContext.applicationId, sf_dir, what)
    if slot not in _built or not files.exists(spark, _built[slot]):
        path = scratch_dir(spark, what)
        make(path)
        _built[slot] = path
    return _built[slot]


class _Tables(Mapping):
    """Tables by name; one is built, with what it is made of, when it is first used."""

    def __init__(self, names: Collection[str], build: Callable[[str], DataFrame]) -> None:
        self._names, self._build = list(names), build
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._open:
            self._open[name] = self._build(name)
        return self._open[name]

    def __contains__(self, name: object) -> bool:
        return name in self._names

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def _lake(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the lakehouse of the given tables."""
    return _once(spark, sf_dir, "lake", lambda path: files.touch(spark, f"{path}/_started"))


def _checked(run: lakehouse.Run) -> None:
    failed = [step for step in run.status if step[3].startswith("failed")]
    if failed:
        raise RuntimeError(f"lakehouse build: {failed}")


def _silver(spark: SparkSession, sf_dir: str, entities: Collection[str]) -> str:
    """The lakehouse with at least the silver tables of ``entities``."""
    root = _lake(spark, sf_dir)
    missing = [e for e in entities if tables.current_path(spark, lakehouse.silver_root(root), e) is None]
    if missing:
        run, raws = lakehouse.Run(spark), {e: bindings.RAW[e](spark, sf_dir) for e in missing}
        lakehouse.build_silver(run, raws, root, AS_OF, missing)
        _checked(run)
    return root


def lake_root(spark: SparkSession, sf_dir: str, facts: Collection[str] = tuple(lakehouse.FACTS)) -> str:
    """The lakehouse with its dimensions and at least the facts made of the raw tables ``facts``. What is there stays."""
    wanted = [e for e in lakehouse.ENTITIES if e in SALES or e in facts]
    root = _silver(spark, sf_dir, wanted)
    have = tables.sealed(spark, lakehouse.gold_root(root)) or {}
    missing = [e for e in wanted if e in lakehouse.FACTS and lakehouse.FACTS[e][0] not in have]
    if missing:
        run = lakehouse.Run(spark)
        lakehouse.build_gold(run, root, AS_OF, by_month=False, changed={e: set() for e in missing})
        _checked(run)
    return root


def _layers(spark: SparkSession, sf_dir: str) -> tuple[_Tables, _Tables]:
    def gold_table(name: str) -> DataFrame:
        made_of = [e for e, (fact, _, _) in lakehouse.FACTS.items() if fact == name]
        return lakehouse.read_gold(spark, lake_root(spark, sf_dir, made_of))[name]

    def silver_table(name: str) -> DataFrame:
        return lakehouse.read_silver(spark, _silver(spark, sf_dir, [name]))[name]

    root = _lake(spark, sf_dir)
    if root not in _opened:
        _opened[root] = (_Tables(GOLD, gold_table), _Tables(lakehouse.ENTITIES, silver_table))
    return _opened[root]


def gold(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    return _layers(spark, sf_dir)[0]


def clean_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    return _layers(spark, sf_dir)[1]


def raw_files(spark: SparkSession, sf_dir: str, entity: str) -> str:
    """Raw files of one entity, made of the given tables: transactions in two layouts, users as two snapshots.

    They are packed: a file is read by one task in any case, as quoted values may hold line breaks.
    """
    def transactions(path: str) -> None:
        own = bindings.transactions(spark, sf_dir).withColumn(
            "timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
        tables.append_raw(own, path, "transactions", "a", "gzip")
        tables.append_raw(bindings.foreign_transactions(spark, sf_dir).drop("l_returnflag"), path, "transactions", "b", "gzip")

    def users(path: str) -> None:
        tables.append_raw(bindings.users_day1(spark, sf_dir), path, "users", "20240101", "gzip")
        tables.append_raw(bindings.users_day2(spark, sf_dir), path, "users", "20240102", "gzip")

    return _once(spark, sf_dir, f"raw-{entity}", {"transactions": transactions, "users": users}[entity])


def _raw(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    return lakehouse.read_raw(spark, raw_files(spark, sf_dir, entity), entity)


def _raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, "transactions")


def _utc(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(pin_utc(spark), sf_dir.rstrip("/"))
    run.__doc__ = query.__doc__
    return run


def _on_gold(report: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf_dir: report(gold(spark, sf_dir), *args, **kwargs)


def _cleaned(entity: str) -> Query:
    return lambda spark, sf_dir: silver.clean(entity, bindings.RAW[entity](spark, sf_dir), AS_OF)


# -- sources and sinks ------------------------------------------------------------------------

def _roundtrip(write: Callable[[DataFrame, str], None], suffix: str, source: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch_dir(spark, 'upload')}/upload.{suffix}"
        write(source(spark, sf_dir), path)
        df = raw.read_upload(spark, path)
        return df.drop(raw.LINEAGE)
    return run


def _accented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.products(spark, sf_dir).select(
        "product_id", F.concat("product_name", F.lit(" café")).alias("product_name"))


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string") for c in df.columns])


def tsv_scan(spark, sf_dir):
    return _roundtrip(lambda df, p: df.write.option("header", True).option("sep", "\t").csv(p),
                      "tsv", lambda s, d: _as_text(bindings.users(s, d)))(spark, sf_dir)


def latin1_scan(spark, sf_dir):
    return _roundtrip(lambda df, p: df.write.option("header", True).option("encoding", "ISO-8859-1").csv(p),
                      "csv", _accented)(spark, sf_dir)


def json_scan(spark, sf_dir):
    """Products as JSON files that each hold one array of records; their number grows with the table's bytes, not its ids."""
    path = f"{scratch_dir(spark, 'upload')}/upload.json"
    rows = bindings.products(spark, sf_dir)
    record = F.to_json(F.struct(*rows.columns))
    count = max(4, files.size(spark, f"{sf_dir}/part.parquet") // JSON_FILE_BYTES)
    (
        rows.select(F.pmod(F.xxhash64("product_id"), F.lit(count)).alias("chunk"), record.alias("record"))
        .groupBy("chunk").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("v"))
        .write.partitionBy("chunk").text(path)
    )
    return raw.read_json_records(spark, path, rows.schema).select(*rows.columns)


def parquet_scan(spark, sf_dir):
    return _roundtrip(lambda df, p: df.write.parquet(p), "parquet", bindings.products)(spark, sf_dir)


def bronze_union_by_name(spark, sf_dir):
    return _raw_transactions(spark, sf_dir).drop(raw.LINEAGE)


def bronze_file_profile(spark, sf_dir):
    """Rows per batch of raw files and the columns it fills."""
    batch = F.substring_index(raw.LINEAGE, "/", 1)
    files = raw.coverage(_raw_transactions(spark, sf_dir).withColumn(raw.LINEAGE, batch))
    return files


def users_latest_by_file(spark, sf_dir):
    return silver.clean("users", _raw(spark, sf_dir, "users"), AS_OF)


def scan_partition_pruned(spark, sf_dir):
    """Six months out of the fact laid out by month: the other folders are not opened."""
    path = scratch_dir(spark, "by-month")
    tables.write_partitioned(gold(spark, sf_dir)["fact_transactions"], path, lakehouse.FACT_LAYOUT)
    fact = raw.read_parquet(spark, path)
    return fact.filter("month_key between 199601 and 199606").groupBy("month_key").agg(
        F.count(F.lit(1)).alias("lines"))


def fact_inventory_roundtrip(spark, sf_dir):
    fact = gold(spark, sf_dir)["fact_inventory"].drop("month_key")
    path = scratch_dir(spark, "inventory")
    tables.write_partitioned(fact, path, ["region"])
    return raw.read_parquet(spark, path).select(*fact.columns)


def layer_tables(spark, sf_dir):
    """The tables found in the gold folder, read through views of their names."""
    found = tables.layer(spark, lakehouse.gold_root(lake_root(spark, sf_dir)))
    tables.register_views(found)
    return tables.row_counts({name: spark.table(name) for name in found})


def layer_profile(spark, sf_dir):
    return tables.profile(spark, gold(spark, sf_dir))


def layer_samples(spark, sf_dir):
    """The profile of the dimensions with their first rows by key."""
    layer = gold(spark, sf_dir)
    keys = {"dim_users": ["surrogate_key"], "dim_products": ["product_key"], "dim_stores": ["store_key"]}
    return tables.profile(spark, {name: layer[name] for name in keys}, 3, keys).select(
        "table", "ordinal", "column", "row_count", F.array_join("samples", "|", "-").alias("samples"))


def table_refresh(spark, sf_dir):
    """A table in folders by key, refreshed twice: a third of the products at double price, then new ones."""
    root, goods = scratch_dir(spark, "refresh"), bindings.products(spark, sf_dir).withColumn("version", F.lit(0))
    third = goods.filter(F.pmod(F.col("product_id").cast("long"), F.lit(3)) == 0)
    new = goods.withColumn("product_id", F.concat(F.lit("N"), "product_id"))
    for changes in (goods, third.withColumns({"price": F.col("price") * 2, "version": F.lit(1)}), new):
        keyed.fold(settle(changes, "refresh"), root, "products", ["product_id"],
                   lambda both: keep_one(both, ["product_id"], [F.desc("version")]), files.size(spark, sf_dir + "/part.parquet"), 1 << 16)
    return tables.read_current(spark, root, "products")


def table_publish(spark, sf_dir):
    """A table that is read and replaced by the same job, twice."""
    root = scratch_dir(spark, "publish")
    tables.publish(bindings.products(spark, sf_dir), root, "products")
    for _ in range(2):
        again = tables.read_current(spark, root, "products")
        tables.publish(again.withColumn("price", F.col("price") + 1), root, "products")
    return tables.read_current(spark, root, "products")


# -- uploads ----------------------------------------------------------------------------------

def synonym_coalesce(spark, sf_dir):
    rows = silver.type_transactions(_raw_transactions(spark, sf_dir), AS_OF)
    return rows.select("transaction_id", "user_id", "product_id", "timestamp", "store_id")


def generated_ids(spark, sf_dir):
    """Two uploads of the same lines without ids: every line is an order of its own, in either file."""
    lines = bindings.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"), F.col("l_extendedprice").alias("amount"))
    both = lines.withColumn(raw.LINEAGE, F.lit("a.csv")).unionByName(lines.withColumn(raw.LINEAGE, F.lit("b.csv")))
    typed = silver.type_transactions(both, AS_OF)
    return typed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("transaction_id").alias("ids"))


def generated_id_lines(spark, sf_dir):
    """Every line of two uploads without order ids, with the id it got: from its file, its content, and a count of equal lines."""
    lines = bindings.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"), F.col("l_quantity").cast("int").cast("string").alias("quantity"))
    both = lines.withColumn(raw.LINEAGE, F.lit("a.csv")).unionByName(lines.withColumn(raw.LINEAGE, F.lit("b.csv")))
    return silver.type_transactions(both, AS_OF).select("transaction_id", "product_id", raw.LINEAGE)


def upload_entities(spark, sf_dir):
    """What each given table would be taken for as an upload, the required columns it lacks, and its rows."""
    out = None
    for name in RELATIONAL:
        df = bindings.table(spark, sf_dir, name)
        entity = uploads.upload_entity(df.columns)
        named = uploads.rename(df, uploads.standard_names(df.columns))
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), F.lit(uploads.scanned_entity(df.columns)).alias("scanned"), F.lit(entity).alias("uploaded"),
            F.lit(",".join(uploads.missing_required(named, entity))).alias("missing"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def odd_amounts(spark, sf_dir):
    """Fractions of a cent beside very large amounts."""
    price, kind = F.col("l_extendedprice"), F.col("l_linenumber") % 3
    lines = bindings.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"), F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_returnflag").alias("store_id"),
        F.when(kind == 0, price * 1e11).when(kind == 1, price / 1e5).otherwise(price).alias("amount"))
    valid = silver.valid_rows("transactions", silver.type_transactions(lines, AS_OF))
    return valid.groupBy("store_id").agg(F.count(F.lit(1)).alias("lines"), money_sum(F.col("amount")).alias("revenue"))


def amount_derivation(spark, sf_dir):
    rows = silver.type_transactions(_raw_transactions(spark, sf_dir), AS_OF)
    return rows.select("transaction_id", "product_id", "amount")


def column_defaults(spark, sf_dir):
    """Lines that bring only an order and a price."""
    rows = bindings.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_extendedprice").alias("total"))
    return silver.type_transactions(rows, AS_OF)


def _foreign(spark, sf_dir) -> DataFrame:
    return bindings.foreign_transactions(spark, sf_dir).drop("l_returnflag")


def normalized_upload(spark, sf_dir):
    df = _foreign(spark, sf_dir)
    return uploads.derive(uploads.rename(df, uploads.mapping_for(df, "standard")))


def rule_mapped_upload(spark, sf_dir):
    df = _foreign(spark, sf_dir)
    return uploads.rename(df, uploads.mapping_for(df, "rules"))


def recommended_upload(spark, sf_dir):
    df = _foreign(spark, sf_dir)
    return uploads.rename(df, uploads.mapping_for(df, "recommend"))


def rename_with_provenance(spark, sf_dir):
    """The raw files of users as a foreign data set: one normalizer, provenance on every row."""
    df = _raw(spark, sf_dir, "users")
    named = uploads.rename(df, {"name": "user_name", "city": "store_id"}, source="dataset")
    return named.withColumn(raw.LINEAGE, F.substring_index(raw.LINEAGE, "/", 1))


def dataset_ingest(spark, sf_dir):
    """A folder of files in two layouts through the rule mapping."""
    df = raw.read_delimited(spark, raw_files(spark, sf_dir, "transactions"), "transactions_*")
    named = uploads.ingest_dataset(df, "dataset")
    return named.groupBy("data_source", "store_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("transaction_id").alias("with_order"),
        F.count("timestamp").alias("with_time"))


def upload_defaults(spark, sf_dir):
    df = bindings.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("Client"), F.col("c_name").alias("Label"))
    return uploads.mapped_upload(df, "users", {"user_id": "Client", "name": "Label"}, AS_OF)


def _combined(spark, sf_dir) -> dict[str, DataFrame]:
    lines = bindings.transactions(spark, sf_dir)
    people = bindings.users(spark, sf_dir)
    goods = bindings.products(spark, sf_dir).drop("price")
    wide = lines.join(people, "user_id").join(goods, "product_id")
    return uploads.split_combined(wide.withColumnRenamed("name", "full_name"), AS_OF)


def split_combined_users(spark, sf_dir):
    return _combined(spark, sf_dir)["users"].drop("product_name")


def split_combined_products(spark, sf_dir):
    return _combined(spark, sf_dir)["products"]


def split_combined_transactions(spark, sf_dir):
    return _combined(spark, sf_dir)["transactions"]


def best_effort_upload(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "supplier").select(
        "s_name", F.col("s_suppkey").alias("row_number"), F.col("s_acctbal"))
    return uploads.best_effort(rows.select("s_name", "s_acctbal", "row_number"), AS_OF)


def stock_status(spark, sf_dir):
    return bindings.inventory(spark, sf_dir).groupBy("stock_status").agg(F.count(F.lit(1)).alias("rows"))


# -- dimensions, history, facts -----------------------------------------------------------------

def dense_key_query(spark, sf_dir):
    orders = bindings.table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return dense_key(orders, ["l_orderkey"], "order_key", kind="bigint")


def dim_products(spark, sf_dir):
    return star.dim_products(clean_tables(spark, sf_dir)["products"])


def dim_stores(spark, sf_dir):
    return star.dim_stores(clean_tables(spark, sf_dir)["transactions"])


def dim_dates(spark, sf_dir):
    return star.dim_dates(clean_tables(spark, sf_dir)["transactions"])


def scd2_initial(spark, sf_dir):
    return history.first_load(silver.clean("users", bindings.users_day1(spark, sf_dir), AS_OF))


def _merge(spark, sf_dir, drop_missing: bool) -> DataFrame:
    root = scratch_dir(spark, "history")
    tables.publish(scd2_initial(spark, sf_dir), root, "dim_users")
    day2 = silver.clean("users", bindings.users_day2(spark, sf_dir), AS_OF)
    return history.merge(tables.read_current(spark, root, "dim_users"), day2, AS_OF, drop_missing=drop_missing)


def scd2_merge(spark, sf_dir):
    return _merge(spark, sf_dir, drop_missing=False)


def scd2_merge_drop_missing(spark, sf_dir):
    return _merge(spark, sf_dir, drop_missing=True)


def scd2_replay(spark, sf_dir):
    """The second snapshot applied twice, the history replaced in between: same as once."""
    root = scratch_dir(spark, "history")
    tables.publish(scd2_merge(spark, sf_dir), root, "dim_users")
    day2 = silver.clean("users", bindings.users_day2(spark, sf_dir), AS_OF)
    return history.merge(tables.read_current(spark, root, "dim_users"), day2, AS_OF)


def fact_transactions(spark, sf_dir):
    clean, dims = clean_tables(spark, sf_dir), gold(spark, sf_dir)
    return star.fact_transactions(clean["transactions"], dims["dim_users"], dims["dim_products"], dims["dim_stores"])


def fact_inventory(spark, sf_dir):
    clean, dims = clean_tables(spark, sf_dir), gold(spark, sf_dir)
    return star.fact_inventory(clean["inventory"], dims["dim_products"], dims["dim_stores"], AS_OF)


def fact_shipments(spark, sf_dir):
    return star.fact_shipments(clean_tables(spark, sf_dir)["shipments"], gold(spark, sf_dir)["dim_stores"])


def medallion_status(spark, sf_dir):
    """A whole build, from the given tables to the last fact."""
    return lakehouse.build_lakehouse(spark, bindings.raw_tables(spark, sf_dir), scratch_dir(spark, "build"), AS_OF, by_month=False)


# -- quality and access -------------------------------------------------------------------------

def dq_scores(spark, sf_dir):
    return quality.scores(gold(spark, sf_dir)["fact_transactions"], "2001-08-01", 365)


def dq_trend(spark, sf_dir):
    return quality.trend(gold(spark, sf_dir)["fact_transactions"])


def dq_checks(spark, sf_dir):
    return quality.checks(gold(spark, sf_dir))


def _dirty(spark, sf_dir) -> dict[str, DataFrame]:
    """Raw lines with faults that follow from their own values."""
    sold = bindings.table(spark, sf_dir, "lineitem")
    lines = sold.select(
        F.when(F.col("l_returnflag") != "A", F.col("l_orderkey").cast("string")).alias("transaction_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(F.col("l_discount") == 0, F.lit("n/a"))
        .otherwise((F.col("l_extendedprice") * (F.col("l_tax") - 0.01)).cast("string")).alias("amount"))
    stock = bindings.inventory(spark, sf_dir).withColumn("stock_level", F.col("stock_level") - 20)
    return {"transactions": lines, "inventory": stock}


def dq_rejects(spark, sf_dir):
    return silver.reject_counts(_dirty(spark, sf_dir), AS_OF)


def dq_rejects_more(spark, sf_dir):
    """Raw users, products and shipments with faults that follow from their own values."""
    people = bindings.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey").cast("string")).alias("user_id"), F.col("c_name").alias("name"))
    goods = bindings.table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") != 7, F.col("p_partkey").cast("string")).alias("product_id"), F.col("p_name").alias("product_name"),
        F.when(F.col("p_size") % 5 == 0, -F.col("p_retailprice")).when(F.col("p_size") % 5 == 1, F.lit("Infinity").cast("double"))
        .otherwise(F.col("p_retailprice")).alias("price"))
    sent = bindings.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 2, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("shipment_id"),
        (F.col("l_extendedprice") * (F.col("l_tax") - 0.02)).alias("shipping_cost"))
    return silver.reject_counts({"users": people, "products": goods, "shipments": sent}, AS_OF)


def raw_column_kinds(spark, sf_dir):
    """The given tables written as raw text files and profiled as they come back: kinds from names and from values."""
    def make(path: str) -> None:
        for name in RELATIONAL:
            tables.append_raw(_as_text(bindings.table(spark, sf_dir, name)), path, name, "1")

    root, out = _once(spark, sf_dir, "raw-tables", make), None
    for name in RELATIONAL:
        rows = lakehouse.read_raw(spark, root, name).drop(raw.LINEAGE)
        found = quality.column_profile(rows).select(
            F.lit(name).alias("table"), "column", "kind", "null_count", "unique_count")
        out = found if out is None else out.unionByName(found)
    return out


def finite_values(spark, sf_dir):
    """Amounts with infinity and not-a-number put in, as reports hand them out: null."""
    price = F.col("l_extendedprice")
    odd = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(price)
    return finite(bindings.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", odd.alias("amount")))


def missing_sources(spark, sf_dir):
    """Rows of reports over a gold layer without its products: those that need them are empty, the others whole."""
    layer = gold(spark, sf_dir)
    left = {name: layer[name] for name in layer if name != "dim_products"}
    reports = {"top_products": kpi.top_products, "seasonal_trends": kpi.seasonal_trends, "inventory_turnover": kpi.inventory_turnover,
               "clv": kpi.clv, "city_sales": kpi.city_sales, "delivery_metrics": kpi.delivery_metrics}
    return tables.row_counts({name: report(left) for name, report in reports.items()}).withColumnRenamed("table", "report")


def role_access(spark, sf_dir):
    """What each role reads: its tables, their rows, and the columns that are masked for it."""
    layer, out = gold(spark, sf_dir), None
    for role in fixed.ACCESS_POLICIES:
        for table in access.allowed_tables(role):
            seen = access.secure_table(layer, table, role)
            masked = [c for c in fixed.ACCESS_POLICIES[role]["masked_columns"] if c in seen.columns]
            hidden = [F.col(c) == fixed.MASK for c in masked] or [F.lit(False)]
            row = seen.agg(F.count(F.lit(1)).alias("rows"), F.count_if(reduce(lambda a, b: a & b, hidden)).alias("masked_rows")).select(
                F.lit(role).alias("role"), F.lit(table).alias("table"), F.lit(",".join(masked)).alias("masked"), "rows", "masked_rows")
            out = row if out is None else out.unionByName(row)
    return out


def seasonal_units(spark, sf_dir):
    """The map of each month as JSON text, by category."""
    return rollups.seasonal_units(gold(spark, sf_dir)).select("month", F.to_json("units").alias("units"))


def column_profile(spark, sf_dir):
    return quality.column_profile(clean_tables(spark, sf_dir)["shipments"])


def masked_view(spark, sf_dir):
    return access.secure_table(gold(spark, sf_dir), "dim_users", "analyst")


GUARDED = """
    WITH by_region AS (
        SELECT region, count(DISTINCT transaction_id) AS orders,
               CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue
        FROM fact_transactions WHERE user_key <> -1 GROUP BY region
    )
    SELECT replace(region, 'Region_', 'R') AS region, orders, revenue FROM by_region ORDER BY revenue DESC, region
"""


BEST_STORE = """
    SELECT store_id, CAST(sum(CAST(amount AS DECIMAL(34,9))) AS DOUBLE) AS total_revenue
    FROM fact_transactions JOIN dim_stores USING (store_key) GROUP BY store_id ORDER BY total_revenue DESC, store_id LIMIT 1
"""


def guarded_best_store(spark, sf_dir):
    return access.guarded_sql(spark, lakehouse.gold_root(lake_root(spark, sf_dir)), BEST_STORE, access.OWNER)


def guarded_sql(spark, sf_dir):
    """A reading statement of a manager, over the lakehouse with the facts that the role may read."""
    facts = [source for source, (fact, _, _) in lakehouse.FACTS.items() if fact in access.allowed_tables("manager")]
    return access.guarded_sql(spark, lakehouse.gold_root(lake_root(spark, sf_dir, facts)), GUARDED, "manager")


# -- vectors ------------------------------------------------------------------------------------

def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the mean vector of each label."""
    rows = bindings.table(spark, sf_dir, "embeddings")
    return rows, neighbours.centroids(rows.withColumnRenamed("embedding", "vector"), "label")


def cosine_topk(spark, sf_dir):
    rows, means = _vectors(spark, sf_dir)
    return neighbours.top_k(
        means.select(F.col("label").cast("bigint").alias("query_id"), "vector"),
        rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 3)


def l2_topk_filtered(spark, sf_dir):
    rows, means = _vectors(spark, sf_dir)
    hits = neighbours.top_k(
        means.select(F.col("label").cast("bigint").alias("query_id"), "vector", F.col("label").alias("category")),
        rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("category")),
        3, "l2", same_category=True)
    return hits.select("query_id", "id", (-F.col("score")).alias("distance"), "rank")


def concept_match(spark, sf_dir):
    """Each vector against the mean vectors of the labels that stand for a concept, in their order.

    The given vectors have no clear clusters, hence a lower threshold than the usual one.
    """
    rows, means = _vectors(spark, sf_dir)
    known = list(fixed.CONCEPT_COLUMNS.items())
    names = F.element_at(F.array(*[F.lit(n) for n, _ in known]), F.col("label") + 1)
    concepts = means.filter(F.col("label") < len(known)).select(names.alias("concept"), "vector")
    columns = spark.createDataFrame(known, "concept string, column_name string")
    return neighbours.nearest_concept(
        rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), concepts, columns, 0.3)


def corpus_upsert(spark, sf_dir):
    """Even-labelled vectors replaced by their doubles, label 9 deleted."""
    rows = bindings.table(spark, sf_dir, "embeddings")
    scaled = rows.filter("label in (0, 2, 4, 6, 8)").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    merged = history.upsert(rows, scaled, ["vec_id"])
    kept = history.remove(merged, rows.filter("label = 9"), ["vec_id"])
    return kept.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first_value"))


# -- events -------------------------------------------------------------------------------------

def _events(spark, sf_dir) -> DataFrame:
    return ev.parse(bindings.event_lines(spark, sf_dir).select("value"))


def events_malformed_split(spark, sf_dir):
    state = F.when(F.col("_corrupt").isNull(), "event").otherwise("malformed")
    return _events(spark, sf_dir).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("lines"))


def event_type_counts(spark, sf_dir):
    return ev.type_counts(_events(spark, sf_dir))


def route_events(spark, sf_dir):
    routed = ev.route(ev.well_formed(_events(spark, sf_dir)))
    return tables.row_counts(routed).withColumnRenamed("table", "entity")


def explode_orders(spark, sf_dir):
    rows = ev.order_lines(ev.well_formed(_events(spark, sf_dir)))
    return rows.withColumn("amount", F.col("amount").cast("double"))


def _events_upto(lines: DataFrame) -> int:
    return lines.agg(F.max("event_id")).first()[0] or 0


def _streamed(spark, sf_dir) -> str:
    """The event lines as files, worked off by the streaming query in three micro-batches."""
    def make(path: str) -> None:
        landing, lines = f"{path}/landing", bindings.event_lines(spark, sf_dir)
        count = max(6, files.size(spark, f"{sf_dir}/events.parquet") // EVENT_FILE_BYTES)
        lines.repartitionByRange(count, "event_id").sortWithinPartitions("event_id").select("value").write.text(landing)
        for i, (_, file, _) in enumerate(files.children(spark, landing)):  # they arrive in the order of the events
            files.set_modified(spark, file, 1_700_000_000 + i)
        ingest.run_available(spark, landing, path, f"{path}/checkpoint", AS_OF, refresh_every=2, max_files=-(-count // 3))
    return _once(spark, sf_dir, "stream", make)


def stream_batch_counts(spark, sf_dir):
    seen = ingest.metrics(spark, _streamed(spark, sf_dir))
    return seen.groupBy("event_type").agg(F.sum("events").alias("events"))


def stream_running_totals(spark, sf_dir):
    """Totals per event type kept by a stream that is stopped and started again in between."""
    def make(path: str) -> None:
        landing, lines = f"{path}/landing", bindings.event_lines(spark, sf_dir)
        for part in range(3):  # a start for each half, and one that finds nothing new
            if part < 2:
                own = lines.filter(F.col("event_id") % 2 == part).select("value")
                own.write.mode("append").text(landing)
            state.start_totals(spark, landing, path, f"{path}/checkpoint", None).awaitTermination()

    found = state.running_totals(spark, _once(spark, sf_dir, "totals", make))
    return found.select("event_type", "events")


def stream_orders_once(spark, sf_dir):
    """Order lines of a stream in which every part is followed by the one before it once more; within 14 days each counts once."""
    def make(path: str) -> None:
        landing, lines = f"{path}/landing", bindings.event_lines(spark, sf_dir)
        last = _events_upto(lines)
        part = F.floor(F.col("event_id") * 6 / (last + 1))
        for number in range(6):  # one after the other: a start for each
            lines.filter((part == number) | (part == number - 1)).select("value").write.mode("append").text(landing)
            state.start_order_lines(spark, landing, f"{path}/orders", f"{path}/checkpoint", "14 days", None).awaitTermination()

    found = state.read_order_lines(spark, f"{_once(spark, sf_dir, 'orders-once', make)}/orders")
    return found.select("transaction_id", "product_id", "timestamp", "amount")


def stream_equals_batch(spark, sf_dir):
    return lakehouse.read_silver(spark, _streamed(spark, sf_dir))["transactions"]


def stream_inventory(spark, sf_dir):
    """Stock after the stream: what arrived last decides."""
    rows = lakehouse.read_silver(spark, _streamed(spark, sf_dir))["inventory"]
    return rows.select("store_id", "product_id", "stock_level", "last_restock_date")


def stream_summary(spark, sf_dir):
    return kpi.summary_kpis(lakehouse.read_gold(spark, _streamed(spark, sf_dir)))


_QUERIES: dict[str, Query] = {
    # sources and sinks
    "bronze_union_by_name": bronze_union_by_name,
    "bronze_file_profile": bronze_file_profile,
    "users_latest_by_file": users_latest_by_file,
    "tsv_scan": tsv_scan,
    "json_scan": json_scan,
    "parquet_scan": parquet_scan,
    "latin1_scan": latin1_scan,
    "dataset_ingest": dataset_ingest,
    "scan_partition_pruned": scan_partition_pruned,
    "fact_inventory_roundtrip": fact_inventory_roundtrip,
    "table_publish": table_publish,
    "table_refresh": table_refresh,
    "layer_tables": layer_tables,
    "layer_profile": layer_profile,
    "layer_samples": layer_samples,
    # uploads
    "synonym_coalesce": synonym_coalesce,
    "amount_derivation": amount_derivation,
    "generated_ids": generated_ids,
    "generated_id_lines": generated_id_lines,
    "upload_entities": upload_entities,
    "odd_amounts": odd_amounts,
    "column_defaults": column_defaults,
    "normalized_upload": normalized_upload,
    "rule_mapped_upload": rule_mapped_upload,
    "recommended_upload": recommended_upload,
    "rename_with_provenance": rename_with_provenance,
    "upload_defaults": upload_defaults,
    "split_combined_users": split_combined_users,
    "split_combined_products": split_combined_products,
    "split_combined_transactions": split_combined_transactions,
    "best_effort_upload": best_effort_upload,
    "stock_status": stock_status,
    # silver
    **{f"silver_{e}": _cleaned(e) for e in lakehouse.ENTITIES},
    # keys, dimensions, history, facts
    "dense_key": dense_key_query,
    "dim_products": dim_products,
    "dim_stores": dim_stores,
    "dim_dates": dim_dates,
    "scd2_initial": scd2_initial,
    "scd2_merge": scd2_merge,
    "scd2_merge_drop_missing": scd2_merge_drop_missing,
    "scd2_replay": scd2_replay,
    "fact_transactions": fact_transactions,
    "fact_inventory": fact_inventory,
    "fact_shipments": fact_shipments,
    "medallion_status": medallion_status,
    # reports
    "clv": _on_gold(kpi.clv),
    "market_basket": _on_gold(kpi.market_basket, 2),
    "summary_kpis": _on_gold(kpi.summary_kpis),
    "revenue_daily": _on_gold(kpi.revenue_timeseries, "daily"),
    "revenue_monthly": _on_gold(kpi.revenue_timeseries, "monthly"),
    "revenue_yearly": _on_gold(kpi.revenue_timeseries, "yearly"),
    "city_sales": _on_gold(kpi.city_sales),
    "top_products": _on_gold(kpi.top_products),
    "inventory_turnover": _on_gold(kpi.inventory_turnover),
    "delivery_metrics": _on_gold(kpi.delivery_metrics),
    "seasonal_trends": _on_gold(kpi.seasonal_trends),
    "customer_segmentation": _on_gold(kpi.customer_segmentation),
    # quality
    "dq_scores": dq_scores,
    "dq_trend": dq_trend,
    "dq_checks": dq_checks,
    "dq_rejects": dq_rejects,
    "dq_rejects_more": dq_rejects_more,
    "column_profile": column_profile,
    "raw_column_kinds": raw_column_kinds,
    "finite_values": finite_values,
    "missing_sources": missing_sources,
    # roll-ups
    "clv_headline": _on_gold(rollups.clv_headline),
    "top_customers": _on_gold(rollups.top_customers),
    "top_pairs": _on_gold(rollups.top_pairs),
    "segment_share": _on_gold(rollups.segment_share),
    "delivery_headline": _on_gold(rollups.delivery_headline),
    "region_bottlenecks": _on_gold(rollups.region_bottlenecks),
    "carrier_performance": _on_gold(rollups.carrier_performance),
    "inventory_headline": _on_gold(rollups.inventory_headline),
    "stock_by_category": _on_gold(rollups.stock_by_category),
    "seasonal_pivot": _on_gold(rollups.seasonal_pivot),
    "seasonal_units": seasonal_units,
    "reorder_alerts": _on_gold(rollups.reorder_alerts),
    # questions
    "ask_total_revenue": _on_gold(questions.total_revenue),
    "ask_order_count": _on_gold(questions.order_count),
    "ask_average_order_value": _on_gold(questions.average_order_value),
    "ask_city_revenue": _on_gold(questions.city_revenue, CITY),
    "ask_category_product_count": _on_gold(questions.category_product_count, CATEGORY),
    "ask_top_customers": _on_gold(questions.top_customers),
    "ask_top_products": _on_gold(questions.top_products),
    "ask_category_revenue": _on_gold(questions.category_revenue),
    "ask_best_store": _on_gold(questions.best_store),
    "revenue_prev_month": _on_gold(questions.previous_month_revenue, "2001-08-15"),
    "city_top_customers": _on_gold(questions.city_top_customers, CITY),
    # access
    "masked_view": masked_view,
    "role_access": role_access,
    "guarded_sql": guarded_sql,
    "guarded_best_store": guarded_best_store,
    # vectors
    "cosine_topk": cosine_topk,
    "l2_topk_filtered": l2_topk_filtered,
    "concept_match": concept_match,
    "corpus_upsert": corpus_upsert,
    # events
    "events_malformed_split": events_malformed_split,
    "event_type_counts": event_type_counts,
    "route_events": route_events,
    "explode_orders": explode_orders,
    "stream_batch_counts": stream_batch_counts,
    "stream_equals_batch": stream_equals_batch,
    "stream_inventory": stream_inventory,
    "stream_summary": stream_summary,
    "stream_running_totals": stream_running_totals,
    "stream_orders_once": stream_orders_once,
}

QUERIES: dict[str, Query] = {name: _utc(query) for name, query in _QUERIES.items()}

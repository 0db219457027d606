"""Raw tables -> silver -> gold, each table on its own."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemart.functions.columns import date_key, month_key
from tidemart.operators import history, star
from tidemart.operators.keys import dense_key
from tidemart.operators.silver import clean
from tidemart.schemas import SILVER
from tidemart.session import scratch_scope, shuffles_dropped
from tidemart.sources import tables
from tidemart.sources.raw import read_delimited

ENTITIES = list(SILVER)
# Facts lie in one folder per month, so that date ranges prune whole folders. (A folder per region and day
# would be mostly single-row files at any size.) ``by_month=False`` keeps `month_key` an ordinary column.
FACT_LAYOUT = ["month_key"]
HISTORY_LAYOUT = ["is_current"]  # a merge replaces the current versions and adds to the closed ones
STATUS = "layer string, table string, rows bigint, status string"


def silver_root(root: str) -> str:
    return f"{root}/silver"


def gold_root(root: str) -> str:
    return f"{root}/gold"


def read_raw(spark: SparkSession, raw_root: str, entity: str, **options) -> DataFrame | None:
    """All raw files of an entity, or None when there are none."""
    return read_delimited(spark, raw_root, f"{entity}_*", **options)


def raw_tables(spark: SparkSession, raw_root: str, **options) -> dict[str, DataFrame]:
    found = {e: read_raw(spark, raw_root, e, **options) for e in ENTITIES}
    return {e: df for e, df in found.items() if df is not None}


def read_silver(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Silver tables with their public columns (the stored ones also carry where a row came from)."""
    layer = tables.layer(spark, silver_root(root))
    return {name: layer[name].select(*SILVER[name].names) for name in layer if name in SILVER}


def read_gold(spark: SparkSession, root: str) -> tables.Layer:
    return tables.layer(spark, gold_root(root))


Step = tuple[str, str, Callable[[], "str | None"]]  # layer, table, what writes it


class Run:
    """The steps of a build and how each ended. A failing step is recorded, not fatal."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.status: list[tuple[str, str, int | None, str]] = []

    def _do(self, step: Step) -> tuple[str, str, int | None, str]:
        layer, table, write = step
        try:
            with scratch_scope(self.spark):
                path = write()
        except Exception as failure:  # one bad table must not stop the others
            return layer, table, None, f"failed: {type(failure).__name__}: {str(failure)[:300]}"
        if path is None:
            return layer, table, None, "skipped"
        return layer, table, tables.open_version(self.spark, path).count(), "built"

    def together(self, steps: list[Step]) -> None:
        """Run steps that do not need each other at the same time, so small ones fill idle cores. Those of ``LARGE`` tables,
        which fill the cores alone, follow each other, and shuffle files go with their step, so that the disk holds the
        shuffles of one large table at a time, not of all."""
        queue = [step for step in steps if step[1] in LARGE]
        lanes = [[step] for step in steps if step not in queue] + [queue]
        with shuffles_dropped(self.spark), ThreadPoolExecutor(max_workers=len(lanes)) as pool:
            done = [status for lane in pool.map(lambda lane: [self._do(step) for step in lane], lanes) for status in lane]
        self.status += sorted(done, key=lambda status: [step[:2] for step in steps].index(status[:2]))

    def report(self) -> DataFrame:
        return self.spark.createDataFrame(self.status, STATUS)


# The day of a fact row, and the columns that carry the id of each dimension.
FACTS = {
    "transactions": ("fact_transactions", "timestamp", {"user_id": "users", "product_id": "products", "store_id": "stores"}),
    "inventory": ("fact_inventory", "last_restock_date", {"product_id": "products", "store_id": "stores"}),
    "shipments": ("fact_shipments", "shipped_date", {"origin_store_id": "stores", "dest_store_id": "stores"}),
}
LARGE = {name for source, (fact, _, _) in FACTS.items() for name in (source, fact)}  # silver and gold
DIMS = {"users": ("dim_users", "user_id", "surrogate_key"), "products": ("dim_products", "product_id", "product_key"),
        "stores": ("dim_stores", "store_id", "store_key")}
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of rows without month


def _with_month(fact: DataFrame) -> DataFrame:
    return fact.withColumn("month_key", month_key(F.col("date_key")))


def _month(source: str) -> Column:
    """Name of the month that a silver row's fact lies in."""
    return F.coalesce(month_key(date_key(F.col(FACTS[source][1]))).cast("string"), F.lit(_NO_MONTH))


def months_of(source: str, *parts: DataFrame) -> set[str]:
    """The months of silver rows; none for tables that are not facts."""
    if source not in FACTS or not parts:
        return set()
    months = reduce(DataFrame.unionByName, [rows.select(_month(source).alias("month")) for rows in parts])
    return {r.month for r in months.distinct().collect()}


def assign_keys(ids: DataFrame, root: str, table: str, id_column: str, key: str) -> DataFrame:
    """(id, key) of all ids ever seen; new ids get the keys after the highest one, and no key ever changes or goes.

    Only the new pairs are written, beside those that are there.
    """
    spark, keys = ids.sparkSession, f"{root}/keys"
    have = tables.read_current(spark, keys, table)
    ids = ids.select(id_column).filter(F.col(id_column).isNotNull()).distinct()
    new = ids if have is None else ids.join(have, id_column, "left_anti")
    if have is not None and new.isEmpty():
        return have
    base = 0 if have is None else have.agg(F.max(key)).first()[0] or 0
    tables.commit(dense_key(new, [id_column], key, base).select(id_column, key), keys, table, None, ())
    return tables.read_current(spark, keys, table)


def build_gold(
    run: Run, root: str, as_of: date | datetime | str | None, by_month: bool = True, changed: Mapping[str, set[str]] | None = None
) -> None:
    """Bring all gold tables up to date, then seal them as one set. When a step fails nothing is sealed, and readers keep
    the whole previous gold.

    ``changed`` names the silver tables that got rows since gold was last sealed, and the months of these rows (before and
    after); None stands for everything. Keys stay as they were given, so a fact is rewritten only in months with changed
    rows or with rows of an id whose key is new; other folders, and tables that nothing changed, are shared with the
    previous set. A fact that does not lie by month is then rewritten as a whole. Days since a restock depend on the day: on
    another day that fact is rewritten as a whole.
    """
    spark, gold = run.spark, gold_root(root)
    before = tables.sealed(spark, gold) or {}
    layout = FACT_LAYOUT if by_month else []
    if not before:
        changed = None
    built: dict[str, str] = {}
    silver = read_silver(spark, root)
    day = as_of.date() if isinstance(as_of, datetime) else as_of
    today = str(as_of if as_of is not None else spark.sql("SELECT current_date()").first()[0])

    def stays(source: str, table: str) -> str | None:
        """The current version, when nothing changed."""
        if changed is not None and source not in changed:
            return tables.current_path(spark, gold, table)
        return None

    def write(df: DataFrame, table: str, by: list[str] | None = None, replaces: set[str] | None = None, **facts) -> str:
        return tables.commit(df, gold, table, by, replaces, retain_hours=None, facts=facts)

    def users() -> str | None:
        if "users" not in silver:
            return None
        existing = tables.read_current(spark, gold, "dim_users")
        if existing is None:
            return write(history.first_load(silver["users"]), "dim_users", HISTORY_LAYOUT)
        unchanged = stays("users", "dim_users")
        if unchanged:
            return unchanged
        found = history.changes(existing, silver["users"], day)
        if found.changed.isEmpty():
            return tables.current_path(spark, gold, "dim_users")
        fresh = found.kept.unionByName(found.opened).unionByName(found.closed)
        laid_out = tables.snapshot(spark, gold, "dim_users")
        if laid_out is None or laid_out.by != HISTORY_LAYOUT:
            return write(fresh.unionByName(existing.filter(~F.col("is_current"))), "dim_users", HISTORY_LAYOUT)
        return write(fresh, "dim_users", HISTORY_LAYOUT, {"is_current=true"})  # closed versions stay in their folders

    def products() -> DataFrame:
        return star.dim_products(silver["products"], assign_keys(silver["products"], root, "products", "product_id", "product_key"))

    def stores() -> DataFrame:
        ids = star.store_ids(silver["transactions"])
        return star.dim_stores(silver["transactions"], assign_keys(ids, root, "stores", "store_id", "store_key"))

    def step(source: str, table: str, make: Callable[[], str | None]) -> Step:
        def run_step() -> str | None:
            path = make() if source in silver else None
            if path is not None:
                built[table] = path
            return path
        return "gold", table, run_step

    def dimension(source: str, table: str, make: Callable[[], DataFrame]) -> Step:
        return step(source, table, lambda: stays(source, table) or write(make(), table))

    def dim(name: str) -> DataFrame | None:
        return tables.read_current(spark, gold, name)

    def rekeyed(name: str) -> DataFrame | None:
        """Ids whose key is not the one of the sealed set."""
        table, id_column, key = DIMS[name]
        if built.get(table) == before.get(table) or table not in built:
            return None
        now = tables.open_version(spark, built[table])
        then = tables.open_version(spark, before[table]) if table in before else now.limit(0)
        if name == "users":
            now, then = now.filter("is_current"), then.filter("is_current")
        return now.select(id_column, key).join(then.select(id_column, key), [id_column, key], "left_anti").select(id_column)

    def fact(source: str, make: Callable[[DataFrame], DataFrame]) -> Step:
        table, _, ids = FACTS[source]

        def run_step() -> str | None:
            have = tables.snapshot(spark, gold, table)
            whole = changed is None or have is None or have.by != layout or (
                source == "inventory" and have.facts.get("as_of") != today)
            rows = silver[source]
            if whole:
                return write(_with_month(make(rows)), table, layout, as_of=today)
            fresh = {column: rekeyed(name) for column, name in ids.items()}
            if not by_month:
                if source in changed or any(found is not None for found in fresh.values()):
                    return write(_with_month(make(rows)), table, layout, as_of=today)
                return tables.current_path(spark, gold, table)
            months = set(changed.get(source, ())) | months_of(source, *[
                rows.join(found.toDF("_id"), F.col(column) == F.col("_id"), "left_semi") for column, found in fresh.items() if found is not None])
            if not months:
                return tables.current_path(spark, gold, table)
            some = rows.filter(_month(source).isin(*months))
            return write(_with_month(make(some)), table, FACT_LAYOUT, {f"month_key={m}" for m in months}, as_of=today)
        return step(source, table, run_step)

    run.together([
        step("users", "dim_users", users),
        dimension("products", "dim_products", products),
        dimension("transactions", "dim_stores", stores),
        dimension("transactions", "dim_dates", lambda: star.dim_dates(silver["transactions"])),
    ])
    run.together([
        fact("transactions", lambda t: star.fact_transactions(t, dim("dim_users"), dim("dim_products"), dim("dim_stores"))),
        fact("inventory", lambda t: star.fact_inventory(t, dim("dim_products"), dim("dim_stores"), as_of)),
        fact("shipments", lambda t: star.fact_shipments(t, dim("dim_stores"))),
    ])
    if built and not any(layer == "gold" and status.startswith("failed") for layer, _, _, status in run.status):
        tables.seal(spark, gold, built)


def build_silver(
    run: Run, raw: Mapping[str, DataFrame], root: str, as_of: date | datetime | str | None, entities: Collection[str] = ENTITIES
) -> None:
    """Clean the raw tables of ``entities``; the silver tables of others stay as they are."""
    def cleaned(entity: str) -> Callable[[], str | None]:
        def write() -> str | None:
            if entity not in raw:
                return None
            return tables.publish(clean(entity, raw[entity], as_of, keep_lineage=True), silver_root(root), entity)
        return write

    run.together([("silver", entity, cleaned(entity)) for entity in entities])


def build_lakehouse(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    root: str,
    as_of: date | datetime | str | None = None,
    by_month: bool = True,
) -> DataFrame:
    """Clean the raw tables, fold users into their history, build the star schema under ``root``.

    Entities that are missing or fail are reported and skipped. Returns (layer, table, rows, status).
    """
    run = Run(spark)
    build_silver(run, raw, root, as_of)
    build_gold(run, root, as_of, by_month)
    return run.report()


def build_from_files(
    spark: SparkSession, raw_root: str, root: str, as_of: date | datetime | str | None = None, **options
) -> DataFrame:
    return build_lakehouse(spark, raw_tables(spark, raw_root, **options), root, as_of)

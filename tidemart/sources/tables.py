"""Writing tables, publishing whole versions of them, and finding the tables of a layer."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Collection, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemart.sources import files

RETAIN_HOURS = 24.0
COMPRESSION = "zstd"  # of what a table keeps; a lakehouse is written once and lies on disk while others are built beside it


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_partitioned(df: DataFrame, path: str, columns: list[str], compression: str = "snappy") -> None:
    """Folder per value of ``columns``.

    The rebalance hint brings each value together, so a value does not get one small file per
    task, and lets the adaptive planner cut a value that holds much of the table into many tasks.
    """
    (
        df.hint("rebalance", *columns)
        .write.mode("overwrite").option("compression", compression)
        .partitionBy(*columns).parquet(path)
    )


def append_raw(df: DataFrame, root: str, entity: str, batch: str, compression: str = "none") -> str:
    """Add a batch of text rows to the raw layer. Writing the same batch again replaces it."""
    path = f"{root}/{entity}_{batch}.csv"
    (
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return path


# -- snapshots --------------------------------------------------------------------------------
# <root>/<table>/data/_v=<n>/ holds what version n wrote, <root>/<table>/v=<n>/ lists the folders that version n consists
# of: its own, and those of earlier versions that did not change. The newest version with a _SUCCESS mark is current, so a
# reader sees a whole table or the previous whole table, and a job may read what it replaces. One writer per table.

LISTING = "_files"
WRITTEN = "_v"


@dataclass(frozen=True)
class Snapshot:
    """What one version of a table consists of. Held by the driver: a line per folder, never data."""

    version: int
    schema: T.StructType
    by: list[str]  # columns the folders are named by
    folders: dict[str, int]  # below data/: _v=<n>/<column>=<value>/..., with their bytes
    dropped: list[tuple[str, int, float]]  # folders of earlier versions, the version that dropped them, and when
    facts: dict  # what a writer wants to know of its own table

    def places(self) -> dict[str, list[str]]:
        """The folders of each place (column=value/...), whoever wrote them."""
        out: dict[str, list[str]] = {}
        for folder in self.folders:
            out.setdefault(folder.partition("/")[2], []).append(folder)
        return out


def _versions(spark: SparkSession, root: str, table: str) -> list[int]:
    return sorted(
        int(name[2:]) for name, path, is_dir in files.children(spark, f"{root}/{table}")
        if is_dir and name.startswith("v=") and files.exists(spark, f"{path}/_SUCCESS")
    )


def _next_version(spark: SparkSession, root: str, table: str) -> int:
    started = [int(n[2:]) for n, _, d in files.children(spark, f"{root}/{table}") if d and n.startswith("v=")]
    return max(started, default=0) + 1


def _listed(spark: SparkSession, path: str) -> Snapshot | None:
    """The snapshot at the path of a version; None for a plain folder of files."""
    if not files.exists(spark, f"{path}/{LISTING}"):
        return None
    held = json.loads(files.read_text(spark, f"{path}/{LISTING}"))
    return Snapshot(held["version"], T.StructType.fromJson(held["schema"]), held["by"], held["folders"],
                    [tuple(d) for d in held["dropped"]], held["facts"])


def snapshot(spark: SparkSession, root: str, table: str) -> Snapshot | None:
    path = current_path(spark, root, table)
    return _listed(spark, path) if path else None


def commit(
    df: DataFrame, root: str, table: str, by: list[str] | None = None, replaces: Collection[str] | None = None,
    retain_hours: float | None = RETAIN_HOURS, facts: dict | None = None,
) -> str:
    """Write the next version of a table: ``df`` in folders named by the columns ``by``, in place of the folders at the
    places ``replaces`` (such as ``month_key=202401``; None: of all), beside all others, which are not touched.

    Listings before the previous one go at once, folders ``retain_hours`` after they were dropped (a reader has the list of
    its files, so it may run for so long beside any number of refreshes). None keeps both, for a layer that is sealed.
    """
    spark, by = df.sparkSession, by or []
    old, number, data = snapshot(spark, root, table), _next_version(spark, root, table), f"{root}/{table}/data"
    own = f"{WRITTEN}={number}"
    if by:
        write_partitioned(df, f"{data}/{own}", by, COMPRESSION)
    else:
        write_parquet(df, f"{data}/{own}", COMPRESSION)
    folders: dict[str, int] = {}
    for path, size in files.matching(spark, f"{data}/{own}/{'*/' * len(by)}*.parquet"):
        place = own + path.rpartition(f"/{own}")[2].rpartition("/")[0]
        folders[place] = folders.get(place, 0) + size
    now, kept, dropped = time.time(), {}, []
    if old is not None:
        kept = {f: n for f, n in old.folders.items() if replaces is not None and f.partition("/")[2] not in replaces}
        dropped = old.dropped + [(f, number, now) for f in old.folders if f not in kept]
    done = _versions(spark, root, table)
    if retain_hours is None:
        dropped = [d for d in dropped if not done or d[1] > done[0]]  # earlier ones went when the layer was sealed
    else:
        for folder, _, _ in [d for d in dropped if now - d[2] > retain_hours * 3600]:
            files.delete(spark, f"{data}/{folder}")
        dropped = [d for d in dropped if now - d[2] <= retain_hours * 3600]
    path = f"{root}/{table}/v={number:06d}"
    files.write_text(spark, f"{path}/{LISTING}", json.dumps({
        "version": number, "schema": df.schema.jsonValue(), "by": by, "folders": kept | folders, "dropped": dropped, "facts": facts or {}}))
    files.touch(spark, f"{path}/_SUCCESS")
    if retain_hours is not None:
        for n in done[:-1]:
            files.delete(spark, f"{root}/{table}/v={n:06d}")
    return path


def publish(
    df: DataFrame, root: str, table: str, partition_by: list[str] | None = None, retain_hours: float | None = RETAIN_HOURS
) -> str:
    """Replace a whole table."""
    return commit(df, root, table, partition_by, None, retain_hours)


def current_path(spark: SparkSession, root: str, table: str) -> str | None:
    done = _versions(spark, root, table)
    if done:
        return f"{root}/{table}/v={done[-1]:06d}"
    return None


def read_folders(spark: SparkSession, root: str, table: str, found: Snapshot, folders: Collection[str]) -> DataFrame:
    """The rows of some folders of a snapshot."""
    if not folders:
        return spark.createDataFrame([], found.schema)
    data = f"{root}/{table}/data"
    whole = T.StructType([*found.schema.fields, T.StructField(WRITTEN, T.IntegerType())])
    return spark.read.schema(whole).option("basePath", data).parquet(*[f"{data}/{f}" for f in folders]).select(
        *[F.col(f"`{c}`") for c in found.schema.names])


def open_version(spark: SparkSession, path: str) -> DataFrame:
    """The table at the path of a version, or at a plain path."""
    found = _listed(spark, path)
    if found is None:
        return spark.read.parquet(path)
    root, table, _ = path.rsplit("/", 2)
    return read_folders(spark, root, table, found, found.folders).drop(*found.facts.get("hidden", []))


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    path = current_path(spark, root, table)
    return open_version(spark, path) if path else None


# -- consistent sets of tables ----------------------------------------------------------------
# <root>/_sealed/n=<n> lists the versions that belong together. Readers of a sealed layer see one set as a whole, the
# newest; versions that a failed build wrote, but no set lists, are seen by nobody.

def _sets(spark: SparkSession, root: str) -> list[str]:
    found = files.children(spark, f"{root}/_sealed")
    return [path for _, path, is_dir in found if is_dir and files.exists(spark, f"{path}/_SUCCESS")]


def _members(spark: SparkSession, path: str) -> dict[str, str]:
    return json.loads(files.read_text(spark, f"{path}/{LISTING}"))


def seal(spark: SparkSession, root: str, paths: Mapping[str, str], retain_hours: float = RETAIN_HOURS) -> None:
    """Make ``paths`` (table -> version) what readers of the layer see from now on.

    What only sets list that were replaced more than ``retain_hours`` ago is dropped: listings, and the folders that no
    later version has.
    """
    started = [int(n[2:]) for n, _, d in files.children(spark, f"{root}/_sealed") if d]
    own = f"{root}/_sealed/n={max(started, default=0) + 1:06d}"
    files.write_text(spark, f"{own}/{LISTING}", json.dumps({t: p.rsplit("/", 1)[-1] for t, p in paths.items()}))
    files.touch(spark, f"{own}/_SUCCESS")
    sets = _sets(spark, root)
    oldest = sets[-1]
    for path, newer in reversed(list(zip(sets, sets[1:]))):
        if time.time() - files.modified(spark, f"{newer}/_SUCCESS") > retain_hours * 3600:
            break
        oldest = path
    if oldest == sets[0]:
        return
    for table, version in _members(spark, oldest).items():
        first, newest = int(version[2:]), snapshot(spark, root, table)
        for folder, number, _ in newest.dropped if newest else []:
            if number <= first:
                files.delete(spark, f"{root}/{table}/data/{folder}")
        for n in _versions(spark, root, table):
            if n < first:
                files.delete(spark, f"{root}/{table}/v={n:06d}")
    for path in sets[:sets.index(oldest)]:
        files.delete(spark, path)


def sealed(spark: SparkSession, root: str) -> dict[str, str] | None:
    """Table name -> path of the newest set; None for a layer that was never sealed."""
    sets = _sets(spark, root)
    if not sets:
        return None
    return {t: f"{root}/{t}/{v}" for t, v in _members(spark, sets[-1]).items()}


# -- layers -----------------------------------------------------------------------------------

def discover(spark: SparkSession, root: str) -> dict[str, str]:
    """Table name -> path to read, for Parquet files, partitioned folders and versioned tables; of a sealed layer the
    tables of its newest set."""
    whole = sealed(spark, root)
    if whole is not None:
        return whole
    found: dict[str, str] = {}
    for name, path, is_dir in files.children(spark, root):
        table = name.removesuffix(".parquet")
        if not is_dir:
            if name.endswith(".parquet"):
                found[table] = path
            continue
        entries = files.children(spark, path)
        if any(n.startswith("v=") for n, _, _ in entries):
            versioned = current_path(spark, root, name)
            if versioned:
                found[table] = versioned
        elif entries:
            found[table] = path
    return found


class Layer(Mapping):
    """The tables of a layer by name. A table is opened when first used, and only once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark, self.paths = spark, discover(spark, root)
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = open_version(self._spark, self.paths[name])
        return self._open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.paths)

    def __len__(self) -> int:
        return len(self.paths)


def layer(spark: SparkSession, root: str) -> Layer:
    return Layer(spark, root)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, row_count): one count per table, side by side in one plan."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def profile(
    spark: SparkSession, tables: Mapping[str, DataFrame], samples: int = 0, order: Mapping[str, list[str]] | None = None
) -> DataFrame:
    """(table, ordinal, column, type, row_count) for every column of a layer; with ``samples``, also the column samples:
    the values, as text, of so many rows of its table, the same rows for all its columns: the first ones as they come, or
    in the ``order`` given for a table."""
    layout = [
        (name, i, field.name, field.dataType.simpleString())
        for name, df in tables.items() for i, field in enumerate(df.schema.fields)
    ]
    columns = spark.createDataFrame(layout, "table string, ordinal int, column string, type string")
    found = columns.join(row_counts(tables), "table")
    if not samples:
        return found
    values = reduce(DataFrame.unionByName, [_values(name, sample(df, samples, (order or {}).get(name)), (order or {}).get(name)) for name, df in tables.items()])
    return found.join(values, ["table", "ordinal"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def _values(name: str, df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(table, ordinal, samples) of a few rows; nulls stay in their place."""
    text = [df[f"`{c}`"].cast("string") for c in df.columns]
    at = [df[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(order or [])]
    found = F.collect_list(F.struct(*at, F.array(*text).alias("v")))
    row = df.select((F.array_sort(found) if order else found).alias("rows"))

    def values(i: int):
        return F.struct(F.lit(i).alias("ordinal"), F.transform("rows", lambda r: r["v"][i]).alias("samples"))

    per_column = F.array(*[values(i) for i in range(len(text))])
    return row.select(F.lit(name).alias("table"), F.explode(per_column).alias("c")).select("table", "c.ordinal", "c.samples")


def sample(df: DataFrame, rows: int = 5, order: list[str] | None = None) -> DataFrame:
    """A few rows: as they come, or the first in an order."""
    return (df.orderBy(*[F.col(f"`{c}`") for c in order]) if order else df).limit(rows)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """What a report returns when a table it needs has not been built."""
    return spark.createDataFrame([], schema)


def needs(schema: str, *names: str) -> Callable:
    """A report over ``names`` that comes back empty, with the columns of ``schema``, when one is not there."""
    def wrap(report: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(report)
        def run(gold: Mapping[str, DataFrame], *args, **options) -> DataFrame:
            if all(n in gold for n in names):
                return report(gold, *args, **options)
            return empty(SparkSession.active(), schema)
        return run
    return wrap

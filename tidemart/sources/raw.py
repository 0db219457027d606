"""Reading raw files: delimited text of mixed layouts, JSON records, Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemart.sources import files

LINEAGE = "source_file"
AUTO = "auto"  # an encoding that is found out


def lineage(root: str | None = None) -> Column:
    """Path of the file a row came from, below the folder it was read from."""
    path = F.col("_metadata.file_path")
    if root is None:
        return F.col("_metadata.file_name")
    name = root.rstrip("/").rsplit("/", 1)[-1]
    return F.substring_index(path, f"/{name}/", -1)


def _positions(names: tuple[str, ...]) -> list[tuple[str, list[str]]]:
    """Lower-cased column name -> the read names that carry it (a header may repeat a name)."""
    slots: dict[str, list[str]] = {}
    for i, name in enumerate(names):
        slots.setdefault(name.strip().lower() or f"_c{i}", []).append(f"c{i}")
    return list(slots.items())


def _either(value: Column) -> Column:
    """Text read byte by byte as Latin-1: what it is as UTF-8, where its bytes are that. Plain ASCII, which has as many
    bytes as characters, is left as it is."""
    as_utf8 = F.encode(value, "ISO-8859-1").cast("string")
    return F.when(F.octet_length(value) == F.length(value), value).when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(value)


def _either_name(name: str) -> str:
    try:
        return name.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return name


def _read_group(spark, paths, names, sep, encoding, root, multiline, keep_case) -> DataFrame:
    auto = encoding == AUTO
    schema = T.StructType([T.StructField(f"c{i}", T.StringType(), True) for i in range(len(names))])
    df = (
        spark.read.schema(schema)
        .option("header", True).option("sep", sep).option("encoding", "ISO-8859-1" if auto else encoding)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
        .csv(paths)
    )
    labels = {n.strip().lower() or f"_c{i}": n.strip() or f"_c{i}" for i, n in reversed(list(enumerate(names)))}
    columns = []
    for name, slots in _positions(names):
        values = [F.when(F.col(s) != "", _either(F.col(s)) if auto else F.col(s)) for s in slots]
        columns.append(F.coalesce(*values).alias(labels[name] if keep_case else name))
    return df.select(*columns, lineage(root).alias(LINEAGE))


def read_delimited(
    spark: SparkSession,
    root: str,
    pattern: str = "*",
    sep: str = ",",
    encoding: str = "UTF-8",
    multiline: bool = True,
    keep_case: bool = False,
) -> DataFrame | None:
    """All matching files of ``root`` as text columns, merged by column name.

    Files are grouped by header and each group is read on its own: one read over different
    headers would put values under the wrong names without an error. ``encoding="auto"`` reads UTF-8, and as
    Latin-1, which any bytes are, what is not: each value by its own bytes, in the one scan that reads it. None when
    nothing matches.

    A quoted value may hold line breaks, so a file is read by one task. ``multiline=False`` lets Spark cut large files
    that are known to have none.
    """
    paths = files.data_files(spark, root, pattern)
    if not paths:
        return None
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in zip(paths, files.headers(spark, paths, sep, "ISO-8859-1" if encoding == AUTO else encoding)):
        if names:
            found = tuple(_either_name(n).lstrip("\ufeff") for n in names) if encoding == AUTO else names
            groups.setdefault(found, []).append(path)
    if not groups:
        return None
    parts = [
        _read_group(spark, group, names, sep, encoding, root, multiline, keep_case)
        for names, group in groups.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON document holding an array of records (or one record per line, which it also reads)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, one file or a partitioned folder; partition columns come from the folder names."""
    return spark.read.parquet(path)


def read_upload(spark: SparkSession, path: str, **options) -> DataFrame:
    """An uploaded file, read by its suffix."""
    folder, _, name = path.rstrip("/").rpartition("/")
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        options.setdefault("encoding", "auto")
        options.setdefault("keep_case", True)
        df = read_delimited(spark, folder, name, sep="\t" if suffix == "tsv" else ",", **options)
        if df is None:
            raise FileNotFoundError(path)
        return df
    if suffix == "json":
        return read_json_records(spark, path)
    if suffix == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported file type: .{suffix}")


def coverage(df: DataFrame) -> DataFrame:
    """Rows per raw file and the columns each file fills."""
    names = [c for c in df.columns if c != LINEAGE]
    filled = df.groupBy(LINEAGE).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(c) for c in names]
    )
    present = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in names]), lambda c: c.isNotNull())
    return filled.select(
        LINEAGE, "row_count", F.size(present).alias("column_count"), F.array_join(present, ",").alias("columns")
    )

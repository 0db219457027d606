"""Session helpers: building one for local runs, the shared folder, and written cut points."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; on a cluster pass none and use its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are read and rendered in UTC, whatever the host says."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster session
    without it is refused, because a machine-local folder dies with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tidemart-")
        sc.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tidemart/{app}/{label}-{uuid.uuid4().hex[:12]}"


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder."""
    _delete(spark, f"{shared_dir(spark)}/tidemart/{spark.sparkContext.applicationId}")


_settled = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What ``settle`` writes inside is deleted at the end: for steps that write their result."""
    outer, _settled.paths = getattr(_settled, "paths", None), []
    try:
        yield
    finally:
        for path in _settled.paths:
            _delete(spark, path)
        _settled.paths = outer


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when their query ends, not when the driver's memory is next cleaned."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that later passes see the same rows in the same place even when an
    executor is lost in between. Parquet keeps later passes column-pruned.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    if getattr(_settled, "paths", None) is not None:
        _settled.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

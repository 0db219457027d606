"""The event stream into the lakehouse, in checkpointed micro-batches.

Every batch writes its raw rows under its own number and folds them into the silver tables by key.
Both can be repeated: a batch that runs again after a failure leaves the same tables, so with the
checkpointed offsets the effect is exactly once.

The file source follows whole files, so writers land finished files and do not append to them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemart.fixed_values import EVENT_ENTITIES
from tidemart.operators.silver import RULES, typed, unique_rows, valid_rows
from tidemart.plans import lakehouse
from tidemart.session import scratch_dir, scratch_scope
from tidemart.sources import files, keyed
from tidemart.sources.raw import LINEAGE
from tidemart.streaming import events as ev

GOLD = "gold"  # the mark of the batch that the gold tables are built from
_WITHIN = (1 << 33) - 1  # monotonically_increasing_id: the place in its partition


def _batch_name(batch_id: int) -> str:
    return f"batch={batch_id:012d}"


def land(batch: DataFrame, batch_id: int, root: str) -> dict[str, str]:
    """Write one batch: raw rows per entity, malformed lines, and counts per event type."""
    name = _batch_name(batch_id)
    if "file" in batch.columns:
        place = F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))
        batch = batch.select("value", F.concat_ws("_", "file", F.lpad(place.cast("string"), 12, "0")).alias(ev.ARRIVAL))
    parsed = ev.parse(batch).persist(StorageLevel.MEMORY_AND_DISK)
    written: dict[str, str] = {}
    try:
        counts = ev.type_counts(parsed)
        counts.write.mode("overwrite").parquet(f"{root}/metrics/{name}")
        present = {r.event_type for r in parsed.sparkSession.read.parquet(f"{root}/metrics/{name}")
                   .select("event_type").filter(F.col("event_type").isin(*EVENT_ENTITIES, ev.MALFORMED)).collect()}
        if ev.MALFORMED in present:
            ev.malformed(parsed).write.mode("overwrite").parquet(f"{root}/quarantine/{name}")
        routed = ev.route(ev.well_formed(parsed))
        written = {e: f"{root}/bronze/{e}/{name}" for kind, e in EVENT_ENTITIES.items() if kind in present}
        with ThreadPoolExecutor(max_workers=len(EVENT_ENTITIES)) as pool:
            list(pool.map(lambda e: routed[e].write.mode("overwrite").parquet(written[e]), written))
    finally:
        parsed.unpersist()
    return written


def fold(spark: SparkSession, root: str, entity: str, rows: DataFrame,
         as_of: date | datetime | str | None = None, log: str | None = None) -> str:
    """Merge raw rows, which carry their batch number, into a silver table.

    The result is the same as cleaning all rows ever seen at once, however they were split into batches: of two
    versions of a key the one that arrived later stays, by batch, file and place in the file. New rows are written once
    and meet the stored rows of the folders their keys fall into; all other folders stay as they are. ``log`` gets the
    months of the rows that came and went.
    """
    arrived = [F.col(ev.ARRIVAL)] if ev.ARRIVAL in rows.columns else []
    label = F.concat_ws("_", F.lit(f"{entity}_stream"), F.lpad(F.col("batch").cast("string"), 12, "0"), *arrived)
    path = scratch_dir(spark, f"fold-{entity}")
    valid_rows(entity, typed(entity, rows.withColumn(LINEAGE, label), as_of)).write.parquet(path)
    new = spark.read.parquet(path)
    keys, silver = RULES[entity].keys, lakehouse.silver_root(root)
    written = keyed.fold(
        new, silver, entity, keys, lambda both: unique_rows(entity, both), files.size(spark, path),
        before=(lambda stored: _note(spark, log, entity, new, stored)) if log else None)
    files.delete(spark, path)
    return written


def _note(spark: SparkSession, log: str, entity: str, new: DataFrame, stored: DataFrame | None) -> None:
    """Write down the months of new rows and of the rows they meet, before these go. A batch that runs again adds to what
    its first attempt wrote."""
    months = lakehouse.months_of(entity, new, *([] if stored is None else [stored]))
    if files.exists(spark, log):
        months |= set(json.loads(files.read_text(spark, log)))
    files.write_text(spark, log, json.dumps(sorted(months)))


def _logs(spark: SparkSession, root: str, entity: str) -> list[str]:
    return [path for _, path, _ in files.children(spark, f"{root}/changes/{entity}")]


def refresh_gold(
    spark: SparkSession, root: str, as_of: date | datetime | str | None = None, changed: Mapping[str, set[str]] | None = None
) -> DataFrame:
    run = lakehouse.Run(spark)
    lakehouse.build_gold(run, root, as_of, changed=changed)
    return run.report()


def _marked(spark: SparkSession, root: str, what: str) -> int:
    return max((int(n) for n, _, _ in files.children(spark, f"{root}/folded/{what}")), default=-1)


def _pending(spark: SparkSession, root: str, entity: str, last: int) -> list[str]:
    """Landed batches of an entity that its silver table does not hold yet, up to batch ``last``."""
    seen = _marked(spark, root, entity)
    paths = (f"{root}/bronze/{entity}/{_batch_name(n)}" for n in range(seen + 1, last + 1))
    return [p for p in paths if files.exists(spark, p)]


def _mark(spark: SparkSession, root: str, entity: str, last: int) -> None:
    marks = f"{root}/folded/{entity}"
    older = [path for _, path, _ in files.children(spark, marks)]
    files.touch(spark, f"{marks}/{last:012d}")
    for path in older:
        if not path.endswith(f"/{last:012d}"):
            files.delete(spark, path)


def process(batch: DataFrame, batch_id: int, root: str, as_of=None, refresh_every: int = 1) -> None:
    """One micro-batch. Silver and gold are brought up to date every ``refresh_every`` batches.

    A refresh rewrites the folders of silver that got rows, the months of the facts these belong to, and dimensions that
    changed; what it reads of silver to find the months of new keys are id columns. Landing costs only what the batch holds.
    """
    spark = batch.sparkSession
    land(batch, batch_id, root)
    if (batch_id + 1) % refresh_every == 0:
        catch_up(spark, root, batch_id, as_of)


def catch_up(spark: SparkSession, root: str, last: int, as_of=None) -> None:
    """Fold every landed batch up to ``last`` that is not in silver yet, then bring gold up to date if it is behind silver.

    Gold has a mark of its own: when a run dies between silver and gold, the next one builds gold even though no row is
    waiting. A gold table that fails raises, so the batch runs again.
    """
    waiting = {e: _pending(spark, root, e, last) for e in EVENT_ENTITIES.values()}
    waiting = {e: paths for e, paths in waiting.items() if paths}

    def bring(entity: str) -> None:
        rows = spark.read.option("basePath", f"{root}/bronze/{entity}").parquet(*waiting[entity])
        with scratch_scope(spark):
            fold(spark, root, entity, rows, as_of, f"{root}/changes/{entity}/{last:012d}")
        _mark(spark, root, entity, last)

    if waiting:
        with ThreadPoolExecutor(max_workers=len(waiting)) as pool:
            list(pool.map(bring, waiting))  # a failure here fails the batch, which then runs again
    newest = max(_marked(spark, root, e) for e in EVENT_ENTITIES.values())
    if newest > _marked(spark, root, GOLD):
        logs = {e: _logs(spark, root, e) for e in EVENT_ENTITIES.values()}
        changed = {e: {m for p in paths for m in json.loads(files.read_text(spark, p))} for e, paths in logs.items() if paths}
        failed = refresh_gold(spark, root, as_of, changed).filter("status like 'failed%'").collect()
        if failed:
            raise RuntimeError("; ".join(f"{r['table']}: {r['status']}" for r in failed))
        _mark(spark, root, GOLD, newest)
        for path in (p for paths in logs.values() for p in paths):
            files.delete(spark, path)


def start(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    interval: str | None = "10 seconds",
    as_of: date | datetime | str | None = None,
    refresh_every: int = 1,
    max_files: int | None = None,
) -> StreamingQuery:
    """Start following ``landing``. ``interval=None`` works off what is there and stops."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(landing)
    file = F.concat_ws(
        "_", F.lpad(F.unix_millis("_metadata.file_modification_time").cast("string"), 15, "0"), "_metadata.file_path",
        F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0"))
    writer = (
        lines.select("value", file.alias("file")).writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: process(batch, batch_id, root, as_of, refresh_every))
    )
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def run_available(
    spark: SparkSession, landing: str, root: str, checkpoint: str, as_of=None, refresh_every: int = 1,
    max_files: int | None = None,
) -> None:
    """Work off everything that has landed, fold what is left, and return."""
    query = start(spark, landing, root, checkpoint, None, as_of, refresh_every, max_files)
    query.awaitTermination()
    progress = query.lastProgress
    if progress is not None:
        catch_up(spark, root, int(progress["batchId"]), as_of)


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """Events per batch and type."""
    return spark.read.option("basePath", f"{root}/metrics").parquet(f"{root}/metrics")

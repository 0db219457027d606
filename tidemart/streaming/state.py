"""Streams that keep their state in Spark's state store: running totals, and order lines without repeats within a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemart.functions.columns import to_timestamp
from tidemart.schemas import SILVER
from tidemart.sources import files, tables
from tidemart.streaming import events as ev

TOTALS = "totals"
ORDER_KEY = ["transaction_id", "product_id"]


def lines(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(landing).select("value")


def _run(writer, interval: str | None) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


# -- running totals ---------------------------------------------------------------------------

def start_totals(
    spark: SparkSession, landing: str, root: str, checkpoint: str, interval: str | None = "10 seconds", max_files: int | None = None
) -> StreamingQuery:
    """Keep the number of events per type, of all that has landed, current under ``root``.

    The counts are the stream's state, so a restart goes on from them, and a batch that runs again gives the same totals
    and counts nothing twice. The state holds a row per event type.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        tables.publish(batch.withColumn("batch", F.lit(batch_id).cast("long")).coalesce(1), root, TOTALS)

    totals = ev.type_counts(ev.parse(lines(spark, landing, max_files)))
    return _run(totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write), interval)


def running_totals(spark: SparkSession, root: str) -> DataFrame:
    """event_type, events, and the batch after which these were the totals; empty before the first one."""
    found = tables.read_current(spark, root, TOTALS)
    return tables.empty(spark, "event_type string, events long, batch long") if found is None else found


# -- order lines once -------------------------------------------------------------------------

def order_lines_once(events: DataFrame, within: str) -> DataFrame:
    """Typed order lines of a stream of parsed events, each (transaction, product) once.

    A line that comes again no more than ``within`` of event time behind the newest event is a repeat and goes; the one
    that arrived first stays. So the result is that of the exact fold as long as sources deliver repeats unchanged, or
    later than the original, and within the bound. Keys are forgotten when the watermark has passed them, which bounds the
    state by the lines of that time; lines that are older still when they arrive are dropped as late. Lines without a
    readable time cannot be placed: they pass as they come.
    """
    kinds = {f.name: f.dataType for f in SILVER["transactions"]}
    rows = ev.order_lines(events).select(
        *[(to_timestamp(F.col(c)) if c == "timestamp" else F.col(c).try_cast(kinds[c])).alias(c) for c in kinds])
    timed = rows.filter("timestamp is not null").withWatermark("timestamp", within).dropDuplicatesWithinWatermark(ORDER_KEY)
    return timed.unionByName(rows.filter("timestamp is null"))


def start_order_lines(
    spark: SparkSession, landing: str, out: str, checkpoint: str, within: str, interval: str | None = "10 seconds",
    max_files: int | None = None,
) -> StreamingQuery:
    """Append the order lines of ``landing`` to the Parquet files at ``out``, each line once. The file sink lists what
    finished batches wrote, so a batch that runs again adds nothing."""
    once = order_lines_once(ev.well_formed(ev.parse(lines(spark, landing, max_files))), within)
    return _run(once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint), interval)


def read_order_lines(spark: SparkSession, out: str) -> DataFrame:
    if not files.exists(spark, out):
        return spark.createDataFrame([], SILVER["transactions"])
    return spark.read.parquet(out)

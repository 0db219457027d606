"""Event lines -> typed events -> rows of the raw entities. The same code serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemart.fixed_values import EVENT_ENTITIES
from tidemart.schemas import EVENT, SILVER

MALFORMED = "malformed"
ARRIVAL = "arrival"  # where a line stands in the stream, as text that sorts; optional


def parse(lines: DataFrame) -> DataFrame:
    """One row per line: the event's fields, and the line itself in `_corrupt` when it is not an event.

    Other columns of ``lines`` are kept."""
    event = F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # unfolding a list of one keeps later filters behind the parser; pushed before it, they would parse again
    parsed = lines.select("*", F.inline(F.array(event)))
    is_bad = F.col("_corrupt").isNotNull() | F.col("event_type").isNull()
    return parsed.withColumn("_corrupt", F.when(is_bad, F.col("value"))).drop("value")


def well_formed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def malformed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("line"))


def order_lines(events: DataFrame) -> DataFrame:
    """One row per product of an order; an order without products has none."""
    orders = events.filter("event_type = 'order_created'")
    more = _arrival(events)
    return orders.select("transaction_id", "user_id", "store_id", "timestamp", *more, F.explode("products").alias("p")).select(
        "transaction_id", "user_id", "p.product_id", "timestamp", "p.amount", "store_id", *more)


def _arrival(events: DataFrame) -> list[str]:
    return [ARRIVAL] if ARRIVAL in events.columns else []


def route(events: DataFrame) -> dict[str, DataFrame]:
    """Raw rows by entity. Events of other types go nowhere."""
    out = {}
    for event_type, entity in EVENT_ENTITIES.items():
        if entity == "transactions":
            out[entity] = order_lines(events)
        else:
            out[entity] = events.filter(F.col("event_type") == event_type).select(*SILVER[entity].names, *_arrival(events))
    return out


def type_counts(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("_corrupt").isNotNull(), F.lit(MALFORMED)).otherwise(F.col("event_type"))
    return events.groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("events"))

"""Raw rows -> typed, valid, unique silver rows, and a report of the rows left out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.fixed_values import TRANSACTION_DEFAULTS, TRANSACTION_SYNONYMS
from tidemart.functions.columns import to_type
from tidemart.operators.keys import keep_one, with_row_id
from tidemart.schemas import SILVER
from tidemart.sources.raw import LINEAGE


@dataclass(frozen=True)
class Rules:
    """How one silver table is made: its key, what makes a row valid, which duplicate stays."""

    keys: list[str]
    valid: list[tuple[str, Callable[[], Column]]]
    order: Callable[[bool], list[Column]]


def _latest(*more: Callable[[], Column]) -> Callable[[bool], list[Column]]:
    def order(has_lineage: bool) -> list[Column]:
        first = [F.col(LINEAGE).desc_nulls_last()] if has_lineage else []
        return first + [m() for m in more]
    return order


def _present(name: str) -> tuple[str, Callable[[], Column]]:
    return f"{name} is null", lambda: F.col(name).isNotNull()


def _positive(name: str) -> tuple[str, Callable[[], Column]]:
    return f"{name} is not positive", lambda: F.col(name) > 0


def _finite(name: str) -> tuple[str, Callable[[], Column]]:
    """Neither infinite nor NaN, which would swallow every sum; null is left to the other rules."""
    return f"{name} is not finite", lambda: F.coalesce(F.abs(F.col(name)) < float("inf"), F.lit(True))


RULES: dict[str, Rules] = {
    "transactions": Rules(
        ["transaction_id", "product_id"],
        [_present("transaction_id"), _present("product_id"), _positive("amount"), _finite("amount")],
        lambda _: [F.col("timestamp").asc_nulls_last()],
    ),
    "users": Rules(
        ["user_id"], [_present("user_id")], _latest(lambda: F.col("signup_date").desc_nulls_last()),
    ),
    "products": Rules(
        ["product_id"],
        [_present("product_id"), _positive("price"), _finite("price")],
        _latest(),
    ),
    "inventory": Rules(
        ["product_id", "store_id"],
        [_present("product_id"), _present("store_id"), ("stock is negative", lambda: F.col("stock_level") >= 0)],
        _latest(),
    ),
    "shipments": Rules(
        ["shipment_id"],
        [_present("shipment_id"),
         ("cost is negative", lambda: F.col("shipping_cost").isNull()
          | (F.col("shipping_cost") >= 0)), _finite("shipping_cost")],
        _latest(),
    ),
}


def _typed(df: DataFrame, name: str, kind) -> Column:
    have = {c.lower(): c for c in df.columns}
    if name not in have:
        return F.lit(None).cast(kind)
    source = df.schema[have[name]].dataType
    return to_type(F.col(have[name]), kind, source)


def type_transactions(raw: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Typed transaction columns, each from the first filled synonym the files carry."""
    schema = SILVER["transactions"]
    have = {c.lower(): c for c in raw.columns}

    def first_of(target: str) -> Column | None:
        kind = schema[target].dataType
        found = [_typed(raw, s, kind) for s in TRANSACTION_SYNONYMS[target] if s in have]
        return F.coalesce(*found) if found else None

    columns = {}
    for target in ("transaction_id", "user_id", "product_id", "store_id"):
        value = first_of(target)
        columns[target] = value if value is not None else F.lit(TRANSACTION_DEFAULTS.get(target))
    if first_of("transaction_id") is None:
        # no id anywhere: every line is an order of its own, equal lines too
        raw = with_row_id(raw, "_row_id")
        columns["transaction_id"] = F.col("_row_id")
    stamp = first_of("timestamp")
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    columns["timestamp"] = stamp if stamp is not None else now
    columns["amount"] = derive_amount(raw)
    extra = [F.col(LINEAGE)] if LINEAGE in raw.columns else []
    return raw.select(*[columns[f.name].alias(f.name) for f in schema], *extra)


def derive_amount(raw: DataFrame) -> Column:
    """amount, else price x quantity, else price, else total, else 0."""
    have = {c.lower() for c in raw.columns}
    kind = SILVER["transactions"]["amount"].dataType

    def number(name: str) -> Column:
        return _typed(raw, name, kind)

    tries = []
    if "amount" in have:
        tries.append(number("amount"))
    if {"price", "quantity"} <= have:
        tries.append(number("price") * number("quantity"))
    if "price" in have:
        tries.append(number("price"))
    if "total" in have:
        tries.append(number("total"))
    return F.coalesce(*tries, F.lit(0.0))


def typed(entity: str, raw: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Every raw row with the silver columns and types (nothing removed yet)."""
    if entity == "transactions":
        return type_transactions(raw, as_of)
    columns = {f.name: _typed(raw, f.name, f.dataType) for f in SILVER[entity]}
    if entity == "users":
        columns["city"] = F.coalesce(columns["city"], F.lit("Unknown"))
    extra = [F.col(LINEAGE)] if LINEAGE in raw.columns else []
    return raw.select(*[c.alias(name) for name, c in columns.items()], *extra)


def valid_rows(entity: str, rows: DataFrame) -> DataFrame:
    for _, holds in RULES[entity].valid:
        rows = rows.filter(holds())
    return rows


def unique_rows(entity: str, rows: DataFrame) -> DataFrame:
    """One row per key. Applying it again to its own result plus later rows gives what applying it
    once to all rows gives, so batches can be folded in one by one."""
    rules = RULES[entity]
    return keep_one(rows, rules.keys, rules.order(LINEAGE in rows.columns))


def clean(entity: str, raw: DataFrame, as_of: datetime | str | None = None, keep_lineage: bool = False) -> DataFrame:
    """A silver table from its raw rows."""
    rows = unique_rows(entity, valid_rows(entity, typed(entity, raw, as_of)))
    return rows if keep_lineage else rows.select(*SILVER[entity].names)


def rejected(entity: str, raw: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """The rows ``clean`` leaves out as invalid, with the first rule each one breaks."""
    reason = F.lit(None).cast("string")
    for text, holds in reversed(RULES[entity].valid):
        reason = F.when(F.coalesce(holds(), F.lit(False)), reason).otherwise(F.lit(text))
    return typed(entity, raw, as_of).withColumn("reason", reason).filter(F.col("reason").isNotNull())


def reject_counts(raws: dict[str, DataFrame], as_of: datetime | str | None = None) -> DataFrame:
    """(entity, reason, rows) over several raw tables."""
    out = None
    for entity, raw in raws.items():
        part = (
            rejected(entity, raw, as_of).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(entity).alias("entity"), "reason", "rows")
        )
        out = part if out is None else out.unionByName(part)
    return out

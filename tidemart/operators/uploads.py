"""Bringing files with foreign headers to the layout of the raw layer.

Decisions are taken on column names, which the driver has; the rows only see the resulting select.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemart import fixed_values as fixed
from tidemart.functions.columns import to_type
from tidemart.operators.keys import keep_one, with_row_id
from tidemart.operators.silver import derive_amount
from tidemart.sources.raw import LINEAGE


# -- deciding ------------------------------------------------------------------------------

def standard_names(headers: list[str]) -> dict[str, str]:
    """header -> standard name by pattern, else the header in snake case."""
    out = {}
    for h in headers:
        key = h.lower().strip()
        known = (std for pattern, std in fixed.UPLOAD_HEADER_PATTERNS if re.match(pattern, key))
        out[h] = next(known, None) or re.sub(r"\W", "_", h.lower()).strip("_")
    return out


def recommended_names(headers: list[str]) -> dict[str, str]:
    """standard name -> the first header that looks like it."""
    out = {}
    for std, patterns in fixed.RECOMMENDED_HEADER_PATTERNS.items():
        hit = next((h for h in headers if any(re.search(p, h.lower()) for p in patterns)), None)
        if hit is not None:
            out[std] = hit
    return out


def kind_by_name(name: str) -> str | None:
    """A quantity must be a word of its own, so that `Country` and `Discount` are not taken for counts."""
    lowered = name.lower()
    words = re.split(r"[^a-z]+", lowered)
    for label, patterns in fixed.COLUMN_KIND_PATTERNS.items():
        if any(re.match(p, lowered) and (label != "quantity" or p.strip(".*") in words) for p in patterns):
            return label
    return None


def column_kind(name: str, kind: T.DataType | None = None) -> str:
    """id, price, quantity, date, category, name, email or phone by name, else by data type."""
    label = kind_by_name(name)
    if label:
        return label
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def rule_names(schema: T.StructType) -> dict[str, str]:
    """header -> standard name, from the kind of each column."""
    out = {}
    for field in schema:
        if field.name == LINEAGE:
            continue
        lowered = field.name.lower()
        kind = column_kind(field.name, field.dataType)
        std = {"price": "amount", "quantity": "quantity", "date": "timestamp", "category": "category"}.get(kind)
        words = {"id": fixed.ID_WORDS, "name": fixed.NAME_WORDS}.get(kind, [])
        if kind == "string" and "country" in lowered:
            std = "store_id"
        for target, parts in words:
            if std is None and any(p in lowered for p in parts):
                std = target
        if std:
            out[field.name] = std
    return out


def mapping_for(df: DataFrame, strategy: str = "standard") -> dict[str, str]:
    """header -> standard name by one of the three ways above."""
    headers = [c for c in df.columns if c != LINEAGE]
    if strategy == "standard":
        return standard_names(headers)
    if strategy == "recommend":
        return {h: std for std, h in reversed(recommended_names(headers).items())}
    if strategy == "rules":
        return rule_names(df.schema)
    raise ValueError(f"unknown mapping strategy: {strategy}")


def _mentions(headers: list[str], words: dict[str, list[str]]) -> set[str]:
    lowered = [h.lower() for h in headers]
    return {what for what, parts in words.items() if any(p in h for p in parts for h in lowered)}


def scanned_entity(headers: list[str]) -> str:
    """What a scanned file most likely holds: transactions, users, products or unknown."""
    seen = _mentions(headers, fixed.SCAN_ENTITY_WORDS)
    if "transaction" in seen:
        return "transactions"
    if "product" in seen:
        return "products"
    return "users" if "user" in seen else "unknown"


def upload_entity(headers: list[str]) -> str:
    """Where an uploaded file goes: a raw entity, `combined`, or `unknown`."""
    seen = _mentions(headers, fixed.UPLOAD_ENTITY_WORDS)
    if {"transaction", "product", "user"} <= seen:
        return "combined"
    if "transaction" in seen:
        return "transactions"
    if "user" in seen and "product" not in seen:
        return "users"
    if "product" in seen:
        return "inventory" if "inventory" in seen else "products"
    if "shipment" in seen:
        return "shipments"
    return "inventory" if "inventory" in seen else "unknown"


# -- applying ------------------------------------------------------------------------------

def rename(df: DataFrame, mapping: dict[str, str], source: str | None = None) -> DataFrame:
    """Columns under their new names; headers mapped to the same name are coalesced left to right.

    With ``source`` the rows also carry where they came from (`data_source`, `source_file`).
    """
    target: dict[str, list[str]] = {}
    for c in df.columns:
        if c != LINEAGE:
            target.setdefault(mapping.get(c, c), []).append(c)
    columns = []
    for name, sources in target.items():
        values = [F.col(f"`{c}`") for c in sources]
        if len(values) > 1:
            same = len({df.schema[c].dataType for c in sources}) == 1
            value = F.coalesce(*(values if same else [v.cast("string") for v in values]))
        else:
            value = values[0]
        columns.append(value.alias(name))
    if source is not None:
        columns.append(F.lit(source).alias("data_source"))
    if LINEAGE in df.columns:
        columns.append(F.col(LINEAGE))
    return df.select(*columns)


def derive(df: DataFrame, as_text: bool = True) -> DataFrame:
    """amount from price and quantity, and store_id from country, where they are missing."""
    have = set(df.columns)
    if "amount" in have or "price" in have:
        text = "amount" not in have or isinstance(df.schema["amount"].dataType, T.StringType)
        amount = derive_amount(df)
        df = df.withColumn("amount", amount.cast("string") if as_text and text else amount)
    if "store_id" not in have:
        country = F.col("country") if "country" in have else F.lit(None)
        df = df.withColumn("store_id", F.coalesce(country, F.lit(fixed.TRANSACTION_DEFAULTS["store_id"])))
    return df


def fill_required(df: DataFrame, entity: str, as_of: datetime | str | None = None) -> DataFrame:
    """Constants, and ids of their own for every row, for the required columns a file lacks. Run it after ``derive``."""
    columns = {}
    named = list(df.columns)
    if any("{n}" in default and name not in named for name, default in fixed.UPLOAD_DEFAULTS.get(entity, {}).items()):
        df = with_row_id(df, "_row_id")
    for name, default in fixed.UPLOAD_DEFAULTS.get(entity, {}).items():
        if name in df.columns:
            continue
        if "{n}" in default:
            columns[name] = F.concat(F.lit(default.replace("{n}", "")), F.col("_row_id"))
        elif default == "{as_of}":
            now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
            columns[name] = F.date_format(now, "yyyy-MM-dd" if name == "signup_date" else "yyyy-MM-dd HH:mm:ss")
        else:
            columns[name] = F.lit(default)
    return df.withColumns(columns).drop("_row_id") if columns else df


def missing_required(df: DataFrame, entity: str) -> list[str]:
    """Required columns a mapped file neither has nor lets us derive."""
    have = set(df.columns)
    derivable = {"amount"} if "price" in have else set()
    return [c for c in fixed.REQUIRED_COLUMNS.get(entity, []) if c not in have | derivable]


def check_required(df: DataFrame, entity: str) -> DataFrame:
    missing = missing_required(df, entity)
    if missing:
        raise ValueError(f"{entity} upload lacks required columns: {', '.join(missing)}")
    return df


def split_combined(df: DataFrame, as_of: datetime | str | None = None) -> dict[str, DataFrame]:
    """One wide file -> its users, products and transactions."""
    def columns(part: str) -> list[str]:
        return [c for c in df.columns if any(p in c.lower() for p in fixed.COMBINED_PARTS[part])]

    out: dict[str, DataFrame] = {}
    if "user_id" in df.columns:
        users = keep_one(df.select(*columns("users")), ["user_id"], [])
        out["users"] = fill_required(users, "users", as_of) if "signup_date" not in users.columns else users
    if "product_id" in df.columns:
        out["products"] = keep_one(df.select(*columns("products")), ["product_id"], [])
    if columns("transactions"):
        out["transactions"] = df.select(*columns("transactions"))
    return out


def best_effort(df: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """A transaction table from a file of unknown shape: an id-like column and the first number."""
    names = [c for c in df.columns if c != LINEAGE]
    id_column = next((c for w in fixed.UNKNOWN_FILE_ID_WORDS for c in names if w in c.lower()), None)
    numeric = next((f.name for f in df.schema if f.name in names and isinstance(f.dataType, T.NumericType)), None)
    if id_column is None:
        df = with_row_id(df, "_row_id")
    ids = F.col(f"`{id_column}`").cast("string") if id_column else F.concat(F.lit("TXN_"), F.col("_row_id"))
    amount = F.col(f"`{numeric}`").cast("double") if numeric else F.lit(1.0)
    return fill_required(
        df.select(ids.alias("transaction_id"), amount.alias("amount")), "transactions", as_of
    )


def infer_numbers(df: DataFrame) -> DataFrame:
    """Text columns whose every filled value is a number become doubles (one pass to find them)."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != LINEAGE]
    if not names:
        return df
    number = {c: to_type(F.col(f"`{c}`"), T.DoubleType()) for c in names}
    checks = df.agg(*[
        (F.count(number[c]) == F.count(F.col(f"`{c}`"))).alias(f"a{i}") for i, c in enumerate(names)
    ], *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)]).first()
    numeric = {c for i, c in enumerate(names) if checks[f"a{i}"] and checks[f"n{i}"]}
    return df.withColumns({c: number[c] for c in numeric}) if numeric else df


def normalize_upload(df: DataFrame, as_of: datetime | str | None = None) -> dict[str, DataFrame]:
    """Raw tables an uploaded file of any known shape turns into."""
    headers = [c for c in df.columns if c != LINEAGE]
    entity = upload_entity(headers)
    if entity == "unknown":
        return {"transactions": best_effort(infer_numbers(df), as_of)}
    named = derive(rename(df, standard_names(headers)))
    return split_combined(named, as_of) if entity == "combined" else {entity: named}


def mapped_upload(
    df: DataFrame, entity: str, mapping: dict[str, str], as_of: datetime | str | None = None
) -> DataFrame:
    """An upload with a confirmed mapping (standard name -> header): rename, check, derive, fill."""
    # one header may serve several targets, such as amount and price
    chosen = [F.col(f"`{h}`").alias(std) for std, h in mapping.items()]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in set(mapping.values()) and c not in mapping]
    named = check_required(df.select(*chosen, *rest), entity)
    if entity == "transactions":
        named = derive(named)
    return fill_required(named, entity, as_of)


def ingest_dataset(df: DataFrame, source: str, strategy: str = "rules") -> DataFrame:
    """A folder of files through one normalizer, with provenance columns."""
    return rename(df, mapping_for(df, strategy), source=source)

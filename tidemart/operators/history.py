"""Customer history (slowly changing dimension, type 2) and keyed merges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemart.operators.keys import dense_key, keep_one
from tidemart.session import settle

COLUMNS = ["surrogate_key", "user_id", "name", "email", "city", "effective_date", "end_date", "is_current"]


def first_load(users: DataFrame) -> DataFrame:
    """Every user is current since signup."""
    keyed = dense_key(users, ["user_id"], "surrogate_key")
    return keyed.select(
        "surrogate_key", "user_id", "name", "email", "city",
        F.col("signup_date").alias("effective_date"),
        F.lit(None).cast("date").alias("end_date"),
        F.lit(True).alias("is_current"),
    )


@dataclass(frozen=True)
class Changes:
    """What a snapshot does to the history. Closed versions that are already there stay as they are."""

    changed: DataFrame  # written: one row per version that was closed or opened, or a user that left
    kept: DataFrame  # current versions that stay current
    closed: DataFrame  # versions that end now
    opened: DataFrame  # versions that begin now, numbered


def changes(
    existing: DataFrame,
    incoming: DataFrame,
    as_of: date | str | None = None,
    tracked: tuple[str, ...] = ("city",),
    drop_missing: bool = False,
) -> Changes:
    """Compare a user snapshot with the history.

    A change in a ``tracked`` column closes the current version at ``as_of`` and opens a new one; a
    change elsewhere alone does not. Users missing from the snapshot stay current, unless
    ``drop_missing``. New versions take the keys after the highest one, in user order, and users seen
    for the first time those after them. Applying the same snapshot twice changes nothing.

    One join of current rows with the snapshot classifies every user. Only what changes is written and
    numbered; the rest of the current rows is what the anti join with it leaves.
    """
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    current = existing.filter("is_current").select(*COLUMNS)
    have = current.select(*[F.col(c).alias(f"old_{c}") for c in COLUMNS])
    come = incoming.select(*[F.col(c).alias(f"new_{c}") for c in ("user_id", "name", "email", "city", "signup_date")])
    both = have.join(come, F.col("old_user_id") == F.col("new_user_id"), "full_outer")

    known, arrived = F.col("old_user_id").isNotNull(), F.col("new_user_id").isNotNull()
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))

    old = [F.col(f"old_{c}").alias(c) for c in ("user_id", "name", "email", "city")]
    fresh = [F.col(f"new_{c}").alias(c) for c in ("user_id", "name", "email", "city")]

    def version(key, columns, effective, end, current, group):
        return F.struct(
            key.cast("int").alias("surrogate_key"), *columns, effective.cast("date").alias("effective_date"),
            end.cast("date").alias("end_date"), F.lit(current).alias("is_current"), F.lit(group).alias("_group"),
        )

    none = F.lit(None)
    closed = version(F.col("old_surrogate_key"), old, F.col("old_effective_date"), today, False, 0)
    reopened = version(none, fresh, today, none, True, 1)
    first = version(none, fresh, F.col("new_signup_date"), none, True, 2)
    left = version(F.col("old_surrogate_key"), old, F.col("old_effective_date"), none, True, 3)
    rows = (
        F.when(known & arrived & ~same, F.array(closed, reopened))
        .when(arrived & ~known, F.array(first))
        .when(known & ~arrived & F.lit(drop_missing), F.array(left))
    )
    changed = settle(both.select(F.explode(rows).alias("r")).select("r.*"), "history")

    new = changed.filter("_group in (1, 2)")
    if drop_missing:
        # only then can a user have history but no current row; such a user is not a new one
        seen = existing.select("user_id").distinct()
        back = new.filter("_group = 2").join(seen, "user_id", "left_anti")
        new = new.filter("_group = 1").unionByName(back)
    highest = existing.agg(F.max("surrogate_key")).first()[0] or 0
    numbered = dense_key(new.drop("surrogate_key"), ["_group", "user_id"], "surrogate_key", base=highest)
    ended = changed.filter("_group in (0, 3)").select("surrogate_key")
    return Changes(
        changed, current.join(ended, "surrogate_key", "left_anti").select(*COLUMNS),
        changed.filter("_group = 0").select(*COLUMNS), numbered.select(*COLUMNS))


def merge(
    existing: DataFrame,
    incoming: DataFrame,
    as_of: date | str | None = None,
    tracked: tuple[str, ...] = ("city",),
    drop_missing: bool = False,
) -> DataFrame:
    """The whole history after a user snapshot; see ``changes``."""
    found = changes(existing, incoming, as_of, tracked, drop_missing)
    return (
        found.kept.unionByName(found.closed).unionByName(found.opened)
        .unionByName(existing.filter(~F.col("is_current")).select(*COLUMNS))
    )


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` replace the rows with the same key and add the rest. Of several changes of a key the smallest row counts."""
    once = keep_one(changes, keys, [])
    return table.join(once.select(*keys), keys, "left_anti").unionByName(once)


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")

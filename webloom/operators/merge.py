"""Table maintenance as pure functions of the old rows and the updates.

Each takes DataFrames and returns the new rows; a store gives it the partitions that the updates touch and
writes those. `seq` orders the updates, so the result does not hang on the order in which rows arrive.
Grouping by key comes first, so a key that is written very often costs one pre-aggregated row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_columns(old: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], now: Column, seq: str = "seq") -> DataFrame:
    """Partial update: of each key's updates, the last value given for a column replaces the old one.

    A null in `updates` means that the column was not given. A key that is new gets first_seen and
    last_checked; one that is known gets last_checked, unless nothing was given for it.
    """
    given = F.greatest(*[F.col(c).isNotNull().cast("int") for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNotNull().cast("int")
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"new_{c}") for c in columns]
    latest = updates.groupBy(key).agg(F.max(given).alias("_given"), *last).withColumn("_update", F.lit(True))
    both = old.join(latest, key, "full_outer")
    merged = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in columns}
    changed = F.col("_update") & ((F.col("_given") == 1) | F.col("first_seen").isNull())
    merged["last_checked"] = F.when(changed, now).otherwise(F.col("last_checked"))
    merged["first_seen"] = F.coalesce("first_seen", now)
    return both.select(key, *[merged.get(c, F.col(c)).alias(c) for c in old.columns if c != key])


def replace_rows(old: DataFrame, writes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Insert or replace: the last write of each key wins, whole."""
    columns = [c for c in old.columns if c != key]
    rows = old.select(key, F.lit(None).cast("long").alias(seq), F.struct(*columns).alias("row"))
    rows = rows.unionByName(writes.select(key, F.col(seq).cast("long").alias(seq), F.struct(*columns).alias("row")))
    won = rows.groupBy(key).agg(F.max_by("row", F.coalesce(F.col(seq), F.lit(-(2**63)))).alias("row"))
    return won.select(key, "row.*").select(*old.columns)


def keep_first(old: DataFrame, writes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Insert or ignore: a key that is known stays as it is, of new ones the first write counts."""
    columns = [c for c in old.columns if c != key]
    first = writes.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(seq)).alias("row"))
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(key, "row.*"))


def add_counts(old: DataFrame, occurrences: DataFrame, keys: Sequence[str] = ("src", "dst"), weight: str = "weight") -> DataFrame:
    """Counter upsert: each occurrence adds one to its key's weight."""
    return add_weights(old, occurrences.select(*keys, F.lit(1).alias(weight)), keys, weight)


def add_weights(old: DataFrame, counted: DataFrame, keys: Sequence[str] = ("src", "dst"), weight: str = "weight") -> DataFrame:
    """Counter upsert of occurrences that are counted already."""
    rows = [x.select(*keys, F.col(weight).cast("long").alias(weight)) for x in (old, counted)]
    return rows[0].unionByName(rows[1]).groupBy(*keys).agg(F.sum(weight).alias(weight))


def update_known(old: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Keyed update: rows of known keys take all `columns` of their update, defaults where it is null;
    updates of unknown keys have no effect. One update a key."""
    defaults = defaults or {}
    new = updates.select(key, *[F.coalesce(F.col(c), defaults[c]).alias(f"new_{c}") if c in defaults else F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = old.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])

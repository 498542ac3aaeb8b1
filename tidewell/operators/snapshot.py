"""Differences between what a source holds now and what was recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """`key`, delta: added, changed, removed or unchanged.

    `previous` has `present`; what was absent and still is gives no row, what was absent and
    is back counts as added.  Changed means that any of the compared columns differs, nulls
    included.  One full outer join on the key.
    """
    old = previous.select(*key, F.col("present").alias("was"), *(F.col(c).alias(f"old_{c}") for c in compared))
    new = current.select(*key, F.lit(True).alias("now"), *(F.col(c).alias(f"new_{c}") for c in compared))
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    label = F.when(now & ~was, "added").when(now & differs, "changed").when(now, "unchanged").otherwise("removed")
    return old.join(new, key, "full_outer").where(now | was).select(*key, label.alias("delta"))


def counts(delta: DataFrame) -> DataFrame:
    return delta.groupBy("delta").agg(F.count("*").alias("n"))


def scan_counts(delta: DataFrame, queued: DataFrame) -> DataFrame:
    """(name, n): one row for each kind of change and one for what was queued, also where there is none."""
    kinds = ("added", "changed", "removed", "unchanged")
    held = delta.agg(*(F.count_if(F.col("delta") == k).alias(k) for k in kinds)).crossJoin(queued.agg(F.count("*").alias("queued")))  # one row each
    return held.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in (*kinds, "queued")))))


def merge(previous: DataFrame, current: DataFrame, key: list[str], now) -> DataFrame:
    """The next snapshot: listed rows are present with new values and keep `created_at`; others stay, absent."""
    values = [c for c in current.columns if c not in key]
    old = previous.select(*key, F.col("created_at").alias("old_created"), F.col("updated_at").alias("old_updated"), F.col("present").alias("was"), *(F.col(c).alias(f"old_{c}") for c in values))
    new = current.withColumn("listed", F.lit(True))
    joined = old.join(new, key, "full_outer")
    listed = F.coalesce("listed", F.lit(False))
    touched = listed | F.coalesce("was", F.lit(False))
    return joined.select(
        *key, *(F.when(listed, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in values), listed.alias("present"),
        F.coalesce("old_created", now).alias("created_at"), F.when(touched, now).otherwise(F.col("old_updated")).alias("updated_at"),
    )


def removed(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    return previous.where("present").join(current.select(*key), key, "left_anti")

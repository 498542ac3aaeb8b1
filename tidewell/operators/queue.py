"""The review queue: enqueued once, then the fold of its events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The state each event leads to, from any state.
LEADS_TO = {"enqueue": "discovered", "retry": "discovered", "approve": "approved", "skip": "skipped", "fail": "failed", "complete": "completed"}
CLEARS = ("approve", "skip", "retry", "complete")


def gate(delta: DataFrame, sources: DataFrame) -> DataFrame:
    """Changes that may be queued: none of disabled or scan-only sources, and only added or changed ones."""
    allowed = sources.where(F.col("policy") == "review").select("source_id", "policy")
    return delta.where(F.col("delta").isin("added", "changed")).join(allowed, "source_id")


def enqueue_once(candidates: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """Candidates whose key was never queued, each once."""
    return candidates.dropDuplicates([key]).join(queue.select(key), key, "left_anti")


def fold(events: DataFrame, key: str, order: str) -> DataFrame:
    """State of each item after its events (event, error, bundle_id), taken in `order`, which is total per key.

    The last event decides the state; failures add up and are never reset; the last error is
    that of the last event that sets or clears it; the bundle is the last one named.  All are
    map-side combined aggregates.
    """
    state = F.coalesce(*(F.when(F.col("event") == e, s) for e, s in LEADS_TO.items()))
    error = F.when(F.col("event") == "fail", F.col("error"))
    sets = F.col("event").isin("fail", *CLEARS)
    return events.groupBy(key).agg(
        F.max_by(state, order).alias("state"),
        F.count_if(F.col("event") == "fail").alias("attempts"),
        F.max_by(error, F.when(sets, F.col(order))).alias("last_error"),
        F.max_by("bundle_id", F.when(F.col("bundle_id").isNotNull(), F.col(order))).alias("bundle_id"),
        F.min(order).alias("first_seen"), F.max(order).alias("last_seen"),
    )


#: States, errors and bundles of a part of the events, each with the place it was taken at.
_AT = ("state_at", "error_at", "bundle_at")


def partial(events: DataFrame, key: str, order: str, *facts: str) -> DataFrame:
    """Folds of any part of the events, one row a key, that `merged` joins and `finished` reads.

    State, last error and last bundle are kept with the place in `order` they come from, so
    parts may overlap in time and be joined in any way.  `facts` are columns of which a key has
    one value or none.
    """
    at = lambda value, when: F.max(F.when(when, F.struct(F.col(order).alias("at"), value.alias("value"))))
    state = F.coalesce(*(F.when(F.col("event") == e, s) for e, s in LEADS_TO.items()))
    error = F.when(F.col("event") == "fail", F.col("error"))
    return events.groupBy(key).agg(
        at(state, F.col(order).isNotNull()).alias("state_at"), F.count_if(F.col("event") == "fail").alias("attempts"),
        at(error, F.col("event").isin("fail", *CLEARS)).alias("error_at"), at(F.col("bundle_id"), F.col("bundle_id").isNotNull()).alias("bundle_at"),
        F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), *(F.max(c).alias(c) for c in facts),
    )


def merged(parts: DataFrame, key: str, *facts: str) -> DataFrame:
    """One row a key of several `partial` folds; each event must be in one of them only."""
    return parts.groupBy(key).agg(
        *(F.max(c).alias(c) if c != "attempts" else F.sum(c).alias(c) for c in ("state_at", "attempts", "error_at", "bundle_at")),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *(F.max(c).alias(c) for c in facts),
    )


def finished(parts: DataFrame) -> DataFrame:
    """What `fold` gives, from merged parts."""
    values = {"state": F.col("state_at.value"), "last_error": F.col("error_at.value"), "bundle_id": F.col("bundle_at.value")}
    others = [c for c in parts.columns if c not in _AT]
    return parts.select(*others, *(v.alias(k) for k, v in values.items()))


def listing(rows: DataFrame, *order: str, **equal) -> DataFrame:
    """Rows that match the given values, in ascending order."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(*order)


def named(rows: DataFrame, key, name: str, by_key: str = "id", by_name: str = "name") -> DataFrame:
    """All rows of that key or of that name."""
    return rows.where((F.col(by_key) == key) | (F.col(by_name) == name))


def find(rows: DataFrame, wanted: str, key: str = "id", name: str = "name") -> DataFrame:
    """The row of that key, or else of that name."""
    hit = rows.where((F.col(key) == wanted) | (F.col(name) == wanted))
    return hit.orderBy((F.col(key) != wanted).cast("int"), name, key).limit(1)


def approved_unchanged(queue: DataFrame, items: DataFrame) -> DataFrame:
    """Approved entries with `status`: ready, or changed if the content differs from what was approved, or missing."""
    now = items.select(F.col("id").alias("source_item_id"), F.col("sha256").alias("digest"), "present")
    joined = queue.where(F.col("state") == "approved").join(now, "source_item_id", "left")
    status = F.when(~F.coalesce("present", F.lit(False)), "missing").when(F.col("digest") == F.col("content_sha256"), "ready").otherwise("changed")
    return joined.withColumn("status", status).drop("digest", "present")

"""The queue over streams: enqueue once, and the fold of events as they come (an addition of this package)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import queue
from ..operators.queue import CLEARS, LEADS_TO
from ..shipping import ship

STATE = "state string, attempts bigint, last_error string, bundle_id string, seq bigint"


def enqueue_once(changes: DataFrame, key: list[str], time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each key of a stream once; with an event time, keys are forgotten `delay` after it."""
    if time is None:
        return changes.dropDuplicates(key)
    return changes.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def fold(events: DataFrame, key: str) -> DataFrame:
    """(key, state, attempts, last_error, bundle_id, seq) after each batch of events (key, event, error, bundle_id, seq).

    State per key is five scalars.  Within a batch events are taken by `seq`; a late one, below
    what its key has seen, adds to the failures but changes nothing else.
    """
    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, attempts, error, bundle, seen = held.get if held.exists else (None, 0, None, None, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        for r in rows.itertuples():
            attempts += r.event == "fail"
            if r.seq <= seen:
                continue
            seen, state = r.seq, LEADS_TO.get(r.event, state)
            if r.event == "fail":
                error = r.error
            elif r.event in CLEARS:
                error = None
            bundle = bundle if pd.isna(r.bundle_id) else r.bundle_id
        held.update((state, int(attempts), error, bundle, int(seen)))
        yield pd.DataFrame({key: [group[0]], "state": [state], "attempts": [attempts], "last_error": [error], "bundle_id": [bundle], "seq": [seen]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def exact_fold(events: DataFrame, key: str, order: str, time: str | None = None, delay: str = "30 days") -> DataFrame:
    """The rows of `queue.fold` for a stream, whatever order events come in and however often.

    Events are told apart by (key, order); a repeated one is dropped.  State is the fold itself,
    aggregates that take events in any order, so a late event finds its place.  Both are built-in
    operators with incremental state.  With an event time, an event's number is forgotten
    `delay` after it, which bounds the numbers that are held; a repetition must come sooner.
    """
    once = events.dropDuplicates([key, order]) if time is None else events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key, order])
    return queue.fold(once, key, order)


def keep_latest(folded: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing each batch's changed keys below `path`; a batch that is run again writes the same place again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = folded.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def latest(written: DataFrame, key: str) -> DataFrame:
    """The last row of each key among batches that `keep_latest` wrote."""
    others = [c for c in written.columns if c not in (key, "batch")]
    return written.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(key, "last.*")

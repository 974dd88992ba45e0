"""The queue as a stream: leases and retries held in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import LEASE_SECONDS, MAX_ATTEMPTS

EVENTS = "item_id long, event string, at double"
_STATE = "status string, attempts int, lease_until double"
_OUT = "item_id long, status string, attempts int, lease_until double, at double"


def step(state: tuple[str, int, float], event: str, at: float, lease: float = LEASE_SECONDS, most: int = MAX_ATTEMPTS) -> tuple[str, int, float]:
    """An item's state after an event: submit, claim, done, verification_failed, permanent, transient or cancel."""
    status, attempts, until = state
    expired = status == "processing" and until < at
    if event == "claim" and (status == "queued" or expired):
        return ("failed", attempts + 1, 0.0) if attempts >= most else ("processing", attempts + 1, at + lease)
    if event == "cancel" and status == "queued":
        return "cancelled", attempts, 0.0
    if status == "processing" and event in ("done", "verification_failed"):
        return event, attempts, 0.0
    if status == "processing" and event == "permanent":
        return "failed", attempts, 0.0
    if status == "processing" and event == "transient":
        return ("failed" if attempts >= most else "queued"), attempts, 0.0
    return state


def item_states(events: DataFrame, lease: float = LEASE_SECONDS) -> DataFrame:
    """Each item's state after its new events, in order of time; closed items leave the state store.

    events: a stream of item_id, event, at (seconds). State is kept by item, so
    items spread over all tasks. A lease that has run out frees its item for the
    next claim, whose own time decides; so no timer is needed, and a batch runs
    only when events come.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("queued", 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for r in rows.itertuples(index=False):
            now = step(tuple(now), r.event, r.at, lease)
        last = float(rows["at"].iloc[-1])
        if now[0] in ("queued", "processing"):
            state.update(now)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *now, last)], columns=["item_id", "status", "attempts", "lease_until", "at"])

    return events.select("item_id", "event", F.col("at").cast("double").alias("at")).groupBy("item_id").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def detect_stream(documents: DataFrame, codes=None) -> DataFrame:
    """A stream of documents with their spans: detection keeps no state, so a batch's operator serves."""
    from ..operators.detect import TEXT_CODES, detect

    return detect(documents, codes or TEXT_CODES)


def audit_sink(events: DataFrame, path: str, checkpoint: str):
    """Append events to an audit table, exactly once; rows are never rewritten."""
    return events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


#: Seconds between two looks at the queue.
POLL_SECONDS = 2


def poll(states: DataFrame, handle, checkpoint: str, seconds: float = POLL_SECONDS):
    """Start handling a stream of item states: every few seconds handle(batch, number) gets what changed, at least once each."""
    return states.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

"""The task table as a stream of changes: latest states and timeouts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Order of states where two changes carry the same time.
RANK = {"queued": 0, "processing": 1, "error": 2, "ready": 3}


def latest_states(changes: DataFrame) -> DataFrame:
    """changes (id, status, at) -> the latest status of each task, kept by the engine as aggregate state (update mode)."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])[F.col("status")]
    return changes.groupBy("id").agg(F.max(F.struct("at", rank.alias("rank"), "status")).alias("m")).select("id", F.col("m.status").alias("status"), F.col("m.at").alias("at"))


def counts_by_window(changes: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Changes per status and hour of event time; windows close when the watermark passes them."""
    return changes.withWatermark("at", late).groupBy(F.window("at", width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def without_repeats(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows delivered twice pass once; what is remembered ends with the watermark."""
    return changes.withWatermark("at", late).dropDuplicatesWithinWatermark(["id", "status"])


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the last status of a task; a task in work when its event-time timeout comes is an error."""
    if state.hasTimedOut:
        (status, at) = state.get
        state.remove()
        if status == "processing":
            yield pd.DataFrame({"id": [key[0]], "status": ["error"]})
        return
    best = state.get if state.exists else ("", -1)
    for rows in batches:
        for status, at in zip(rows["status"], rows["at"]):
            best = max(best, (status, int(at.value // 1_000_000)), key=lambda x: (x[1], RANK.get(x[0], -1)))
    state.update(best)
    if best[0] == "processing":
        state.setTimeoutTimestamp(max(best[1] + 15 * 60_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"id": [key[0]], "status": [best[0]]})


def watched(changes: DataFrame, late: str = "1 minute") -> DataFrame:
    """Status changes, with errors for tasks that stay in work for a quarter of an hour of event time."""
    rows = changes.withWatermark("at", late)
    return rows.groupBy("id").applyInPandasWithState(_watch, "id string, status string", "status string, at bigint", "update", GroupStateTimeout.EventTimeTimeout)


def apply_batches(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Single-writer micro-batches: each hands over, with its number, the tasks that changed and their latest state.

    The state is the engine's, over all batches so far: a late or repeated row of an earlier batch changes nothing.
    """
    return latest_states(changes).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dispatched(changes: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """changes (id, task_type, ...): every micro-batch is dealt to the handlers by type; unknown types go to ``error``, if given."""

    def deal(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for kind, handle in handlers.items():
                if kind != "error":
                    handle(batch.filter(F.col("task_type") == kind), number)
            if "error" in handlers:
                known = F.coalesce(F.col("task_type").isin(*handlers), F.lit(False))
                handlers["error"](batch.filter(~known).withColumn("error_message", F.concat(F.lit("Unknown task type: "), F.coalesce("task_type", F.lit("null")))), number)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

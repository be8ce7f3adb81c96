"""Ingest task states kept over a stream of task events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noteloom.settings import TASK_ACTIVE

OUTPUT = (
    "doc_id bigint, ingest_version bigint, status string, attempt_count bigint, recovery_count bigint, "
    "last_error_code string, applied boolean, seq bigint"
)
_STATE = "ingest_version bigint, status string, attempts bigint, recoveries bigint, error string"
_ENDS = {"succeed": "succeeded", "fail": "failed", "supersede": "superseded"}


def advance(state: tuple | None, version: int, kind: str, error: str | None) -> tuple | None:
    """The state after an event, or None when the event is late or not allowed now."""
    if state is None or version > state[0]:
        state, fresh = (version, "queued", 0, 0, None), True
    else:
        fresh = False
    current, status, attempts, recoveries, last = state
    if version < current:
        return None
    if kind == "recover":
        return current, "queued", attempts, recoveries + 1, None
    if kind == "queue" and status not in TASK_ACTIVE:
        return current, "queued", attempts, recoveries, None
    if kind == "claim" and status == "queued":
        return current, "running", attempts + 1, recoveries, None
    if kind in _ENDS and status in TASK_ACTIVE:
        return current, _ENDS[kind], attempts, recoveries, error
    return state if fresh else None


class _TaskProcessor(StatefulProcessor):
    """One small row of state per document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._task = handle.getValueState("task", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._task.get() if self._task.exists() else None
        state = tuple(state) if state is not None else None
        out = []
        # Batches arrive one by one; inside a batch events apply in sequence order.
        for frame in rows:
            for e in frame.sort_values("seq").to_dict("records"):
                error = e["error_code"] if isinstance(e["error_code"], str) else None
                after = advance(state, int(e["ingest_version"]), e["kind"], error)
                state = after or state
                out.append((key[0], *state, after is not None, int(e["seq"])))
        if state is not None:
            self._task.update(state)
        columns = ["doc_id", "ingest_version", "status", "attempt_count", "recovery_count", "last_error_code", "applied", "seq"]
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def track_tasks(events: DataFrame) -> DataFrame:
    """Task state after every event of a stream.

    Events: ``doc_id, ingest_version, seq, kind, error_code``. A higher version replaces the
    task and resets its counters; events of older versions are reported as not applied.
    Needs the RocksDB state store (see :func:`state_store_conf`).
    """
    return events.groupBy("doc_id").transformWithStateInPandas(
        _TaskProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def state_store_conf() -> dict[str, str]:
    return {
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    }

"""Conversations over a stream: sessions that expire, and their last turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noteloom import settings as S

OUTPUT = (
    "session_id string, started timestamp, ended timestamp, turns bigint, "
    "history array<struct<turn:bigint,question:string,answer:string>>"
)
_COLUMNS = ["session_id", "started", "ended", "turns", "history"]


class _SessionProcessor(StatefulProcessor):
    """Per session: first and last time, number of turns, and the last turns themselves."""

    def __init__(self, ttl_seconds: int, keep: int):
        self._ttl = ttl_seconds * 1_000_000
        self._keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._times = handle.getValueState("times", "started bigint, ended bigint, turns bigint")
        self._turns = handle.getListState("turns", "turn bigint, question string, answer string")

    def _due(self, ended: int) -> int:
        # A turn exactly at the TTL still belongs to the session.
        return (ended + self._ttl) // 1000 + 1

    def _closed(self, key: tuple, times: tuple, turns: list) -> tuple:
        stamp = lambda us: pd.Timestamp(us, unit="us")
        history = [{"turn": t, "question": q, "answer": a} for t, q, a in turns]
        return key[0], stamp(times[0]), stamp(times[1]), times[2], history

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = tuple(self._times.get()) if self._times.exists() else None
        turns = [tuple(t) for t in self._turns.get()] if times else []
        if times:
            self._handle.deleteTimer(self._due(times[1]))
        out = []
        for frame in rows:
            for r in frame.sort_values(["ts", "turn"]).to_dict("records"):
                at = r["ts"].value // 1000
                if times and at - times[1] > self._ttl:
                    out.append(self._closed(key, times, turns))
                    times, turns = None, []
                times = (min(times[0], at), max(times[1], at), times[2] + 1) if times else (at, at, 1)
                turns = (turns + [(int(r["turn"]), r["question"], r["answer"])])[-self._keep :]
        if times:
            self._times.update(times)
            self._turns.put(turns)
            self._handle.registerTimer(self._due(times[1]))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times, turns = tuple(self._times.get()), [tuple(t) for t in self._turns.get()]
        self._times.clear()
        self._turns.clear()
        yield pd.DataFrame([self._closed(key, times, turns)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def close_sessions(
    turns: DataFrame, ttl_seconds: int = S.SESSION_TTL_SECONDS, lateness: str = "10 minutes", keep: int = S.SESSION_TURNS
) -> DataFrame:
    """Closed sessions with their number of turns and the last ``keep`` of them.

    Turns: ``session_id, ts, turn, question, answer``. A session closes when a turn comes
    later than the TTL after the one before, or when the watermark passes that time. The
    state of a session is ``keep`` turns whatever its length. Needs the RocksDB state store
    (see :func:`noteloom.streaming.tasks.state_store_conf`).
    """
    return turns.withWatermark("ts", lateness).groupBy("session_id").transformWithStateInPandas(
        _SessionProcessor(ttl_seconds, keep), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )

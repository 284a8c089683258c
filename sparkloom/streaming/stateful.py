"""The incremental operators over streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, late: str = "10 seconds", gap: str = "1 second") -> DataFrame:
    """Per path and burst the last op, once no event can join it any more. events: path, op, ts."""
    out = events.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("op", "ts").alias("op"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
    return out.select("path", "op", "last_ts", "events")


def idempotent(requests: DataFrame, key: str = "key", ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """Each key's first request within the time to live."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def rate_limited(requests: DataFrame, key: str, ts: str, id_: str, seconds: float = 60, limit: int = 10) -> DataFrame:
    """id, key and whether each request is within the limit of its window, which begins with a key's first hit. The
    state of a key is two numbers; it is dropped when the watermark has passed its window."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        for pdf in frames:
            pdf = pdf.sort_values([ts, id_])
            allowed = []
            for t in pdf[ts].astype("int64") / 1e9 if str(pdf[ts].dtype).startswith("datetime64[ns") else pdf[ts].map(pd.Timestamp.timestamp):
                if start is None or t >= start + seconds:
                    start, n = t, 0
                n += 1
                allowed.append(n <= limit)
            yield pd.DataFrame({id_: pdf[id_], key: k[0], "allowed": allowed})
        if start is not None:
            state.update((float(start), int(n)))
            state.setTimeoutTimestamp(int((start + seconds) * 1000) + 1 if state.getCurrentWatermarkMs() < (start + seconds) * 1000 else state.getCurrentWatermarkMs() + 1)

    slim = requests.select(key, id_, ts).withWatermark(ts, f"{seconds} seconds")
    return slim.groupBy(key).applyInPandasWithState(step, f"`{id_}` {kinds[id_]}, `{key}` {kinds[key]}, allowed boolean", "start double, n int", "append", GroupStateTimeout.EventTimeTimeout)


class _Answers(StatefulProcessor):
    """A key's state: whether its work is completed, the response, and when the key is forgotten, for which a timer
    is set."""

    def __init__(self, key: str, ts: str, id_: str, is_completion: str, response: str, ttl_ms: int):
        self.key, self.ts, self.id, self.ends, self.response, self.ttl = key, ts, id_, is_completion, response, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "done boolean, response string, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        before = state and state[2]
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.id])
        out = []
        for at, i, ends, response in zip(pdf[self.ts].astype("datetime64[ms]").astype("int64"), pdf[self.id], pdf[self.ends], pdf[self.response], strict=True):
            if state and at >= state[2]:
                state = None
            if ends:
                state, outcome = (True, response, at + self.ttl), "completed"
            elif not state:
                state, outcome = (False, None, at + self.ttl), "started"
            else:
                outcome = "answered" if state[0] else "refused"
            out.append((i, key[0], outcome, state[1]))
        if state and state[2] != before:
            self.state.update((bool(state[0]), state[1], int(state[2])))
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(int(state[2]))
        yield pd.DataFrame(out, columns=["id", "key", "outcome", "answer"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        out = []
        if state and state[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            if not state[0]:
                out.append((None, key[0], "abandoned", None))
        yield pd.DataFrame(out, columns=["id", "key", "outcome", "answer"]).astype({"id": "Int64"})

    def close(self) -> None:
        pass


def answered(events: DataFrame, key: str, ts: str, id_: str, is_completion: str, response: str, late: str = "10 minutes", hours: float = 24) -> DataFrame:
    """Requests and completions as the batch form handles them: id, key, outcome and answer of each event, and a row
    without id, abandoned, for work that was not completed when its key is forgotten. Needs RocksDB as the session's
    state store; a key's state is one row, which a timer removes when the watermark passes its time."""
    slim = events.select(key, ts, id_, is_completion, response).where(F.col(key).isNotNull()).withWatermark(ts, late)
    fields = f"id {events.schema[id_].dataType.simpleString()}, key {events.schema[key].dataType.simpleString()}, outcome string, answer {events.schema[response].dataType.simpleString()}"
    return slim.groupBy(key).transformWithStateInPandas(_Answers(key, ts, id_, is_completion, response, int(hours * 3_600_000)), fields, "append", "EventTime")

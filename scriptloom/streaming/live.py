"""Replies whose lines are still arriving: one row per reply, once its end has come or it has broken off.

Lines (response_id, pos from 0 without gaps, line, at: a timestamp) may come late, twice and in any order, as long as they are
not later than the watermark. State is kept by reply: the lines that came, and when the last one was sent. A reply
is handed on when its end mark and every line before it are there; its lines are dropped then, and a mark stays that
silences repeated lines until the watermark has passed them. A timer in event time hands on what there is of a reply of
which nothing was heard for `patience` seconds. The text and the errors are those of the batch readers (responses.py).

Rows without a response_id, pos, line or time are left out. A reply without an end mark only ever breaks off.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import BackendError
from ..shipping import ship
from .responses import read_ndjson, read_sse

OUT = "response_id string, text string, error string, complete boolean"


def _sse_ends(line: str) -> bool:
    line = line.strip()
    return line.startswith("data:") and line.removeprefix("data:").strip() == "[DONE]"


def _ndjson_ends(line: str) -> bool:
    try:
        return json.loads(line).get("done") is True
    except (ValueError, AttributeError):
        return False


class Replies(StatefulProcessor):
    """patience: in milliseconds."""

    def __init__(self, read: Callable[[list[str]], str], ends: Callable[[str], bool], patience: int):
        self.read, self.ends, self.patience = read, ends, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "pos int", "line string")
        #: The time of the latest line; the place of the end mark, -1 before it came; whether the reply was handed on.
        self.known = handle.getValueState("known", "latest long, end int, done boolean")

    def _row(self, key: tuple, complete: bool) -> pd.DataFrame:
        held = sorted((pos[0], line[0]) for pos, line in self.lines.iterator())
        try:
            text, error = self.read([line for _, line in held]), None
        except BackendError as e:
            text, error = None, str(e)
        return pd.DataFrame({"response_id": [key[0]], "text": [text], "error": [error], "complete": [complete]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.known.get()
        latest, end, done = before if before is not None else (0, -1, False)
        for part in rows:
            for pos, line, at in zip(part["pos"], part["line"], part["at_ms"]):
                latest = max(latest, int(at))
                if done or self.lines.containsKey((int(pos),)):
                    continue
                self.lines.updateValue((int(pos),), (line,))
                if self.ends(line) and (end < 0 or pos < end):
                    end = int(pos)
        if not done and end >= 0 and sum(pos[0] <= end for pos in self.lines.keys()) == end + 1:
            yield self._row(key, True)
            self.lines.clear()
            done = True
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.patience)
        self.known.update((latest, end, done))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.known.get()[2]:
            yield self._row(key, False)
            self.lines.clear()
        self.known.clear()

    def close(self) -> None:
        pass


def replies(lines: DataFrame, kind: str = "sse", patience: float = 60.0, lateness: str = "1 minute") -> DataFrame:
    """A streaming DataFrame of OUT, for append mode. kind: sse or ndjson."""
    spark = lines.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    read, ends = {"sse": (read_sse, _sse_ends), "ndjson": (read_ndjson, _ndjson_ends)}[kind]
    whole = lines.where("response_id IS NOT NULL AND pos IS NOT NULL AND line IS NOT NULL AND at IS NOT NULL").withWatermark("at", lateness)
    thin = whole.selectExpr("response_id", "pos", "line", "unix_millis(at) AS at_ms", "at")
    return thin.groupBy("response_id").transformWithStateInPandas(Replies(read, ends, int(patience * 1000)), OUT, "Append", "EventTime")

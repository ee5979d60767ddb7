"""A circuit breaker per key over a stream of outcomes, by event time: state with timers, late events in their place."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: transformWithState keeps its state in RocksDB; `session.build_session` sets this.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["event_id", "ts", "failures", "open_s", "state"]


class Breaker(StatefulProcessor):
    """Events wait in the state until the watermark has passed them, so that late ones take their place; then they count in order. An open breaker sets a timer
    for the end of its cooldown: if nothing has closed it by then it is half open, which is told by a row without an event. A closed breaker keeps no state."""

    def __init__(self, key: str, opens: int, cooldown_s: int, most_s: int):
        self.key, self.opens, self.cooldown_s, self.most_s = key, opens, cooldown_s, most_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "failures long, open_until long")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, failed boolean")

    def _ordered(self, watermark: int) -> tuple[list, list]:
        rows = sorted(tuple(r) for r in self.waiting.get())
        return [r for r in rows if r[0] // 1000 <= watermark], [r for r in rows if r[0] // 1000 > watermark]

    def _table(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=COLUMNS)
        out["event_id"] = out["event_id"].astype("Int64")
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        out.insert(0, self.key, key[0])
        return out

    def _due(self, key: Any, watermark: int) -> Iterator[pd.DataFrame]:
        """Counts what the watermark has passed."""
        due, rest = self._ordered(watermark)
        if not due:
            return
        failures, until, out = *(self.run.get() if self.run.exists() else (0, 0)), []
        for ts, event_id, failed in due:
            if until and until <= ts:
                out.append((None, until, failures, 0, "half open"))
                until = 0
            failures = failures + 1 if failed else 0
            wait = min(self.most_s, self.cooldown_s * 2 ** min(failures - self.opens, 20)) if failures >= self.opens else 0
            until = ts + wait * 1_000_000 if wait else 0
            out.append((event_id, ts, failures, wait, "open" if wait else "closed"))
        if failures:
            self.run.update((failures, until))
            if until:
                self.handle.registerTimer(max(until // 1000, watermark + 1))
        else:
            self.run.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000)
        else:
            self.waiting.clear()
        yield self._table(key, out)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            new = [(int(t.value // 1000), int(i), bool(f)) for t, i, f in zip(batch["ts"], batch["event_id"], batch["failed"], strict=True)]
            self.waiting.appendList(new)
            self.handle.registerTimer(max(min(new)[0] // 1000, watermark + 1))
        yield from self._due(key, watermark)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self._due(key, watermark)
        if self.run.exists():
            failures, until = self.run.get()
            if until and until // 1000 <= watermark:
                self.run.update((failures, 0))
                yield self._table(key, [(None, until, failures, 0, "half open")])

    def close(self) -> None:
        pass


def breaker_events(stream: DataFrame, key: str = "source", delay: str = "10 minutes", opens: int = 3, cooldown_s: int = 600, most_s: int = 21600) -> DataFrame:
    """Per event of `stream` (key, event_id long, ts timestamp, failed boolean): key, event_id, ts, failures in a row, open_s, state (closed or open), and a
    row without event_id, state `half open`, where a cooldown ends.

    An event is told once the watermark, `delay` behind the latest, has passed it; one that comes later still is dropped. Events of a key count in order of
    time and identifier. State per key: a count, and the events of the last `delay`. Needs the session's state store to be RocksDB (PROVIDER).
    """
    processor = Breaker(key, opens, cooldown_s, most_s)
    return stream.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(processor, f"{key} {stream.schema[key].dataType.simpleString()}, event_id long, ts timestamp, failures long, open_s long, state string", "append", "EventTime")

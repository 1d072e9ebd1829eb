"""What to ask a source for next, with state for each task: retries after waits, dead letters with an error class, and polls that fall due.

A task's state is its attempts and its last success; timers on the time of the events wake it. Both lie in the stream's checkpoint, so a lost
executor or driver goes on from there and no wait is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds before the second, third and fourth attempt; days between polls; the classes of errors, of which only E2 is tried
#: again and becomes E3 when all attempts have failed.
WAITS, POLL_DAYS = (1, 4, 15), 10
CLASSES = {"E1": "index_unavailable", "E2": "fetch_transient", "E3": "fetch_failed", "E4": "parse_failed"}

#: One row for each decision.
SCHEMA = "id string, at timestamp, action string, attempts int, reason string"


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class Cadence(StatefulProcessor):
    """Rows (id, at, outcome, error) of one id in; done, wait, retry, dead or due out. Outcome is ok or error, error a class of CLASSES."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "attempts int, phase string, timer long")

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "at", "action", "attempts", "reason"])

    def _set(self, attempts: int, phase: str, ms: int | None) -> None:
        if (old := self.state.get()) and old[2]:
            self.handle.deleteTimer(old[2])
        if ms:
            self.handle.registerTimer(ms)
        self.state.update((attempts, phase, ms or 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "outcome"], kind="stable")
        out = []
        for at, outcome, error in zip(events["at"], events["outcome"], events["error"], strict=True):
            at = pd.Timestamp(at)
            ms = int(at.tz_localize("UTC").timestamp() * 1000) if at.tzinfo is None else int(at.timestamp() * 1000)
            attempts = (self.state.get() or (0, "", 0))[0] + 1
            if outcome == "ok":
                out.append((key[0], _at(ms), "done", attempts, None))
                self._set(0, "poll", ms + POLL_DAYS * 86_400_000)
            elif error == "E2" and attempts <= len(WAITS):
                out.append((key[0], _at(ms), "wait", attempts, f"{CLASSES['E2']}: {WAITS[attempts - 1]} s"))
                self._set(attempts, "retry", ms + WAITS[attempts - 1] * 1000)
            else:
                error = "E3" if error == "E2" else error
                out.append((key[0], _at(ms), "dead", attempts, f"{error}: {CLASSES.get(error, 'unknown_error')}"))
                self._set(0, "dead", None)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        attempts, phase, timer = self.state.get() or (0, "", 0)
        if timer == ms:
            self.state.update((attempts, phase, 0))
            yield self._rows([(key[0], _at(ms), "retry" if phase == "retry" else "due", attempts, None)])
        else:
            yield self._rows([])

    def close(self) -> None:
        pass


def decisions(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(id, at, action, attempts, reason) as a stream, of a stream (id, at, outcome, error).

    A first error of class E2 waits 1 second, then 4, then 15, and is tried again when the time of the stream passes that; a fourth one, and
    any other class, is a dead letter. After a success the task falls due in ten days. The session's state store must be RocksDB.
    """
    rows = events.withWatermark("at", late).groupBy("id")
    return rows.transformWithStateInPandas(statefulProcessor=Cadence(), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")

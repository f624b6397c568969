"""Stateful streams that see a key's rows in order of time, whatever order they arrive in.

A row waits in the key's buffer until the watermark has passed it; then no earlier row can
come any more, as Spark drops rows behind the watermark. Buffers hold the rows of one lateness
horizon at most. A key that is quiet for `idle` seconds of event time is closed: it may emit a
last row, and buffer, fold state and timer are cleared, so state is bounded by the keys
active within lateness + idle and not by all keys ever seen.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MICROS = 1_000_000


class InOrder(StatefulProcessor):
    """Fold a key's rows by (at, event_id); subclasses give the state, the rows and the steps.

    `fields` are the columns of a row by SQL type, `at` (microseconds) and `event_id` first;
    `state_schema` is the state of the fold, `output` the columns that leave.
    """

    key = "session"
    fields: dict[str, str] = {}
    state_schema = ""
    output: dict[str, str] = {}

    def __init__(self, idle_seconds: float) -> None:
        self.idle = int(idle_seconds * MICROS)

    def step(self, name: str, state: tuple | None, row) -> tuple[tuple, tuple | None]:
        """State after a row, and what leaves, if anything."""
        raise NotImplementedError

    def last(self, name: str, state: tuple) -> tuple | None:
        """What leaves when the key is closed."""
        return None

    def init(self, handle) -> None:
        self.handle = handle
        self.row = namedtuple("Row", self.fields)
        self.state = handle.getValueState("fold", self.state_schema)
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {t}" for c, t in self.fields.items()))
        # the one timer that is set (ms), the earliest waiting row and the latest row (microseconds)
        self.clock = handle.getValueState("clock", "timer long, first long, latest long")

    def _set(self, old: int | None, first: int | None, latest: int) -> None:
        """One timer a key: at the earliest waiting row, else where the key falls idle."""
        due = latest + self.idle if first is None else first
        timer = -(-due // 1000)
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.clock.update((timer, first, latest))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=list(self.output), dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, first, latest = self.clock.get() if self.clock.exists() else (None, None, None)
        for batch in rows:
            columns = [_plain(batch[c], t) for c, t in self.fields.items()]
            self.waiting.appendList(list(zip(*columns)))
            low, high = min(columns[0]), max(columns[0])
            first = low if first is None else min(first, low)
            latest = high if latest is None else max(latest, high)
        self._set(timer, first, latest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        _, first, latest = self.clock.get()
        state = self.state.get() if self.state.exists() else None
        due, later, out = [], [], []
        if first is not None:
            for row in self.waiting.get():
                (due if row[0] <= passed else later).append(tuple(row))
        for row in sorted(due, key=lambda r: r[:2]):
            state, left = self.step(key[0], state, self.row(*row))
            if left is not None:
                out.append(left)
        if not later and latest + self.idle <= passed:
            left = None if state is None else self.last(key[0], state)
            if left is not None:
                out.append(left)
            self.state.clear()
            self.waiting.clear()
            self.clock.clear()
        else:
            if due:
                self.state.update(tuple(state))
                self.waiting.put(later) if later else self.waiting.clear()
            self._set(None, min(r[0] for r in later) if later else None, latest)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def _plain(column: pd.Series, kind: str) -> list:
    """Python values of a column; numbers with nulls arrive as floats with NaN.

    A list is gone through once: a key has few rows, pandas would take longer to set out than to work.
    """
    to = int if kind == "long" else lambda v: v
    return [None if v is None or v != v else to(v) for v in column.tolist()]


def fold_in_order(events: DataFrame, processor: InOrder, lateness: str) -> DataFrame:
    """Run a processor over a stream with `ts` and the columns of its rows; rows later than `lateness` are dropped."""
    timed = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", lateness)
    return (
        timed.select(processor.key, "ts", *processor.fields)
        .groupBy(processor.key)
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=", ".join(f"{c} {t}" for c, t in processor.output.items()),
            outputMode="Append",
            timeMode="EventTime",
        )
    )

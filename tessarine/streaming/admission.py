"""Sliding-window admission: at most `limit` admitted events per identity and window.

Rejected events use up nothing, so this is not a range window: whether an event is
admitted depends on the decisions before it.  The rule itself is the small function
`decide`; batch and stream share it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.operators.ordered import with_buckets
from tessarine.session import materialize
from tessarine.streaming.in_order import InOrder, fold_in_order

_OUT = "identity string, slice int, event_id long, at double, admitted boolean, kept array<double>"
SLICES = 32


def decide(times: list[float], held: deque, window: float, limit: int) -> list[bool]:
    """Admit or reject sorted event times; `held` keeps the admitted ones still in the window."""
    out = []
    for now in times:
        while held and held[0] <= now - window:
            held.popleft()
        admitted = len(held) < limit
        if admitted:
            held.append(now)
        out.append(admitted)
    return out


def _slices_in_order(window: float, limit: int):
    """Walk sorted rows; state is one deque, dropped when the (identity, slice) changes."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for batch in batches:
            if batch.empty:
                continue
            flags, kept = [], []
            for identity, part, at, carry in zip(batch["identity"], batch["slice"], batch["at"], batch["carry"]):
                if (identity, part) != current:
                    current, held = (identity, part), deque(carry if carry is not None else ())
                flags.extend(decide([at], held, window, limit))
                kept.append(list(held))
            yield batch.assign(admitted=flags, kept=kept)[
                ["identity", "slice", "event_id", "at", "admitted", "kept"]
            ]

    return walk


def admission_limit(
    events: DataFrame,
    window_seconds: float = V.ADMISSION_WINDOW_SECONDS,
    limit: int = V.SESSIONS_PER_WINDOW,
    slices: int = SLICES,
    small: int | None = None,
) -> DataFrame:
    """(identity, event_id, ts) to the same rows with `admitted`.

    A busy identity is cut into time slices that run in parallel, each starting from the
    end state of the slice before it as known so far (at first: nothing).  Slices whose
    start state turned out different run again until none changes, which is the exact
    sequential result: slice i is final after at most i + 1 rounds, in practice after two
    or three, as a window's worth of events makes the state forget its start.
    """
    timed = events.select("identity", "event_id", F.col("ts").cast("double").alias("at"))
    base = materialize(
        with_buckets(timed, ["identity"], "at", slices, small).withColumnRenamed("_bucket", "slice"),
        "admission-input",
    )
    walk = _slices_in_order(window_seconds, limit)
    key = ["identity", "slice"]
    nothing = F.array().cast("array<double>")
    ordered = Window.partitionBy("identity").orderBy("slice")
    starts = base.select(*key).distinct().withColumn("carry", nothing)
    todo, done = starts, None
    for turn in range(slices + 1):
        ran = (
            base.join(todo, key)
            .repartition(*key)
            .sortWithinPartitions(*key, "at", "event_id")
            .mapInPandas(walk, _OUT)
        )
        if done is not None:
            ran = done.join(todo.select(*key), key, "left_anti").unionByName(ran)
        done = materialize(ran, f"admission-{turn}")
        ends = done.groupBy(*key).agg(F.max_by("kept", F.struct("at", "event_id")).alias("end"))
        carried = ends.select(*key, F.coalesce(F.lag("end").over(ordered), nothing).alias("carry"))
        carried = materialize(carried, f"admission-starts-{turn}")
        todo = carried.alias("n").join(starts.alias("o"), key).filter("not (n.carry <=> o.carry)").select(*key, "n.carry")
        starts = carried
        if todo.isEmpty():
            break
    return done.select("identity", "event_id", "admitted")


class AdmissionProcessor(InOrder):
    """Streaming form: the admitted times (microseconds) of an identity, forgotten a window after its last event."""

    key = "identity"
    fields = {"at": "long", "event_id": "long"}
    state_schema = "times array<long>"
    output = {"identity": "string", "event_id": "long", "admitted": "boolean"}

    def __init__(self, window_seconds: float, limit: int) -> None:
        super().__init__(window_seconds)  # an identity idle for a window holds nothing any more
        self.limit = limit

    def step(self, name, state, row):
        held = deque(state[0] if state is not None else ())
        (admitted,) = decide([row.at], held, self.idle, self.limit)
        return (list(held),), (name, row.event_id, admitted)


def admission_stream(
    events: DataFrame,
    window_seconds: float = V.ADMISSION_WINDOW_SECONDS,
    limit: int = V.SESSIONS_PER_WINDOW,
    lateness: str = "0 seconds",
) -> DataFrame:
    """The same decision on a stream of (identity, event_id, ts), in any order within `lateness`."""
    return fold_in_order(events, AdmissionProcessor(window_seconds, limit), lateness)

"""Rules of one voice turn over session events (session, event_id, ts, event, bytes, text).

Batch forms are aggregates with partial sums, so a session of any length never sits in
one task.  Stream forms take events in any order within their lateness, keep one small state per session
and clear it when the session is idle (see in_order).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessarine import fixed_values as V
from tessarine.operators.evaluate import consecutive_dedupe, running_budget
from tessarine.operators.ordered import attach
from tessarine.streaming.in_order import InOrder, fold_in_order

AT = ("ts", "event_id")
ANCHORS = ("audio", "end", "committed", "answer")
IDLE_SECONDS = 3600.0


def _at() -> Column:
    return F.struct(*AT)


def _first(event: str) -> Column:
    return F.min(F.when(F.col("event") == event, _at()))


def session_protocol(events: DataFrame) -> DataFrame:
    """First violation of each session's turn protocol, null if it kept to it.

    The first event must be audio; an end needs audio before it; no audio after the end;
    one committed transcript only; no answer before it; a partial must not be blank.
    Events after the first answer are outside the turn.
    """
    firsts = events.groupBy("session").agg(
        F.min(_at()).alias("_start"),
        *[_first(e).alias(f"_{e}") for e in ("audio", "end", "committed", "answer")],
    )
    placed = attach(events, firsts, ["session"]).withColumn("_now", _at())
    now = F.col("_now")
    inside = F.col("_answer").isNull() | (now <= F.col("_answer"))
    before = lambda c: F.col(c).isNotNull() & (F.col(c) < now)
    event = F.col("event")
    problem = (
        F.when((now == F.col("_start")) & (event != "audio"), "first_event_not_audio")
        .when((event == "end") & ~before("_audio"), "end_without_audio")
        .when((event == "audio") & before("_end"), "audio_after_end")
        .when((event == "partial") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "blank_partial")
        .when((event == "committed") & before("_committed"), "duplicate_committed")
        .when((event == "answer") & ~before("_committed"), "answer_before_committed")
    )
    bad = F.when(F.col("problem").isNotNull(), now)
    return (
        placed.withColumn("problem", F.when(inside, problem))
        .groupBy("session")
        .agg(F.min_by("problem", bad).alias("problem"), F.min(bad).alias("_p"))
        .select("session", "problem", F.col("_p.event_id").alias("event_id"))
    )


def session_anchors(events: DataFrame, target_ms: float) -> DataFrame:
    """Five spans in ms between a session's anchors; a missing anchor is named instead."""
    moment = lambda e: F.min(F.when(F.col("event") == e, F.col("ts").cast("double")))
    return anchor_spans(events.groupBy("session").agg(*[moment(a).alias(a) for a in ANCHORS]), target_ms)


def anchor_spans(times: DataFrame, target_ms: float) -> DataFrame:
    """Spans of (session, audio, end, committed, answer), times in seconds."""
    missing = F.lit(None).cast("string")
    for a in reversed(ANCHORS):
        missing = F.when(F.col(a).isNull(), f"missing_{a}").otherwise(missing)
    span = lambda a, b: F.when(F.col("problem").isNull(), (F.col(b) - F.col(a)) * 1000)
    out = times.withColumn("problem", missing).withColumns(
        {
            "first_audio_to_committed_ms": span("audio", "committed"),
            "end_to_committed_ms": span("end", "committed"),
            "committed_to_answer_ms": span("committed", "answer"),
            "end_to_answer_ms": span("end", "answer"),
            "first_audio_to_answer_ms": span("audio", "answer"),
        }
    )
    spans = [c for c in out.columns if c.endswith("_ms")]
    negative = F.lit(False)
    for c in spans:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    return out.withColumn("problem", F.coalesce("problem", F.when(negative, "negative_span"))).withColumn(
        "target_met", F.when(F.col("problem").isNull(), F.col("end_to_answer_ms") <= target_ms)
    ).drop(*ANCHORS)


def partial_dedupe(events: DataFrame) -> DataFrame:
    """Rows left after dropping a text equal to the one before it."""
    return consecutive_dedupe(events, ["session"], "at", ["event_id"], "text")


def frame_budget(events: DataFrame, cap: int, max_frame: int = V.MAX_FRAME_BYTES) -> DataFrame:
    return running_budget(events, ["session"], "at", ["event_id"], cap, max_frame)


def turn_timeout(events: DataFrame, audio_cap_seconds: float) -> DataFrame:
    """Sessions whose turn outlived the audio cap plus the grace period, by event time."""
    limit = audio_cap_seconds + V.TURN_GRACE_SECONDS
    start, end = F.min(F.col("ts").cast("double")), F.max(F.col("ts").cast("double"))
    done = F.min(F.when(F.col("event") == "end", F.col("ts").cast("double")))
    return events.groupBy("session").agg((F.coalesce(done, end) - start > limit).alias("timed_out"))


class PartialDedupe(InOrder):
    fields = {"at": "long", "event_id": "long", "text": "string"}
    state_schema = "last string"
    output = {"session": "string", "event_id": "long", "text": "string"}

    def step(self, name, state, row):
        same = state is not None and state[0] == row.text
        return (row.text,), None if same else (name, row.event_id, row.text)


class FrameBudget(InOrder):
    """Emit the first frame of a session that breaks a frame rule or the byte cap."""

    fields = {"at": "long", "event_id": "long", "bytes": "long"}
    state_schema = "total long, broken boolean"
    output = {"session": "string", "event_id": "long", "problem": "string"}

    def __init__(self, idle_seconds: float, cap: int, max_frame: int) -> None:
        super().__init__(idle_seconds)
        self.cap, self.max_frame = cap, max_frame

    def step(self, name, state, row):
        total, broken = state if state is not None else (0, False)
        if broken:
            return (total, True), None
        total += row.bytes
        problem = (
            "empty_frame" if row.bytes <= 0
            else "oversized_frame" if row.bytes > self.max_frame
            else "odd_frame" if row.bytes % 2
            else "turn_over_budget" if total > self.cap
            else None
        )
        return (total, problem is not None), (name, row.event_id, problem) if problem else None


class TurnReport(InOrder):
    """The state machine of a turn: first violation and the times of its anchors, emitted when the session is closed."""

    fields = {"at": "long", "event_id": "long", "event": "string", "text": "string"}
    state_schema = "audio long, end long, committed long, answer long, problem string, event_id long"
    output = {"session": "string", **{a: "long" for a in ANCHORS}, "problem": "string", "event_id": "long"}

    def step(self, name, state, row):
        fresh = state is None
        audio, end, committed, answer, problem, event_id = (None,) * 6 if fresh else state
        if problem is None and answer is None:
            problem = (
                "first_event_not_audio" if fresh and row.event != "audio"
                else "end_without_audio" if row.event == "end" and audio is None
                else "audio_after_end" if row.event == "audio" and end is not None
                else "blank_partial" if row.event == "partial" and not (row.text or "").strip(" ")
                else "duplicate_committed" if row.event == "committed" and committed is not None
                else "answer_before_committed" if row.event == "answer" and committed is None
                else None
            )
            event_id = row.event_id if problem else None
        audio, end, committed, answer = (
            row.at if row.event == name_of and held is None else held
            for name_of, held in zip(ANCHORS, (audio, end, committed, answer))
        )
        return (audio, end, committed, answer, problem, event_id), None

    def last(self, name, state):
        return (name, *state)


def stream_partial_dedupe(events: DataFrame, lateness: str = "0 seconds", idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """`partial_dedupe` over rows in any order within `lateness`; a session closed as idle starts anew."""
    return fold_in_order(events, PartialDedupe(idle_seconds), lateness)


def stream_frame_budget(
    events: DataFrame, cap: int, max_frame: int = V.MAX_FRAME_BYTES, lateness: str = "0 seconds", idle_seconds: float = IDLE_SECONDS
) -> DataFrame:
    """First broken rule of each session, as soon as the watermark has passed its frame."""
    return fold_in_order(events, FrameBudget(idle_seconds, cap, max_frame), lateness)


def stream_turns(events: DataFrame, lateness: str = "0 seconds", idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """One row per session once it is idle: its anchors in microseconds and its first protocol violation."""
    return fold_in_order(events, TurnReport(idle_seconds), lateness)


def stream_session_protocol(events: DataFrame, lateness: str = "0 seconds", idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """`session_protocol` as a stream."""
    return stream_turns(events, lateness, idle_seconds).select("session", "problem", "event_id")


def stream_session_anchors(
    events: DataFrame, target_ms: float, lateness: str = "0 seconds", idle_seconds: float = IDLE_SECONDS
) -> DataFrame:
    """`session_anchors` as a stream."""
    turns = stream_turns(events, lateness, idle_seconds)
    return anchor_spans(turns.select("session", *[(F.col(a) / 1e6).alias(a) for a in ANCHORS]), target_ms)


class TurnTimeout(StatefulProcessor):
    """An event-time timer per session at its deadline; an `end` before it keeps the session from being emitted.

    Only the earliest row, the earliest `end` and the latest row matter, so nothing is buffered. After the
    deadline the session is remembered until it is idle, so that later rows do not open it again.
    """

    def __init__(self, limit_ms: int, idle_seconds: float) -> None:
        self.limit, self.idle = limit_ms, int(idle_seconds * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("turn", "start long, ended long, latest long, judged boolean, timer long")

    def _keep(self, start, ended, latest, judged, old) -> None:
        timer = latest + self.idle if judged else start + self.limit
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.state.update((start, ended, latest, judged, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, ended, latest, judged, timer = self.state.get() if self.state.exists() else (None, None, None, False, None)
        for batch in rows:
            at = batch["at"] // 1000
            ends = at[batch["event"] == "end"]
            start = int(at.min()) if start is None else min(start, int(at.min()))
            latest = int(at.max()) if latest is None else max(latest, int(at.max()))
            if len(ends):
                ended = int(ends.min()) if ended is None else min(ended, int(ends.min()))
        self._keep(start, ended, latest, judged, timer)
        yield pd.DataFrame({"session": pd.Series(dtype=object), "due": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, ended, latest, judged, _ = self.state.get()
        due = start + self.limit
        if not judged and (ended is None or ended > due):
            yield pd.DataFrame({"session": [key[0]], "due": [due]})
        if latest + self.idle <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        else:
            self._keep(start, ended, latest, True, None)

    def close(self) -> None:
        pass


def stream_turn_timeout(
    events: DataFrame, audio_cap_seconds: float, lateness: str = "0 seconds", idle_seconds: float = IDLE_SECONDS
) -> DataFrame:
    """Sessions still open when the watermark passes their deadline."""
    limit = int((audio_cap_seconds + V.TURN_GRACE_SECONDS) * 1000)
    timed = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", lateness)
    return timed.select("session", "ts", "at", "event").groupBy("session").transformWithStateInPandas(
        statefulProcessor=TurnTimeout(limit, idle_seconds),
        outputStructType="session string, due long",
        outputMode="Append",
        timeMode="EventTime",
    )

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from checks import evaluation_checks as EC
from checks import fixtures as X
from tessarine.operators import ordered
from tessarine.session import shared_folder
from tessarine.streaming import admission, runs, sessions


def brute(rows, window, limit):
    out, held = {}, {}
    for identity, event_id, at in sorted(rows, key=lambda r: (r[2], r[1])):
        queue = held.setdefault(identity, deque())
        while queue and queue[0] <= at - window:
            queue.popleft()
        out[event_id] = len(queue) < limit
        if out[event_id]:
            queue.append(at)
    return out


def test_sliced_admission_equals_the_sequential_rule(spark):
    """A busy identity, cut into slices, with a limit that couples each slice to the one before."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 else "cold", i, float(rng.randint(0, 900))) for i in range(400)]
    df = spark.createDataFrame(rows, "identity string, event_id long, at double").select(
        "identity", "event_id", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts")
    )
    got = {r.event_id: r.admitted for r in admission.admission_limit(df, 60.0, 6, slices=5, small=0).collect()}
    assert got == brute(rows, 60.0, 6)


def test_stream_of_partials_and_frames_equals_batch(spark, sf, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL_GROUP", 0)
    newest = EC.session_rows(spark, sf).agg(F.max_by("event_id", "ts")).first()[0]  # waits for its millisecond to pass
    batch = {(r.session, r.event_id) for r in EC.consecutive_dedupe(spark, sf).collect() if r.event_id != newest}
    stream = {(r.session, r.event_id) for r in EC.stream_partial_dedupe(spark, sf).collect()}
    assert batch == stream
    frames = {tuple(r) for r in EC.running_budget(spark, sf).filter("problem is not null").collect() if r.event_id != newest}
    assert frames == {tuple(r) for r in EC.stream_frame_budget(spark, sf).collect()}


def test_stream_timeouts_are_batch_timeouts_or_sessions_cut_by_the_end(spark, sf):
    late = {r.session for r in EC.session_timeout(spark, sf).filter("timed_out").collect()}
    fired = {r.session for r in EC.stream_session_timeout(spark, sf).collect()}
    rows = EC.session_rows(spark, sf)
    last = rows.agg(F.max("at")).first()[0]
    starts = {r.session: (r.s, r.e) for r in rows.groupBy("session").agg(F.min("at").alias("s"), F.min(F.when(F.col("event") == "end", F.col("at"))).alias("e")).collect()}
    limit = 86_402.0
    expected = {s for s, (a, e) in starts.items() if a + limit <= last and not (e is not None and e <= a + limit)}
    assert fired == expected
    assert late <= expected | {s for s, (a, _) in starts.items() if a + limit > last}


def test_latency_windows_stream_equals_batch(spark, sf):
    got = {(str(r.window_start), r.stage): (r.samples, r.p50, r.p70, r.p100) for r in EC.stream_latency_windows(spark, sf).collect()}
    rows = runs.latency_windows(EC.latency_rows(spark, sf), "1 day", "1 hour", 500.0)
    rows = rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    batch = {(str(r.window_start), r.stage): (r.samples, r.p50, r.p70, r.p100) for r in rows.collect()}
    last = max(k[0] for k in batch)
    assert got and got == {k: v for k, v in batch.items() if k in got}
    assert {k for k in batch if k[0] < last} <= set(got)


SHUFFLED = "session string, event_id long, ts timestamp, event string, text string, bytes long"


def shuffled_turns(spark, name, files=6):
    """Turns of a few seconds each, dealt over micro-batches out of order within half an hour, and a last row far later."""
    draw, rows = random.Random(13), []
    for number in range(60):
        at = number * 120
        for _ in range(draw.randint(1, 9)):
            at += draw.choice((0, 1, 2, 30))  # ties in time go by event id
            event = draw.choices(("audio", "partial", "end", "committed", "answer"), (5, 3, 2, 2, 2))[0]
            rows.append((f"s{number}", len(rows), at, event, draw.choice(("one", "two", " ", None)), draw.choice((10, 20, 31, 400, 0))))
    rows.append(("closing", len(rows), 10 * 86_400, "audio", None, 2))
    shift = {r[1]: draw.uniform(0, 1200) for r in rows}
    shift[len(rows) - 1] = 86_400
    rows.sort(key=lambda r: r[2] + shift[r[1]])
    path = shared_folder(spark, name)
    df = lambda part: spark.createDataFrame(part, SHUFFLED.replace("ts timestamp", "t long")).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        df(part).select("session", "event_id", "ts", "event", "text", "bytes").coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.schema(SHUFFLED).parquet(path)
    stream = spark.readStream.schema(SHUFFLED).option("maxFilesPerTrigger", 1).parquet(path)
    return rows, batch, stream


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_streams_of_shuffled_rows_equal_the_batch(spark):
    rows, batch, stream = shuffled_turns(spark, "shuffled")
    times = [r[2] for r in rows]
    assert times != sorted(times)
    settings = {"lateness": "30 minutes", "idle_seconds": 86_400.0}
    run = lambda df, name: as_set(runs.run_to_end(df, name))
    closed = batch.where("session <> 'closing'")
    timed = batch.withColumn("at", F.col("ts").cast("double"))
    assert run(sessions.stream_session_protocol(stream, **settings), "p") == as_set(sessions.session_protocol(closed))
    assert run(sessions.stream_session_anchors(stream, 9000.0, **settings), "a") == as_set(sessions.session_anchors(closed, 9000.0))
    texts = sessions.partial_dedupe(timed).where("session <> 'closing'").select("session", "event_id", "text")
    assert run(sessions.stream_partial_dedupe(stream, **settings), "d") == as_set(texts)
    frames = sessions.frame_budget(timed, 300, 100).where("problem is not null").select("session", "event_id", "problem")
    assert run(sessions.stream_frame_budget(stream, 300, 100, **settings), "b") == as_set(frames)
    late = sessions.turn_timeout(closed, 20.0).where("timed_out").select("session")
    got = {r.session for r in runs.run_to_end(sessions.stream_turn_timeout(stream, 20.0, **settings), "t").collect()}
    assert {r.session for r in late.collect()} <= got


def test_admission_of_shuffled_rows_is_the_sequential_rule(spark):
    rows, _, stream = shuffled_turns(spark, "shuffled-admission")
    identified = stream.withColumn("identity", F.when(F.col("event") == "audio", "busy").otherwise("other"))
    decided = runs.run_to_end(admission.admission_stream(identified, 60.0, 2, "30 minutes"), "admission")
    want = {}
    for who in ("busy", "other"):
        own = sorted((r[2], r[1]) for r in rows[:] if (r[3] == "audio") == (who == "busy"))
        taken = []
        for at, event_id in own:
            want[event_id] = sum(1 for t in taken if t > at - 60) < 2
            if want[event_id]:
                taken.append(at)
    want.pop(max(want))  # the closing row is still waiting
    assert {r.event_id: r.admitted for r in decided.collect()} == want


@pytest.mark.parametrize("idle, emptied", [(3_600.0, True), (90 * 86_400.0, False)])
def test_idle_sessions_leave_the_state(spark, idle, emptied):
    _, _, stream = shuffled_turns(spark, "expiry")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKSDB)
    try:
        turns = sessions.stream_turns(stream, "30 minutes", idle)
        query = turns.writeStream.format("noop").option("checkpointLocation", shared_folder(spark, "expiry")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    if emptied:
        assert kept[-1] <= 5 < max(kept)  # what the closing session holds
    else:
        assert kept[-1] >= 60


SESSION = "session string, event_id long, ts timestamp, event string, text string"


@pytest.mark.parametrize(
    "events, problem",
    [
        (["audio", "end", "committed", "answer"], None),
        (["end", "audio"], "first_event_not_audio"),
        (["audio", "end", "audio"], "audio_after_end"),
        (["audio", "committed", "committed"], "duplicate_committed"),
        (["audio", "end", "answer"], "answer_before_committed"),
        (["audio", "committed", "answer", "committed"], None),
    ],
)
def test_protocol(spark, events, problem):
    rows = [("s", i, i, e, "x") for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "session string, event_id long, t long, event string, text string").withColumn("ts", F.timestamp_seconds("t"))
    assert sessions.session_protocol(df).first().problem == problem


ASKED = "request_id string, event string, ts timestamp"


def commits(spark, name, files):
    path = shared_folder(spark, name)
    for rows in files:
        df = spark.createDataFrame([(i, e, t) for i, e, t in rows], "request_id string, event string, t long")
        df.select("request_id", "event", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ASKED).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_request_committed_twice_is_answered_once(spark):
    c = "committed"
    events = commits(spark, "twice", [[("a", c, 10), ("b", c, 20), ("d", "partial", 5)], [("b", c, 5), ("c", c, 30), ("c", c, 30)], [("a", c, 3000)]])
    requests = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "request_id string")
    got = runs.answer_committed(events, requests, lambda asked: asked.withColumn("answer", F.lit("x")), "twice-out", "1 hour")
    assert sorted(r.request_id for r in got.collect()) == ["a", "b", "c"]


def test_ids_are_forgotten_after_their_span(spark):
    c = "committed"
    events = commits(spark, "span", [[("a", c, 10)], [("b", c, 8000)], [("b", c, 8100)], [("a", c, 9000)]])
    requests = spark.createDataFrame([("a",), ("b",)], "request_id string")
    got = runs.answer_committed(events, requests, lambda asked: asked, "span-out", "1 hour")
    assert sorted(r.request_id for r in got.collect()) == ["a", "a", "b"]


def test_a_stream_without_input_has_no_answers(spark):
    path = shared_folder(spark, "none")
    spark.createDataFrame([], ASKED).write.parquet(path)
    events = spark.readStream.schema(ASKED).parquet(path)
    requests = spark.createDataFrame([("a",)], "request_id string")
    assert runs.answer_committed(events, requests, lambda asked: asked, "none-out").count() == 0


def test_rows_of_a_key_cost_no_pandas_work():
    import numpy as np
    import pandas as pd

    from tessarine.streaming.in_order import _plain

    class Once(pd.Series):
        """A column that may be listed and nothing else."""

        def astype(self, *args, **kwargs):
            raise AssertionError("set out anew")

    assert _plain(Once([3.0, np.nan]), "long") == [3, None]
    assert _plain(Once(["a", None], dtype=object), "string") == ["a", None]

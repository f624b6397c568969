"""Evaluation, window and streaming keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import answer_checks as A
from checks import fixtures as X
from checks import retrieval_checks as RC
from checks.base import CTES, query, r6, tok
from tessarine.functions import text as T
from tessarine.operators import evaluate as E
from tessarine.operators import requests as R
from tessarine.plans import answer_batch as P
from tessarine.streaming import admission, runs, sessions

# Stage latencies: event type is the stage, every seventh value is missing, k % 10 = 0 failed.

CTES["fx_latency"] = """
SELECT event_id, user_id, ts, event_type AS stage, CASE WHEN k % 7 > 0 THEN value END AS ms, k % 10 = 0 AS failed FROM (
  SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events)"""


def latency(events):
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.when(k % 7 > 0, F.col("value")).alias("ms"), (k % 10 == 0).alias("failed")
    )


def latency_rows(spark, sf):
    return latency(X.table(spark, sf, "events"))


def _latency_sql(source):
    return f"""SELECT stage, count(ms) FILTER (NOT failed) AS samples, count(*) FILTER (NOT failed) - count(ms) FILTER (NOT failed) AS missing, count_if(failed) AS failed,
  round(avg(ms) FILTER (NOT failed), 6) AS mean, round(quantile_cont(ms, 0.5) FILTER (NOT failed), 6) AS p50, round(quantile_cont(ms, 0.7) FILTER (NOT failed), 6) AS p70,
  max(ms) FILTER (NOT failed) AS p100, count_if(failed) = 0 AND count(*) = count(ms) AND max(ms) <= 500 AS all_attempts_meet_target FROM {source} GROUP BY stage"""


def _rounded(df):
    return df.withColumns({c: r6(c) for c in ("mean", "p50", "p70")})


@query("latency_distribution", _latency_sql("fx_latency"))
def latency_distribution(spark, sf):
    return _rounded(E.latency_distribution(latency_rows(spark, sf), ["stage"], 500.0))


@query("executed_stage_distribution", _latency_sql("(SELECT * FROM fx_latency WHERE ms > 0)"))
def executed_stage_distribution(spark, sf):
    return _rounded(E.executed_stage_distribution(latency_rows(spark, sf), ["stage"], 500.0))


@query("slowest_n", "SELECT event_id, stage, ms FROM fx_latency ORDER BY ms DESC NULLS LAST, event_id LIMIT 5")
def slowest_n(spark, sf):
    return E.slowest(latency_rows(spark, sf), "ms", "event_id").select("event_id", "stage", "ms")


@query(
    "stage_unpivot",
    " UNION ALL ".join(
        f"SELECT l_orderkey, '{s}' AS stage, {c}::DOUBLE AS ms, {c} IS NULL AS missing FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)"
        for s, c in zip(("embed", "search", "rerank"), ("l_quantity", "l_discount", "l_tax"))
    ),
)
def stage_unpivot(spark, sf):
    wide = X.table(spark, sf, "lineitem").select(
        "l_orderkey", *[F.col(c).cast("double").alias(s) for s, c in zip(("embed", "search", "rerank"), ("l_quantity", "l_discount", "l_tax"))]
    )
    return E.stage_unpivot(wide, "l_orderkey", ["embed", "search", "rerank"])


@query(
    "latency_budget",
    """SELECT l_orderkey, l_linenumber, round(e, 4) AS elapsed, round(greatest(0.0, 100 - e), 4) AS remaining, t <= 100 AS target_met FROM (
       SELECT *, sum(l_quantity::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS e,
         sum(l_quantity::DOUBLE) OVER (PARTITION BY l_orderkey) AS t FROM lineitem)""",
)
def latency_budget(spark, sf):
    """Order lines as stages of a request."""
    rows = X.table(spark, sf, "lineitem").withColumn("ms", F.col("l_quantity").cast("double")).withColumn(
        "position", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    )
    out = E.latency_budget(rows, 100.0, "l_orderkey", "position")
    return out.select("l_orderkey", "l_linenumber", F.round("elapsed", 4).alias("elapsed"), F.round("remaining", 4).alias("remaining"), "target_met")


# Responses ------------------------------------------------------------------------

CTES["fx_resp"] = """
SELECT o.request_id, r.query_id, r.language, r.v, r.own_chunk_id, r.own_document_id, r.query, o.is_safe, o.relevance, o.answer, o.cited_chunk_id, o.outcome,
  CASE WHEN outcome = 'answered' THEN 'answered' ELSE 'refused' END AS status, CASE WHEN outcome <> 'answered' THEN outcome END AS refusal_reason, r.budget_ms <= 200 AS target_met
FROM fx_outcome o JOIN fx_requests r USING (request_id)"""


def responses(spark, sf):
    """Responses written once to the shared folder and read by every report of a call."""
    from tessarine.session import materialize

    requests = X.requests(spark, sf)
    facts = requests.select("request_id", "query_id", "language", "v", "own_chunk_id", "own_document_id", (F.col("budget_ms") <= 200).alias("target_met"))
    return materialize(P.answer_batch(requests, X.chunks(spark, sf)).join(facts, "request_id"), "responses")


@query(
    "outcome_counts",
    """SELECT language, count(*) AS attempted, count(*) AS completed, 0::BIGINT AS errors, count_if(status = 'answered') AS answered, count_if(status = 'refused') AS refused,
       count_if(target_met) AS target_met, count(DISTINCT query_id) AS unique_query_ids FROM fx_resp GROUP BY language""",
)
def outcome_counts(spark, sf):
    return E.outcome_counts(responses(spark, sf), ["language"])


@query("refusals_by_reason", "SELECT refusal_reason, count(*) AS n FROM fx_resp WHERE refusal_reason IS NOT NULL GROUP BY refusal_reason")
def refusals_by_reason(spark, sf):
    return E.refusals_by_reason(responses(spark, sf))


@query(
    "flatten_response",
    """SELECT f.request_id, f.query_id, f.language, f.status, f.refusal_reason, 'completed' AS outcome, f.relevance, coalesce(CASE WHEN f.is_safe THEN s.ids END, '') AS ids FROM fx_resp f
       LEFT JOIN (SELECT request_id, string_agg(chunk_id, '|' ORDER BY rank) AS ids FROM fx_evidence GROUP BY request_id) s USING (request_id)""",
)
def flatten_response(spark, sf):
    rows = E.flatten_response(X.requests(spark, sf), responses(spark, sf), A.evidence(spark, sf))
    return rows.select(
        "request_id", "query_id", "language", "status", "refusal_reason", "outcome", "relevance",
        F.coalesce(F.array_join("retrieved_chunk_ids", "|"), F.lit("")).alias("ids"),
    )


@query("support_to_document", "SELECT request_id, own_document_id AS documents FROM fx_resp WHERE outcome = 'answered'")
def support_to_document(spark, sf):
    found = E.support_to_document(responses(spark, sf).filter("supporting_chunk_ids is not null"), X.chunks(spark, sf))
    return found.select("request_id", F.array_join("supporting_document_ids", "|").alias("documents"))


def samples(spark, sf, r):
    """Oracles by variant: v = 0 expects its own chunk, v = 3 an unsafe input, others a refusal."""
    none = F.array().cast("array<string>")
    return r.select(
        "request_id",
        F.when(F.col("v") != 2, F.col("query")).alias("reference"),
        F.upper("query").alias("transcript"),
        F.when(F.col("v") == 0, "answered").otherwise("refused").alias("expected_status"),
        F.when(F.col("v") == 3, "unsafe_input").alias("expected_refusal_reason"),
        F.when(F.col("v") == 0, F.array(F.element_at(T.lexical_tokens(F.concat(F.lit("x "), "query")), -1))).otherwise(none).alias("expected_answer_contains"),
        F.when(F.col("v") == 0, F.array("own_chunk_id")).otherwise(none).alias("expected_chunk_ids"),
        F.when(F.col("v") == 0, F.array("own_document_id")).otherwise(none).alias("expected_document_ids"),
    )


CTES["fx_quality"] = rf"""
SELECT *, status_match AND refusal_reason_match AND (v <> 0 OR outcome = 'answered' AND coalesce(contains, false)) AS eligible FROM (
  SELECT request_id, v, outcome, query, target_met, own_chunk_id, status = CASE WHEN v = 0 THEN 'answered' ELSE 'refused' END AS status_match,
    v <> 3 OR coalesce(refusal_reason = 'unsafe_input', false) AS refusal_reason_match,
    CASE WHEN v = 0 THEN outcome = 'answered' AND contains(' ' || trim(regexp_replace(regexp_replace(replace(lower(coalesce(answer, '')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' ',
      ' ' || list_last({tok("'x ' || query")}) || ' ') END AS contains,
    CASE WHEN v = 0 THEN coalesce(cited_chunk_id = own_chunk_id AND outcome = 'answered', false) END AS own FROM fx_resp)"""


@query("quality_record", "SELECT request_id, status_match, refusal_reason_match, contains AS answer_contains_match, own AS chunk_ids_match, own AS document_ids_match, eligible FROM fx_quality")
def quality_record(spark, sf):
    r = responses(spark, sf)
    out = E.quality_record(samples(spark, sf, r), r, X.chunks(spark, sf))
    return out.select("request_id", "status_match", "refusal_reason_match", "answer_contains_match", "chunk_ids_match", "document_ids_match", "eligible")


@query(
    "evidence_gates",
    r"""SELECT attempted, met, eligible_trials, referenced, distinct_contents, unique_references, met = attempted AS latency_gate, eligible_trials = attempted AS quality_gate,
       attempted >= 30 AND distinct_contents >= 30 AND unique_references >= 30 AND referenced = attempted AS workload_gate FROM (
       SELECT count(*) AS attempted, count_if(target_met) AS met, count_if(eligible AND v <> 2) AS eligible_trials, count_if(v <> 2) AS referenced, count(DISTINCT query) AS distinct_contents,
         count(DISTINCT CASE WHEN v <> 2 THEN nullif(trim(regexp_replace(regexp_replace(replace(lower(query), 'ß', 'ss'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '') END) AS unique_references FROM fx_quality)""",
)
def evidence_gates(spark, sf):
    r = responses(spark, sf)
    record = E.quality_record(samples(spark, sf, r), r, X.chunks(spark, sf)).select("request_id", "reference", "eligible")
    facts = r.select("request_id", F.col("target_met").alias("met_target"), F.sha2("query", 256).alias("content_digest"))
    return E.evidence_gates(record.join(facts, "request_id")).drop("passed", "evidence_eligible")


# Trials: answers are document texts, grouped by source. ---------------------------------


def trials(spark, sf):
    return X.documents(spark, sf).select("doc_id", "source", F.col("text").alias("answer"))


@query(
    "answer_stability",
    r"""SELECT source, sum(n)::BIGINT AS trials, count(*) AS unique_answers, count(DISTINCT trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS normalized_unique_answers,
       md5(arg_max(text, {n: n, f: -first})) AS modal_digest, max(n) AS modal_count, count(*) = 1 AS all_identical, round(max(n) / sum(n), 6) AS modal_rate
       FROM (SELECT source, text, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source, text) GROUP BY source""",
)
def answer_stability(spark, sf):
    out = E.answer_stability(trials(spark, sf), ["source"], "answer", "doc_id")
    return out.withColumn("modal_digest", F.md5(F.col("modal_answer").cast("binary"))).withColumn("modal_rate", r6("modal_rate")).drop("modal_answer")


@query("answer_variants", "SELECT source, sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY source, text")
def answer_variants(spark, sf):
    return E.answer_variants(trials(spark, sf), ["source"], "answer").select("source", "sha256", "n")


@query(
    "failures_by_type",
    """SELECT user_id, attempted, round(success_rate, 6) AS success_rate, error_type, failures FROM (
       SELECT user_id, count(*) AS attempted, avg((event_type <> 'error')::INT) AS success_rate FROM events GROUP BY user_id)
       LEFT JOIN (SELECT user_id, 'k' || (json_extract(props, '$.k')::BIGINT % 4) AS error_type, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY ALL) USING (user_id)""",
)
def failures_by_type(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = X.table(spark, sf, "events").select("user_id", (F.col("event_type") == "error").alias("failed"), F.concat(F.lit("k"), k % 4).alias("error_type"))
    return E.failures_by_type(rows, ["user_id"]).withColumn("success_rate", r6("success_rate"))


def _matches(spark, sf):
    """All documents in capitals and all conversation turns against all document and benchmark texts."""
    d, turns = X.documents(spark, sf), X.table(spark, sf, "conversations")
    attempts = d.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.upper("text").alias("transcript")).unionByName(
        turns.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.col("text").alias("transcript"))
    )
    known = d.select(F.col("text").alias("reference")).unionByName(
        X.table(spark, sf, "benchmark").select(F.col("text").alias("reference"))
    )
    return E.reference_matches(attempts, known)


def _normal(expr):
    return rf"trim(regexp_replace(regexp_replace(replace(lower({expr}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


CTES["fx_attempts"] = "SELECT 'd' || doc_id AS id, upper(text) AS t FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations"
CTES["fx_references"] = "SELECT text FROM documents UNION ALL SELECT text FROM benchmark"
_MATCHES = f"""SELECT a.id, u.n IS NOT NULL AS normalized, a.t IN (SELECT text FROM fx_references) AS strict FROM (SELECT *, {_normal("t")} AS n FROM fx_attempts) a
  LEFT JOIN (SELECT DISTINCT {_normal("text")} AS n FROM fx_references) u ON u.n = a.n"""


@query("reference_match_join", f"SELECT id, normalized, strict FROM ({_MATCHES})")
def reference_match_join(spark, sf):
    return _matches(spark, sf).select("id", "normalized", "strict")


@query(
    "reference_quality",
    f"""SELECT count(*) AS attempted, count_if(strict) AS strict_matches, count_if(normalized) AS normalized_matches, round(count_if(strict) / count(*), 6) AS strict_rate,
        round(count_if(normalized) / count(*), 6) AS normalized_rate FROM ({_MATCHES})""",
)
def reference_quality(spark, sf):
    return E.reference_quality(_matches(spark, sf)).withColumns({c: r6(c) for c in ("strict_rate", "normalized_rate")})


@query("content_distinct", "SELECT source, count(*) AS items, count(DISTINCT text) AS distinct_contents FROM documents GROUP BY source")
def content_distinct(spark, sf):
    return E.content_distinct(X.table(spark, sf, "documents"), "text", ["source"])


# Windows -----------------------------------------------------------------------------


@query("balanced_round_robin", "SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 25")
def balanced_round_robin(spark, sf):
    return E.balanced_round_robin(X.table(spark, sf, "documents"), "lang", "doc_id", 25).select("doc_id", "lang", "turn")


@query(
    "round_robin_assign",
    "SELECT e.event_id, d.doc_id FROM events e JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) d ON (e.event_id) % d.n = d.p",
)
def round_robin_assign(spark, sf):
    """Events as trials (numbered from 1), documents as samples."""
    trial = X.table(spark, sf, "events").select("event_id", (F.col("event_id") + 1).alias("trial"))
    return E.round_robin_assign(trial, X.table(spark, sf, "documents").select("doc_id"), "trial", "doc_id").select("event_id", "doc_id")


@query(
    "evenly_spaced_pick",
    r"""SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (ORDER BY n, doc_id) - 1 AS p, count(*) OVER () AS total FROM (
        SELECT min(doc_id) AS doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents GROUP BY text)) WHERE p IN (SELECT round_even(i * (t - 1) / 9.0, 0)::BIGINT FROM range(10) r(i), (SELECT count(DISTINCT text) AS t FROM documents))""",
)
def evenly_spaced_pick(spark, sf):
    from tessarine.sources.corpus import distinct_texts

    unique = distinct_texts(X.documents(spark, sf).select("text", "doc_id"), "text", "doc_id")
    sized = unique.select("doc_id", T.word_count(F.col("text")).cast("long").alias("n"))
    return E.evenly_spaced_pick(sized, "n", "doc_id", 10).select("doc_id", "n")


# Sessions: (user, week); view = audio, click = partial, signup = end, purchase = committed. --

CTES["fx_sessions"] = """
SELECT user_id || '-' || date_trunc('week', ts)::DATE AS session, event_id, ts, CASE event_type WHEN 'view' THEN 'audio' WHEN 'click' THEN 'partial' WHEN 'signup' THEN 'end'
  WHEN 'purchase' THEN 'committed' ELSE 'answer' END AS event, event_type AS text, round(value * 100)::BIGINT AS bytes FROM events"""


def session_events(events):
    kind = F.col("event_type")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    event = F.when(kind == "view", "audio").when(kind == "click", "partial").when(kind == "signup", "end").when(kind == "purchase", "committed").otherwise("answer")
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return events.select(
        F.concat_ws("-", "user_id", week).alias("session"), "event_id", "ts", F.col("ts").cast("double").alias("at"), event.alias("event"),
        kind.alias("text"), F.round(F.col("value") * 100).cast("long").alias("bytes"),
    )


WEEK = 7 * 86_400.0  # a session lies within one week, so it is never idle that long before its end


def session_rows(spark, sf):
    return session_events(X.table(spark, sf, "events"))


def event_stream(spark, sf):
    schema = X.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


_DEDUPE = "SELECT session, event_id, text FROM fx_sessions QUALIFY coalesce(lag(text) OVER (PARTITION BY session ORDER BY ts, event_id) <> text, true)"


@query("consecutive_dedupe", _DEDUPE)
def consecutive_dedupe(spark, sf):
    return sessions.partial_dedupe(session_rows(spark, sf)).select("session", "event_id", "text")


# A stream tells of the rows that the watermark, in whole milliseconds, has passed.
_PASSED = "SELECT t.* FROM ({0}) t JOIN events e ON e.event_id = t.event_id WHERE e.ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)"


@query("stream_partial_dedupe", _PASSED.format(_DEDUPE))
def stream_partial_dedupe(spark, sf):
    stream = sessions.stream_partial_dedupe(session_events(event_stream(spark, sf)), idle_seconds=WEEK)
    return runs.run_to_end(stream, "partials")


_BUDGET = """SELECT session, problem, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n FROM (
  SELECT *, CASE WHEN bytes <= 0 THEN 'empty_frame' WHEN bytes > 48000 THEN 'oversized_frame' WHEN bytes % 2 <> 0 AND bytes > 40000 THEN 'odd_frame'
    WHEN sum(bytes) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > 100000 THEN 'turn_over_budget' END AS problem FROM {0}) WHERE problem IS NOT NULL) WHERE n = 1"""
_EVEN = "(SELECT session, event_id, ts, bytes - bytes % 2 AS bytes FROM fx_sessions)"


def _even(rows):
    return rows.withColumn("bytes", F.col("bytes") - F.col("bytes") % 2)


@query(
    "running_budget",
    f"SELECT s.session, b.problem, b.event_id FROM (SELECT DISTINCT session FROM fx_sessions) s LEFT JOIN ({_BUDGET.format(_EVEN)}) b ON b.session = s.session",
)
def running_budget(spark, sf):
    return sessions.frame_budget(_even(session_rows(spark, sf)), 100000, 48000).select("session", "problem", "event_id")


@query("stream_frame_budget", _PASSED.format(_BUDGET.format(_EVEN)))
def stream_frame_budget(spark, sf):
    stream = _even(session_events(event_stream(spark, sf)))
    return runs.run_to_end(sessions.stream_frame_budget(stream, 100000, 48000, idle_seconds=WEEK), "budget").select("session", "problem", "event_id")


_PROTOCOL = """SELECT s.session, p.problem, p.event_id FROM (SELECT DISTINCT session FROM fx_sessions) s LEFT JOIN (
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS q FROM (
         SELECT *, CASE WHEN n = 1 AND event <> 'audio' THEN 'first_event_not_audio' WHEN event = 'end' AND na = 0 THEN 'end_without_audio' WHEN event = 'audio' AND ne > 0 THEN 'audio_after_end'
           WHEN event = 'committed' AND nc > 0 THEN 'duplicate_committed' WHEN event = 'answer' AND nc = 0 THEN 'answer_before_committed' END AS problem FROM (
           SELECT *, row_number() OVER w AS n, count_if(event = 'audio') OVER b AS na, count_if(event = 'end') OVER b AS ne, count_if(event = 'committed') OVER b AS nc, count_if(event = 'answer') OVER b AS nx FROM fx_sessions
           WINDOW w AS (PARTITION BY session ORDER BY ts, event_id), b AS (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE coalesce(nx, 0) = 0)
       WHERE problem IS NOT NULL) WHERE q = 1) p ON p.session = s.session""".replace("na = 0", "coalesce(na, 0) = 0").replace("nc = 0", "coalesce(nc, 0) = 0")
# A stream tells of a session once it has been idle for a week.
_CLOSED = "SELECT t.* FROM ({0}) t JOIN (SELECT session, max(ts) AS latest FROM fx_sessions GROUP BY session) c ON c.session = t.session WHERE latest + INTERVAL 7 DAY <= (SELECT max(ts) FROM events)"


@query("session_protocol", _PROTOCOL)
def session_protocol(spark, sf):
    return sessions.session_protocol(session_rows(spark, sf))


@query("stream_session_protocol", _CLOSED.format(_PROTOCOL))
def stream_session_protocol(spark, sf):
    stream = sessions.stream_session_protocol(session_events(event_stream(spark, sf)), idle_seconds=WEEK)
    return runs.run_to_end(stream, "protocol")


_SPANS = {
    "first_audio_to_committed_ms": ("a", "c"), "end_to_committed_ms": ("e", "c"), "committed_to_answer_ms": ("c", "x"),
    "end_to_answer_ms": ("e", "x"), "first_audio_to_answer_ms": ("a", "x"),
}
_ANCHORS = """SELECT session, CASE WHEN a IS NULL THEN 'missing_audio' WHEN e IS NULL THEN 'missing_end' WHEN c IS NULL THEN 'missing_committed' WHEN x IS NULL THEN 'missing_answer'
         WHEN c < a OR c < e OR x < c OR x < e OR x < a THEN 'negative_span' END AS problem, """ + " ".join(
    f"CASE WHEN a + e + c + x IS NOT NULL THEN round(({to} - {start}) * 1000, 1) END AS {span}," for span, (start, to) in _SPANS.items()
) + """ CASE WHEN a + e + c + x IS NOT NULL AND NOT (c < a OR c < e OR x < c OR x < e OR x < a) THEN x - e <= 86400 END AS target_met FROM (
       SELECT session, min(t) FILTER (event = 'audio') AS a, min(t) FILTER (event = 'end') AS e, min(t) FILTER (event = 'committed') AS c, min(t) FILTER (event = 'answer') AS x
       FROM (SELECT *, epoch_us(ts) / 1e6 AS t FROM fx_sessions) GROUP BY session)"""


def _all_spans(out):
    return out.select("session", "problem", *[F.round(c, 1).alias(c) for c in _SPANS], "target_met")


@query("session_anchors", _ANCHORS)
def session_anchors(spark, sf):
    return _all_spans(sessions.session_anchors(session_rows(spark, sf), 86_400_000.0))


@query("stream_session_anchors", _CLOSED.format(_ANCHORS))
def stream_session_anchors(spark, sf):
    stream = sessions.stream_session_anchors(session_events(event_stream(spark, sf)), 86_400_000.0, idle_seconds=WEEK)
    return _all_spans(runs.run_to_end(stream, "anchors"))


@query(
    "session_timeout",
    """SELECT session, coalesce(min(t) FILTER (event = 'end'), max(t)) - min(t) > 86402 AS timed_out FROM (SELECT *, epoch_us(ts) / 1e6 AS t FROM fx_sessions) GROUP BY session""",
)
def session_timeout(spark, sf):
    return sessions.turn_timeout(session_rows(spark, sf), 86_400.0)


@query(
    "stream_session_timeout",
    """SELECT session, due FROM (SELECT session, epoch_us(min(ts)) // 1000 + 86402000 AS due, epoch_us(min(ts) FILTER (event = 'end')) // 1000 AS ended FROM fx_sessions GROUP BY session)
       WHERE due <= (SELECT epoch_us(max(ts)) // 1000 FROM events) AND NOT coalesce(ended <= due, false)""",
)
def stream_session_timeout(spark, sf):
    stream = session_events(event_stream(spark, sf))
    return runs.run_to_end(sessions.stream_turn_timeout(stream, 86_400.0, idle_seconds=WEEK), "timeouts")


# Admission: identity = user, two days, three events. ------------------------------------

CTES["fx_numbered"] = "SELECT user_id::VARCHAR AS identity, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"
CTES["fx_admit"] = """/*recursive*/
SELECT identity, event_id, n, true AS admitted, [t] AS held FROM fx_numbered WHERE n = 1
UNION ALL
SELECT e.identity, e.event_id, e.n, len(list_filter(a.held, lambda h: h > e.t - 172800)) < 3,
  CASE WHEN len(list_filter(a.held, lambda h: h > e.t - 172800)) < 3 THEN list_append(list_filter(a.held, lambda h: h > e.t - 172800), e.t) ELSE list_filter(a.held, lambda h: h > e.t - 172800) END
FROM fx_admit a JOIN fx_numbered e ON e.identity = a.identity AND e.n = a.n + 1"""
_ADMIT = "SELECT identity, event_id, admitted FROM fx_admit"


def _identified(events):
    return events.select(F.col("user_id").cast("string").alias("identity"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


@query("admission_limit", _ADMIT)
def admission_limit(spark, sf):
    return admission.admission_limit(_identified(X.table(spark, sf, "events")), 172_800.0, 3)


@query("admission_stream", _PASSED.format(_ADMIT))
def admission_stream(spark, sf):
    return runs.run_to_end(admission.admission_stream(_identified(event_stream(spark, sf)), 172_800.0, 3), "admission")


@query(
    "stream_latency_windows",
    """SELECT * FROM (SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, stage, count(ms) FILTER (NOT failed) AS samples, count_if(failed) AS failed, round(avg(ms) FILTER (NOT failed), 6) AS mean,
       quantile_disc(ms, 0.5) FILTER (NOT failed) AS p50, quantile_disc(ms, 0.7) FILTER (NOT failed) AS p70, max(ms) FILTER (NOT failed) AS p100,
       count_if(failed) = 0 AND max(ms) <= 500 AS all_attempts_meet_target FROM fx_latency GROUP BY ALL)
       WHERE window_start + INTERVAL 25 HOUR <= (SELECT max(ts) FROM events)""",
)
def stream_latency_windows(spark, sf):
    """The windows that the watermark has closed."""
    closed = runs.run_to_end(runs.latency_windows(latency(event_stream(spark, sf)), "1 day", "1 hour", 500.0), "windows")
    return closed.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "mean": r6("mean")})


@query("stream_answer", "SELECT request_id, outcome FROM fx_outcome WHERE substring(request_id, 2)::BIGINT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def stream_answer(spark, sf):
    """Committed events name the request they belong to; only these are answered."""
    stream = session_events(event_stream(spark, sf)).withColumn("request_id", F.concat(F.lit("r"), F.substring_index("session", "-", 1)))
    chunks = X.chunks(spark, sf)
    flow = lambda asked: P.answer_batch(asked, chunks).select("request_id", "outcome")
    return runs.answer_committed(stream, X.requests(spark, sf), flow, "answers", once_within="3650 days")


@query(
    "encoder",
    "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS width FROM documents",
)
def encoder(spark, sf):
    """A user-supplied encoder: an iterator UDF, loaded once per worker; here it measures words."""
    from tessarine.functions.encoders import encoder_udf

    encode = encoder_udf(lambda: lambda texts: [[float(len(t.split()))] for t in texts])
    return X.documents(spark, sf).select("doc_id", encode("text")[0].cast("long").alias("width"))


@query("token_counter", "SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents")
def token_counter(spark, sf):
    """A user-supplied token count: any Column function of the text."""
    from tessarine.operators.profile import text_measures

    count = lambda text: F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    d = X.documents(spark, sf)
    return d.select("doc_id", text_measures("text", F.col("text"), count)[3]["value"].alias("spaces"))

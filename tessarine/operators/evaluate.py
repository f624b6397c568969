"""Evaluation and reporting over trials, responses and stage latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.operators.ordered import (
    attach,
    exact_quantiles,
    numbered,
    previous_value,
    running_total,
    values_at,
)


def selected_hits(requests: DataFrame, results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether any result has the request's language and query id and is a selected passage."""
    selected = chunks.filter("is_selected").select("chunk_id", "language", "query_id")
    found = (
        results.select("request_id", "chunk_id")
        .join(selected, "chunk_id")
        .select("request_id", "language", "query_id")
    )
    keys = ["request_id", "language", "query_id"]
    hits = requests.select(*keys).join(found, keys, "left_semi").select("request_id", F.lit(True).alias("hit"))
    return requests.select("request_id").join(hits, "request_id", "left").select(
        "request_id", F.coalesce("hit", F.lit(False)).alias("hit")
    )


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("hit").alias("hits"),
        (F.count_if("hit") / F.count(F.lit(1))).alias("rate"),
    )


def preview_examples(
    requests: DataFrame, results: DataFrame, chunks: DataFrame, position: str, first: int = 5, top: int = 3, chars: int = 400
) -> DataFrame:
    """The first requests with their top results, texts shortened for display."""
    shown = requests.orderBy(position).limit(first).select("request_id", "query")
    rows = results.filter(F.col("rank") <= top).join(F.broadcast(shown), "request_id")
    texts = rows.join(chunks.select("chunk_id", F.substring("text", 1, chars).alias("text")), "chunk_id")
    return texts.groupBy("request_id", "query").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "mrl_score", "full_score", "text"))).alias("top_3")
    )


def latency_distribution(trials: DataFrame, keys: list[str], target_ms: float) -> DataFrame:
    """samples, missing, failed, mean, p50, p70, p100 and the all-attempts gate.

    `trials`: keys, ms (nullable), failed.  Failed or missing attempts keep the gate false.
    """
    done = ~F.col("failed")
    ms = F.when(done, F.col("ms"))
    stats = trials.groupBy(*keys).agg(
        F.count(ms).alias("samples"),
        (F.count_if(done) - F.count(ms)).alias("missing"),
        F.count_if("failed").alias("failed"),
        F.avg(ms).alias("mean"),
        F.max(ms).alias("p100"),
    )
    middle = exact_quantiles(trials.filter(done), keys, "ms", V.REPORT_PERCENTILES).drop("count", "mean")
    gate = (F.col("samples") > 0) & (F.col("failed") == 0) & (F.col("missing") == 0) & (F.col("p100") <= target_ms)
    return attach(stats, middle, keys, "left").withColumn(
        "all_attempts_meet_target", F.coalesce(gate, F.lit(False))
    )


def executed_stage_distribution(trials: DataFrame, keys: list[str], target_ms: float) -> DataFrame:
    """The same over stages that ran at all."""
    return latency_distribution(trials.filter("ms > 0"), keys, target_ms)


def stage_unpivot(responses: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """Wide stage latencies to (key, stage, ms); `missing` marks a null, which is an error."""
    long = responses.unpivot(key, stages, "stage", "ms")
    return long.withColumn("missing", F.col("ms").isNull())


def latency_budget(stages: DataFrame, target_ms: float, key: str = "request_id", order: str = "position") -> DataFrame:
    """Elapsed and remaining time after each stage of a request (a handful of rows each)."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        stages.withColumn("elapsed", F.sum("ms").over(upto))
        .withColumn("remaining", F.greatest(F.lit(0.0), target_ms - F.col("elapsed")))
        .withColumn("target_met", F.sum("ms").over(Window.partitionBy(key)) <= target_ms)
    )


def slowest(responses: DataFrame, ms: str, position: str, n: int = 5) -> DataFrame:
    return responses.orderBy(F.desc(ms), position).limit(n)


def outcome_counts(responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """attempted, completed, errors, answered, refused, target met, distinct ids."""
    return responses.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("status") != "error").alias("completed"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "answered").alias("answered"),
        F.count_if(F.col("status") == "refused").alias("refused"),
        F.count_if(F.coalesce("target_met", F.lit(False))).alias("target_met"),
        F.count_distinct("query_id").alias("unique_query_ids"),
    )


def refusals_by_reason(responses: DataFrame) -> DataFrame:
    return responses.filter("refusal_reason is not null").groupBy("refusal_reason").agg(F.count(F.lit(1)).alias("n"))


def answer_stability(trials: DataFrame, keys: list[str], answer: str, position: str) -> DataFrame:
    """Unique and modal answers per key; among equal counts the earliest answer is modal."""
    folded = trials.select(*keys, position, F.col(answer).alias("answer")).withColumn(
        "normal", T.normalize_answer(F.col("answer"))
    )
    variants = folded.groupBy(*keys, "answer").agg(
        F.count(F.lit(1)).alias("n"), F.min(position).alias("first"), F.first("normal").alias("normal")
    )
    place = F.struct(F.col("n"), -F.col("first"))
    return variants.groupBy(*keys).agg(
        F.sum("n").alias("trials"),
        F.count(F.lit(1)).alias("unique_answers"),
        F.count_distinct(F.sha2("normal", 256)).alias("normalized_unique_answers"),
        F.max_by("answer", place).alias("modal_answer"),
        F.max("n").alias("modal_count"),
    ).withColumns(
        {
            "all_identical": F.col("unique_answers") == 1,
            "modal_rate": F.col("modal_count") / F.col("trials"),
        }
    )


def answer_variants(trials: DataFrame, keys: list[str], answer: str) -> DataFrame:
    return trials.groupBy(*keys, F.col(answer).alias("answer")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "sha256", F.sha2("answer", 256)
    )


def failures_by_type(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Failure counts by error type next to the key's success rate."""
    totals = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempted"), F.avg((~F.col("failed")).cast("int")).alias("success_rate")
    )
    failures = trials.filter("failed").groupBy(*keys, "error_type").agg(F.count(F.lit(1)).alias("failures"))
    return attach(totals, failures, keys, "left")


def reference_matches(attempts: DataFrame, references: DataFrame) -> DataFrame:
    """Attempts (id, transcript) whose normalised text equals some reference's.

    References collapse to distinct normalised texts first, so copies cannot multiply
    rows; texts meet by digest.
    """
    key = lambda c: F.sha2(T.normalize_transcript(F.col(c)), 256)
    exact = references.select(F.sha2("reference", 256).alias("_s")).distinct().withColumn("strict", F.lit(True))
    known = references.select(key("reference").alias("_k")).distinct().withColumn("normalized", F.lit(True))
    return (
        attempts.withColumn("_k", key("transcript"))
        .withColumn("_s", F.sha2("transcript", 256))
        .join(known, "_k", "left")
        .join(exact, "_s", "left")
        .drop("_k", "_s")
        .na.fill(False, ["strict", "normalized"])
    )


def reference_quality(matches: DataFrame) -> DataFrame:
    """Match counts and rates over all attempts; failures count as misses."""
    n = F.count(F.lit(1))
    return matches.agg(
        n.alias("attempted"),
        F.count_if("strict").alias("strict_matches"),
        F.count_if("normalized").alias("normalized_matches"),
        (F.count_if("strict") / n).alias("strict_rate"),
        (F.count_if("normalized") / n).alias("normalized_rate"),
    )


def content_distinct(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct(F.sha2(text, 256)).alias("distinct_contents")
    )


def support_to_document(responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document ids behind each response's supporting chunk ids."""
    support = responses.select("request_id", F.explode("supporting_chunk_ids").alias("chunk_id"))
    return support.join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy("request_id").agg(
        F.array_sort(F.collect_set("document_id")).alias("supporting_document_ids")
    )


def quality_record(samples: DataFrame, responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Expected against actual outcome of each sample; a missing response fails.

    `samples`: request_id, reference, transcript, expected_status, expected_refusal_reason,
    expected_answer_contains / chunk_ids / document_ids (arrays, empty if not set; the
    answer texts already normalised by T4, as they are stored).
    """
    documents = support_to_document(responses.filter("supporting_chunk_ids is not null"), chunks)
    actual = responses.select(
        "request_id", F.col("status").alias("actual_status"), F.col("refusal_reason").alias("actual_reason"),
        "is_grounded", "answer", "supporting_chunk_ids",
    ).withColumn("_answer", F.concat(F.lit(" "), T.normalize_transcript(F.coalesce("answer", F.lit(""))), F.lit(" ")))
    joined = samples.join(actual, "request_id", "left").join(documents, "request_id", "left")
    none = F.array().cast("array<string>")

    def within(expected: str, got: str):
        inside = F.size(F.array_except(expected, F.coalesce(got, none))) == 0
        return F.when(F.size(expected) > 0, inside)

    contains = F.when(
        F.size("expected_answer_contains") > 0,
        F.coalesce(
            F.forall(
                "expected_answer_contains",
                lambda e: F.contains(F.col("_answer"), F.concat(F.lit(" "), e, F.lit(" "))),
            ),
            F.lit(False),
        ),
    )
    normal = lambda c: T.normalize_transcript(F.col(c))
    checks = ("answer_contains_match", "chunk_ids_match", "document_ids_match")
    configured = F.coalesce(*[F.col(c) for c in checks]).isNotNull()
    oracle = configured
    for c in checks:
        oracle = oracle & F.coalesce(c, F.lit(True))
    arrived = F.col("actual_status").isNotNull()
    outcome = (
        F.col("status_match") & F.col("refusal_reason_match")
        & ((F.col("expected_status") == "refused") | (F.col("answered_and_grounded") & F.col("answer_oracle_match")))
    )
    reference_ok = F.col("reference").isNull() | F.coalesce("reference_normalized_match", F.lit(False))
    return (
        joined.withColumn("status_match", F.coalesce(F.col("actual_status") == F.col("expected_status"), F.lit(False)))
        .withColumn(
            "refusal_reason_match",
            F.col("expected_refusal_reason").isNull() | F.col("actual_reason").eqNullSafe(F.col("expected_refusal_reason")),
        )
        .withColumn(
            "answered_and_grounded",
            F.coalesce((F.col("actual_status") == "answered") & F.col("is_grounded"), F.lit(False)),
        )
        .withColumn("answer_contains_match", contains)
        .withColumn("chunk_ids_match", within("expected_chunk_ids", "supporting_chunk_ids"))
        .withColumn("document_ids_match", within("expected_document_ids", "supporting_document_ids"))
        .withColumn("answer_oracle_match", oracle)
        .withColumn("reference_normalized_match", normal("transcript") == normal("reference"))
        .withColumn("eligible", arrived & outcome & reference_ok)
        .drop("_answer")
    )


def evidence_gates(trials: DataFrame, minimum: int = V.MIN_WORKLOAD) -> DataFrame:
    """Latency, quality and workload gates over one row per attempt.

    `trials`: met_target, eligible, reference, content_digest.
    """
    n = F.count(F.lit(1))
    referenced = F.col("reference").isNotNull()
    words = F.nullif(T.normalize_transcript(F.col("reference")), F.lit(""))
    facts = trials.withColumn("_words", F.sha2(words, 256)).agg(
        n.alias("attempted"),
        F.count_if("met_target").alias("met"),
        F.count_if(F.col("eligible") & referenced).alias("eligible_trials"),
        F.count_if(referenced).alias("referenced"),
        F.count_distinct("content_digest").alias("distinct_contents"),
        F.count_distinct("_words").alias("unique_references"),
    )
    every = lambda c: (F.col(c) == F.col("attempted")) & (F.col("attempted") > 0)
    return facts.withColumns(
        {
            "latency_gate": every("met"),
            "quality_gate": every("eligible_trials"),
            "workload_gate": (F.col("attempted") >= minimum)
            & (F.col("distinct_contents") >= minimum)
            & (F.col("unique_references") >= minimum)
            & (F.col("referenced") == F.col("attempted")),
        }
    ).withColumn("passed", F.col("latency_gate") & F.col("quality_gate")).withColumn(
        "evidence_eligible", F.col("passed") & F.col("workload_gate")
    )


def flatten_response(requests: DataFrame, responses: DataFrame, evidence: DataFrame) -> DataFrame:
    """One report row per response with its retrieved ids in rank order."""
    ids = evidence.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("_ids")
    )
    kept = responses.select("request_id", "status", "refusal_reason", "relevance", "is_grounded", "outcome", "is_safe")
    return (
        requests.select("request_id", "query_id", "language")
        .join(kept, "request_id", "left")
        .join(ids, "request_id", "left")
        .select(
            "request_id", "query_id", "language", "status", "refusal_reason",
            F.when(F.col("status") == "error", "error").otherwise("completed").alias("outcome"),
            F.when(F.col("is_safe"), F.transform("_ids", lambda s: s["chunk_id"])).alias("retrieved_chunk_ids"),
            "relevance", "is_grounded",
        )
    )


def balanced_round_robin(queries: DataFrame, language: str, order: str, n: int) -> DataFrame:
    """The i-th query of each language in turn until `n`; fails if there are fewer."""
    place = Window.partitionBy(language).orderBy(order)
    ranked = queries.withColumn("turn", F.row_number().over(place)).filter(F.col("turn") <= n)
    chosen = ranked.orderBy("turn", language).limit(n)
    if chosen.count() < n:
        raise ValueError(f"fewer than {n} queries are available")
    return chosen


def round_robin_assign(trials: DataFrame, samples: DataFrame, trial: str, order: str) -> DataFrame:
    """Trial t (from 1) takes sample (t - 1) mod n, samples counted in `order`."""
    placed = numbered(samples, [], order, "sample_position")
    n = samples.count()
    return trials.withColumn("sample_position", F.pmod(F.col(trial) - 1, F.lit(n))).join(placed, "sample_position")


def consecutive_dedupe(events: DataFrame, keys: list[str], order: str, ties: list[str], text: str) -> DataFrame:
    """Drop a row whose text equals the row before it in the same key."""
    marked = previous_value(events, keys, order, ties, text, "_before")
    repeated = F.col("_before").isNotNull() & F.col("_before.v").eqNullSafe(F.col(text))
    return marked.filter(~repeated).drop("_before")


def running_budget(frames: DataFrame, keys: list[str], order: str, ties: list[str], cap: int, max_frame: int = V.MAX_FRAME_BYTES) -> DataFrame:
    """First rejected frame per turn: empty, oversized or odd frames, or the one past the cap."""
    size = F.col("bytes")
    own = F.when(size <= 0, "empty_frame").when(size > max_frame, "oversized_frame").when(size % 2 != 0, "odd_frame")
    total = running_total(frames.withColumn("_own", own), keys, order, ties, F.col("bytes"), "total")
    problem = F.coalesce("_own", F.when(F.col("total") > cap, "turn_over_budget"))
    place = F.struct(order, *ties)
    bad = F.col("problem").isNotNull()
    return total.withColumn("problem", problem).groupBy(*keys).agg(
        F.min_by("problem", F.when(bad, place)).alias("problem"),
        F.min(F.when(bad, place)).alias("_at"),
    ).select(*keys, "problem", *[F.col(f"_at.{c}").alias(c) for c in (order, *ties)])


def evenly_spaced_pick(documents: DataFrame, size: str, key: str, n: int) -> DataFrame:
    """`n` documents at evenly spaced places of the size order (ties by key).

    Places are found by size first: a histogram of sizes tells which size holds a place
    and how far in; only then is the key order of those sizes consulted.
    """
    histogram = documents.groupBy(size).agg(F.count(F.lit(1)).alias("_n"))
    total = documents.count()
    if total < n:
        raise ValueError(f"only {total} distinct documents; need {n}")
    if n == 1:
        places = [total // 2]
    else:
        places = sorted({round(i * (total - 1) / (n - 1)) for i in range(n)})  # half-even
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(1, p) for p in places], "_one int, rank long")
    sizes = values_at(documents.withColumn("_one", F.lit(1)).select("_one", size), ["_one"], size, wanted)
    chosen = sizes.select(F.col("rank"), F.col("value").alias(size))
    smaller = running_total(
        histogram.withColumn("_one", F.lit(1)), ["_one"], size, [], F.col("_n"), "_upto"
    ).select(size, (F.col("_upto") - F.col("_n")).alias("_before"))
    smaller = chosen.join(smaller, size)
    offsets = smaller.select(size, (F.col("rank") - F.col("_before")).alias("rank"), F.col("rank").alias("place"))
    inside = documents.join(F.broadcast(offsets.select(size).distinct()), size, "left_semi")
    found = values_at(inside, [size], key, offsets.select(size, "rank").distinct())
    keys = found.join(offsets, [size, "rank"]).select(F.col("value").alias(key), "place")
    return documents.join(F.broadcast(keys), key)

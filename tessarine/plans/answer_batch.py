"""The whole answer flow over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.operators import answers as A
from tessarine.operators import guardrails as G
from tessarine.operators import requests as R
from tessarine.operators import retrieval as K
from tessarine.session import spread_by


def final_outcome() -> Column:
    """Outcome code of a request; `answered`, a refusal reason, or an error code."""
    return (
        F.when(~F.col("is_safe"), "unsafe_input")
        .when(F.coalesce(F.col("retrieved"), F.lit(0)) == 0, "rag_retrieval_empty")
        .when(F.col("relevance_refusal").isNotNull(), F.col("relevance_refusal"))
        .when(F.coalesce(F.col("accepted"), F.lit(0)) == 0, "no_relevant_context")
        .when(F.col("violation").isNotNull(), "generation_invalid_output")
        .when(
            F.col("ground_reason") == "safe_refusal",
            F.when(F.col("finish_reason") == "budget_skipped", "latency_budget_exhausted").otherwise(
                "no_relevant_context"
            ),
        )
        .when(~F.coalesce(F.col("is_grounded"), F.lit(False)), "ungrounded_answer")
        .otherwise("answered")
    )


def status_of(outcome: Column) -> Column:
    return (
        F.when(outcome == "answered", "answered")
        .when(outcome == "rag_retrieval_empty", "error")
        .otherwise("refused")
    )


def retrieve_evidence(requests: DataFrame, chunks: DataFrame, **counts: int) -> DataFrame:
    """Safe requests to their final evidence rows with chunk text.

    Retrieval goes as deep as the language filter needs; text joins after the cut.
    """
    asked = ("query", "language_code", "final_k", "budget_ms")
    hits = K.two_stage_retrieve(requests, chunks, R.retrieval_depth(), asked, **counts)
    cut = spread_by(R.language_filter(hits), "chunk_id")
    return K.with_chunks(cut, chunks, ["document_id", "text"])


def select_answers(assessed: DataFrame) -> DataFrame:
    """Assessed evidence rows to one row per request with the extract and its evidence.

    Windows and aggregate all work on `request_id`: one distribution serves them all.
    The chunk's tokens ride on its first sentence only.
    """
    rows = A.scored_sentences(
        assessed.withColumn("usable", F.col("accepted") & (F.col("set_class") == "correct")),
        on_first=F.col("evidence_tokens"),
    )
    order = [F.desc("eligible"), F.desc("selection_score"), "rank", "chunk_id", "sentence_index"]
    same_span = Window.partitionBy("request_id", "span").orderBy(*order)
    request = Window.partitionBy("request_id").orderBy(F.desc("_counts"), *order)
    score = F.when(F.col("_counts"), F.col("selection_score"))
    ranked = (
        rows.withColumn("_counts", F.col("eligible") & (F.row_number().over(same_span) == 1))
        .withColumn("_place", F.row_number().over(request))
        .withColumn("margin", score - F.lead(score).over(request))
    )
    best = F.when((F.col("_place") == 1) & F.col("_counts"), F.struct("chunk_id", "span", "sentence_coverage", "margin"))
    first_sentence = F.coalesce(F.col("sentence_index"), F.lit(0)) == 0
    held = F.when(F.col("usable") & first_sentence, F.struct("chunk_id", F.col("on_first").alias("tokens")))
    return (
        ranked.groupBy("request_id")
        .agg(
            F.first("set_class").alias("relevance"),
            F.first("confidence").alias("confidence"),
            F.first("reason").alias("relevance_reason"),
            F.first("budget_ms").alias("budget_ms"),
            F.count_if(first_sentence).alias("kept"),
            F.count_if(first_sentence & F.col("accepted")).alias("accepted"),
            F.max(best).alias("_best"),
            F.collect_list(held).alias("evidence"),
        )
        .withColumn("relevance_refusal", G.relevance_refusal(F.col("relevance"), F.col("relevance_reason")))
        .withColumn(
            "answer",
            F.when(
                A.passes_selection(F.col("_best.sentence_coverage"), F.col("_best.margin")),
                A.cited_answer(F.col("_best.chunk_id"), F.col("_best.span")),
            ).otherwise(V.SAFE_REFUSAL_TEXT),
        )
        .drop("_best")
    )


def answer_batch(
    requests: DataFrame,
    chunks: DataFrame,
    fallback: DataFrame | None = None,
    scope_terms: tuple[str, ...] = (),
) -> DataFrame:
    """One outcome row per request.

    `requests`: request_id, query, language_code, full, prefix, candidate_k, final_k,
    budget_ms.  `chunks`: chunk_id, document_id, language, text, full, prefix.
    Unsafe requests are filtered before retrieval and never reach it.
    """
    checked = G.input_safety(requests)
    safe = checked.filter("is_safe")
    rows = chunks.count()
    asked, deepest = requests.agg(F.count(F.lit(1)), F.max("candidate_k")).first()
    evidence = retrieve_evidence(safe, chunks, chunk_rows=rows, request_rows=asked, deepest=deepest or 0)
    selected = select_answers(G.assess_relevance(evidence, scope_terms, only_correct=True))
    routed = A.hybrid_routing(selected, fallback)
    contract = G.citation_contract(
        routed.withColumn("known", F.transform("evidence", lambda e: e["chunk_id"]))
    ).withColumn("violation", F.when(F.col("route") == "fallback", F.col("violation")))
    grounded = G.groundedness(contract)
    verdict = checked.select("request_id", "query", "language_code", "is_safe", "category", "matched_rule").join(
        grounded.drop("budget_ms"), "request_id", "left"
    )
    # A language without matching rows leaves retrieval non-empty but evidence empty.
    has_chunks = F.lit(rows)
    filled = (
        verdict.withColumn("retrieved", F.when(F.col("is_safe"), has_chunks))
        .withColumn(
            "relevance_refusal",
            F.when(F.col("is_safe") & F.col("kept").isNull(), "no_relevant_context").otherwise(F.col("relevance_refusal")),
        )
        .withColumn("outcome", final_outcome())
        .withColumn("status", status_of(F.col("outcome")))
    )
    answered = F.col("outcome") == "answered"
    reached = F.col("relevance_refusal").isNull() & F.col("is_safe")
    return filled.select(
        "request_id",
        "query",
        "is_safe",
        "matched_rule",
        F.when(F.col("is_safe"), F.coalesce("relevance", F.lit("incorrect"))).alias("relevance"),
        F.when(F.col("is_safe"), F.coalesce("confidence", F.lit(1.0))).alias("confidence"),
        F.when(reached, F.col("route")).alias("route"),
        F.when(reached, F.col("is_grounded")).alias("is_grounded"),
        F.when(reached, F.col("ground_score")).alias("ground_score"),
        F.when(answered, F.col("supporting_chunk_ids")).alias("supporting_chunk_ids"),
        F.when(answered, F.col("answer")).alias("answer"),
        F.when((F.col("status") == "refused"), F.col("outcome")).alias("refusal_reason"),
        "status",
        "outcome",
    )

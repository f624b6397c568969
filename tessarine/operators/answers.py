"""Verbatim sentence selection and answer routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.functions import vectors


def literal_array(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def polarity_conflict(query_tokens: Column, sentence_tokens: Column) -> Column:
    """Question and sentence stand on opposite poles of some antonym group."""
    conflict = F.lit(False)
    for left, right in V.ANTONYM_GROUPS:
        for mine, other in ((left, right), (right, left)):
            conflict = conflict | (
                F.arrays_overlap(query_tokens, literal_array(mine))
                & F.arrays_overlap(sentence_tokens, literal_array(other))
            )
    return conflict


def has_digit_token(tokens: Column) -> Column:
    """Some token has a decimal digit or a digit-valued sign such as a superscript."""
    digits = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}-\x{2079}\x{2080}-\x{2089}\x{1369}-\x{1371}\x{19da}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
    return F.exists(tokens, lambda t: t.rlike(digits))


def misses_quantity(query_tokens: Column, sentence_tokens: Column) -> Column:
    """A quantity question met by a sentence with neither digit nor number word."""
    asks = F.arrays_overlap(query_tokens, literal_array(V.QUANTITY_QUESTION_TOKENS))
    has_word = F.arrays_overlap(sentence_tokens, literal_array(V.NUMBER_WORDS))
    return asks & ~has_digit_token(sentence_tokens) & ~has_word


def selection_score(coverage: Column, full_score: Column, specificity: Column) -> Column:
    return (
        coverage
        + V.SELECTION_SCORE_WEIGHT * vectors.score_to_unit(full_score)
        + V.SELECTION_SPECIFICITY_WEIGHT * specificity
    )


def scored_sentences(
    rows: DataFrame, min_score: float = V.SELECTION_MIN_SCORE, on_first: Column | None = None
) -> DataFrame:
    """Explode each row's chunk text into sentences and mark `eligible` ones with a score.

    Rows whose `usable` flag is false, or without sentences, stay as one row with a
    null sentence, so refused requests are not lost.  `on_first` is a wide value kept
    on each row's first sentence only; text and tokens do not follow the sentences.
    """
    usable = (
        F.col("usable")
        & vectors.is_usable_score(F.col("mrl_score"), V.SCORE_BOUND)
        & vectors.is_usable_score(F.col("full_score"), V.SCORE_BOUND)
        & (F.col("full_score") + V.SELECTION_EPSILON >= min_score)
        & T.is_safe_citation_id(F.col("chunk_id"))
    )
    words = V.SELECTION_FUNCTION_WORDS
    wide = F.lit(None).cast("string") if on_first is None else on_first
    narrow = [c for c in rows.columns if c not in ("text", "evidence_tokens", "query_tokens")]
    exploded = (
        rows.withColumn("_query", F.array_distinct(T.content_tokens(F.col("query"), words)))
        .withColumn(
            "_spans",
            F.transform(
                F.when(usable, T.sentences(F.col("text"))),
                lambda s, i: F.struct(s.alias("span"), F.when(i == 0, wide).alias("on_first")),
            ),
        )
        .select(*narrow, "_query", F.posexplode_outer("_spans").alias("sentence_index", "_s"))
        .select(*narrow, "_query", "sentence_index", "_s.span", "_s.on_first")
        .withColumn("_tokens", F.array_distinct(T.content_tokens(F.col("span"), words)))
        .withColumn("matched", F.size(F.array_intersect("_query", "_tokens")))
        .withColumn("sentence_coverage", F.try_divide(F.col("matched"), F.size("_query")))
        .withColumn("specificity", F.try_divide(F.col("matched"), F.size("_tokens")))
    )
    eligible = (
        F.col("span").isNotNull()
        & (F.size("_query") >= V.SELECTION_MIN_TOKENS)
        & (F.char_length("span") <= V.SELECTION_MAX_CHARS)
        & (F.size("_tokens") >= V.SELECTION_MIN_TOKENS)
        & ~polarity_conflict(F.col("_query"), F.col("_tokens"))
        & ~misses_quantity(F.col("_query"), F.col("_tokens"))
    )
    score = selection_score(F.col("sentence_coverage"), F.col("full_score"), F.col("specificity"))
    return (
        exploded.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
        .withColumn("selection_score", F.when(F.col("eligible"), F.round(score, vectors.SCORE_PLACES)))
        .drop("_query", "_tokens")
    )


def sentence_candidates(evidence: DataFrame) -> DataFrame:
    """Eligible sentences of evidence rows (request_id, query, chunk_id, text, scores, rank)."""
    return scored_sentences(evidence.withColumn("usable", F.lit(True))).filter("eligible")




def _best_first() -> list[Column]:
    return [F.desc("selection_score"), F.col("rank"), F.col("chunk_id"), F.col("sentence_index")]


def span_dedupe(candidates: DataFrame) -> DataFrame:
    """Identical sentences of a request count once: keep the best placed."""
    order = Window.partitionBy("request_id", "span").orderBy(*_best_first())
    return candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def selection_margin(candidates: DataFrame) -> DataFrame:
    """Best sentence per request with `margin` to the runner-up (null if alone)."""
    order = Window.partitionBy("request_id").orderBy(*_best_first())
    score = F.col("selection_score")
    return (
        candidates.withColumn("_n", F.row_number().over(order))
        .withColumn("margin", score - F.lead(score).over(order))
        .filter("_n = 1")
        .drop("_n")
    )


def passes_selection(coverage: Column, margin: Column) -> Column:
    """Coverage gate, and the margin gate if there was a runner-up."""
    return (coverage + V.SELECTION_EPSILON >= V.SELECTION_MIN_COVERAGE) & (
        margin.isNull() | (margin + V.SELECTION_EPSILON >= V.SELECTION_MIN_MARGIN)
    )


def cited_answer(chunk_id: Column, span: Column) -> Column:
    return F.concat(F.lit("[chunk:"), chunk_id, F.lit("] "), span)


def extractive_answer(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """One verbatim cited sentence per request, or the refusal text without citation."""
    best = selection_margin(span_dedupe(sentence_candidates(evidence)))
    passed = best.filter(passes_selection(F.col("sentence_coverage"), F.col("margin"))).select(
        "request_id",
        F.col("chunk_id").alias("cited_chunk_id"),
        cited_answer(F.col("chunk_id"), F.col("span")).alias("answer"),
    )
    return requests.select("request_id").join(passed, "request_id", "left").withColumn(
        "answer", F.coalesce("answer", F.lit(V.SAFE_REFUSAL_TEXT))
    )


def hybrid_route(extracted: Column, budget_ms: Column, has_fallback: Column) -> Column:
    """Route of one request: the extract, no time for more, or the fallback."""
    return (
        F.when(extracted != V.SAFE_REFUSAL_TEXT, "extractive")
        .when(budget_ms < V.MIN_FALLBACK_BUDGET_MS, "budget_skipped")
        .when(has_fallback, "fallback")
        .otherwise("fallback_missing")
    )


def hybrid_routing(extracted: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """extractive_answer rows with budget_ms, plus supplied fallback answers, to final answers.

    `fallback`: request_id, answer, finish_reason.  Without a supplied answer the
    refusal stands.
    """
    if fallback is None:
        joined = extracted.withColumn("_fb", F.lit(None).cast("string")).withColumn(
            "_fin", F.lit(None).cast("string")
        )
    else:
        joined = extracted.join(
            fallback.select(
                "request_id", F.col("answer").alias("_fb"), F.col("finish_reason").alias("_fin")
            ),
            "request_id",
            "left",
        )
    return (
        joined.withColumn(
            "route", hybrid_route(F.col("answer"), F.col("budget_ms"), F.col("_fb").isNotNull())
        )
        .withColumn("answer", F.when(F.col("route") == "fallback", F.col("_fb")).otherwise(F.col("answer")))
        .withColumn(
            "finish_reason",
            F.when(F.col("route") == "budget_skipped", "budget_skipped")
            .when(F.col("route") == "fallback", F.col("_fin"))
            .otherwise("stop"),
        )
        .drop("_fb", "_fin")
    )


def context_json(evidence: DataFrame) -> DataFrame:
    """Evidence payload per request; a null language is left out."""
    chunks = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))),
        lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text")),
    )
    return evidence.groupBy("request_id", "query", "language_code").agg(chunks.alias("c")).select(
        "request_id",
        F.to_json(
            F.struct(
                "query",
                F.col("c").alias("context_chunks"),
                F.nullif("language_code", F.lit("")).alias("requested_language_code"),
            )
        ).alias("payload"),
    )


def antonym_conflicts(tokens: DataFrame, poles: DataFrame, key: str) -> DataFrame:
    """(key, word_group) of texts holding words of both poles of a group.

    `tokens`: key, word; `poles`: word_group, pole, word, a fixed word list and so broadcast.
    """
    held = tokens.join(F.broadcast(poles), "word").groupBy(key, "word_group")
    return held.agg(F.min("pole").alias("low"), F.max("pole").alias("high")).filter("low <> high").select(key, "word_group")


def first_seen(answer: Column, known: Column) -> Column:
    """Distinct cited ids of an answer that are known, in order of first citation."""
    return F.array_intersect(F.array_distinct(T.citations(answer)), known)

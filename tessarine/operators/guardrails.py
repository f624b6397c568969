"""Safety, relevance and groundedness checks over tables of requests.

Inputs are long: one row per (request, chunk) or per answer.  Everything that looks
at one request's evidence uses windows or aggregates on `request_id`, whose groups
are bounded by the validated `final_k`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.functions import vectors
from tessarine.session import spread_by

ALL_RULES = tuple(rule for _, rule, _ in V.UNSAFE_RULES)


def input_safety(
    requests: DataFrame, query: str = "query", enabled: tuple[str, ...] = ALL_RULES
) -> DataFrame:
    """Add is_safe, category, matched_rule; the first matching rule wins."""
    unknown = set(enabled) - set(ALL_RULES)
    if unknown:
        raise ValueError("unknown input-safety rules: " + ", ".join(sorted(unknown)))
    normal = F.col("_normal")
    no_words = ~normal.rlike(r"[\p{L}\p{M}\p{N}]")
    rule = F.when(no_words, "non_lexical_input").when(
        T.has_control_characters(normal), "control_characters"
    )
    category = F.when(F.col("matched_rule").isNull(), "safe").when(
        F.col("matched_rule").isin("non_lexical_input", "control_characters"), "invalid"
    )
    for group, name, pattern in V.UNSAFE_RULES:
        if name in enabled:
            rule = rule.when(normal.rlike("(?isU)" + pattern), name)
            category = category.when(F.col("matched_rule") == name, group)
    return (
        requests.withColumn("_normal", T.strip(T.nfkc(F.col(query))))
        .withColumn("matched_rule", rule)
        .withColumn("category", category)
        .withColumn("is_safe", F.col("matched_rule").isNull())
        .drop("_normal")
    )


def query_coverage(query_tokens: Column, evidence_tokens: Column) -> Column:
    """Share of distinct question tokens found among all evidence tokens.

    A question of a single unmatched token of four or more characters may also occur
    inside the run-together evidence (scripts without spaces).
    """
    wanted = F.array_distinct(query_tokens)
    matched = F.size(F.array_intersect(wanted, evidence_tokens))
    only = F.element_at(wanted, 1)
    inside = (
        (F.size(wanted) == 1)
        & (matched == 0)
        & (F.char_length(only) >= 4)
        & F.contains(F.array_join(evidence_tokens, ""), only)
    )
    return (
        F.when(F.size(wanted) == 0, 0.0)
        .when(inside, 1.0)
        .otherwise(F.try_divide(matched, F.size(wanted)))
    )


def evidence_problem(evidence: DataFrame) -> DataFrame:
    """Add `problem`, the first problem of the request's evidence in rank order, else null.

    Row order is `pos` if that column exists, else rank; `_blank` tells of blank texts if it exists.  Per row the checks run as: blank text, repeated id, repeated rank, then for the
    prefix score and the full score: non-finite, out of range.
    """
    order = [F.col(c) for c in ("pos", "rank", "chunk_id") if c in evidence.columns]
    request = Window.partitionBy("request_id")

    def bad_score(name: str) -> list[tuple[Column, str]]:
        c = F.col(name)
        finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return [
            (~finite, f"non_finite_{name}"),
            (F.abs(c) > V.SCORE_BOUND, f"out_of_range_{name}"),
        ]

    checks = [
        (F.col("_blank") if "_blank" in evidence.columns else T.is_blank(F.col("text")), "blank_text"),
        (F.col("_id_n") > 1, "duplicate_chunk_id"),
        (F.col("_rank_n") > 1, "duplicate_rank"),
        *bad_score("mrl_score"),
        *bad_score("full_score"),
    ]
    own = F.lit(None).cast("string")
    for condition, name in reversed(checks):
        own = F.when(condition, name).otherwise(own)
    by = lambda c: Window.partitionBy("request_id", c).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        evidence.withColumn("_id_n", F.count(F.lit(1)).over(by("chunk_id")))
        .withColumn("_rank_n", F.count(F.lit(1)).over(by("rank")))
        .withColumn("_own", own)
        .withColumn(
            "problem",
            F.min_by("_own", F.when(F.col("_own").isNotNull(), F.struct(*order))).over(request),
        )
        .drop("_id_n", "_rank_n", "_own")
    )


def chunk_relevance(
    evidence: DataFrame,
    min_score: float = V.MIN_FULL_SCORE,
    strong_score: float = V.STRONG_FULL_SCORE,
    min_coverage: float = V.MIN_COVERAGE,
    strong_coverage: float = V.STRONG_COVERAGE,
    epsilon: float = V.RELEVANCE_EPSILON,
) -> DataFrame:
    """Add coverage and classification per chunk, from query_tokens and evidence_tokens."""
    if not -1 <= min_score <= strong_score <= 1:
        raise ValueError("score thresholds must satisfy -1 <= min <= strong <= 1")
    if not 0 <= min_coverage <= strong_coverage <= 1:
        raise ValueError("coverage thresholds must satisfy 0 <= min <= strong <= 1")
    score, coverage = F.col("full_score"), F.col("coverage")
    usable = score.isNotNull() & ~F.isnan(score)  # NaN >= x is true in Spark
    passes = lambda s, c: usable & (score + epsilon >= s) & (coverage >= c)
    return evidence.withColumn(
        "coverage", query_coverage(F.col("query_tokens"), F.col("evidence_tokens"))
    ).withColumn(
        "classification",
        F.when(passes(strong_score, strong_coverage), "correct")
        .when(passes(min_score, min_coverage), "ambiguous")
        .otherwise("incorrect"),
    )


def scope_mismatch(query_tokens: Column, scope_terms: tuple[str, ...]) -> Column:
    """True if terms are configured and none of their content tokens is in the question."""
    if not scope_terms:
        return F.lit(False)
    terms = F.flatten(F.array(*[T.content_tokens(F.lit(t)) for t in scope_terms]))
    return ~F.arrays_overlap(query_tokens, terms)


def set_relevance(rows: DataFrame, scope_terms: tuple[str, ...] = ()) -> DataFrame:
    """Per-request verdict next to each chunk row, by windows on `request_id`.

    Needs chunk_relevance and `problem`.  Adds set_class, accepted, confidence, reason.
    """
    request = Window.partitionBy("request_id")
    kind, coverage, score = F.col("classification"), F.col("coverage"), F.col("full_score")
    any_correct = F.max(kind == "correct").over(request)
    any_ambiguous = F.max(kind == "ambiguous").over(request)
    best_coverage = F.max("coverage").over(request)
    wanted = F.when(any_correct, kind == "correct").otherwise(kind == "ambiguous")
    strongest = F.max(
        F.when(F.col("_wanted"), F.struct(coverage, score, -F.col("rank")))
    ).over(request)
    signal = (vectors.score_to_unit(F.col("_best.full_score")) + F.col("_best.coverage")) / 2
    no_query = F.size("query_tokens") == 0
    broken = no_query | F.col("problem").isNotNull()
    out_of_scope = ~broken & scope_mismatch(F.col("query_tokens"), scope_terms)
    blocked = broken | out_of_scope
    return (
        rows.withColumn("_blocked", blocked)
        .withColumn("_scope", out_of_scope)
        .withColumn("_no_query", no_query)
        .withColumn("_wanted", ~blocked & wanted)
        .withColumn("_best", strongest)
        .withColumn(
            "set_class",
            F.when(F.col("_blocked"), "incorrect")
            .when(any_correct, "correct")
            .when(any_ambiguous, "ambiguous")
            .otherwise("incorrect"),
        )
        .withColumn("accepted", F.coalesce(F.col("_wanted"), F.lit(False)))
        .withColumn(
            "confidence",
            F.when(F.col("_scope"), 0.95)
            .when(F.col("_blocked"), 1.0)
            .when(F.col("set_class") != "incorrect", F.least(F.lit(0.95), F.greatest(F.lit(0.0), signal)))
            .when(best_coverage == 0, 0.90)
            .otherwise(0.60),
        )
        .withColumn(
            "reason",
            F.when(F.col("_no_query"), "invalid_query")
            .when(F.col("problem").isNotNull(), "invalid_evidence")
            .when(F.col("_scope"), "off_topic")
            .when(F.col("set_class") == "correct", "relevant_evidence")
            .when(F.col("set_class") == "ambiguous", "ambiguous_retrieval")
            .when(best_coverage == 0, "off_topic")
            .otherwise("no_relevant_context"),
        )
        .drop("_blocked", "_scope", "_no_query", "_wanted", "_best")
    )


def assess_relevance(evidence: DataFrame, scope_terms: tuple[str, ...] = (), only_correct: bool = False) -> DataFrame:
    """Evidence rows (request_id, query, chunk_id, text, scores, rank) to verdict rows.

    One distribution by request serves every window from here to the answer, including
    those that partition by (request_id, chunk_id) or (request_id, span).  Rows are judged before it,
    where their text is, so text and tokens travel only if a later step reads them; with `only_correct`
    those of `correct` rows alone do, the only ones that answers are taken from, and others are null.
    """
    tokens = evidence.withColumn("query_tokens", T.content_tokens(F.col("query"))).withColumn(
        "evidence_tokens", T.lexical_tokens(F.col("text"))
    )
    judged = chunk_relevance(tokens).withColumn("_blank", T.is_blank(F.col("text")))
    if only_correct:
        correct = F.col("classification") == "correct"
        judged = judged.withColumns({c: F.when(correct, F.col(c)) for c in ("text", "evidence_tokens")})
    return set_relevance(evidence_problem(spread_by(judged, "request_id")).drop("_blank"), scope_terms)


def relevance_set(assessed: DataFrame) -> DataFrame:
    """One row per request from assessed rows; accepted ids in rank order."""
    accepted = F.collect_list(F.when(F.col("accepted"), F.struct("rank", "chunk_id")))
    return assessed.groupBy("request_id").agg(
        F.first("set_class").alias("classification"),
        F.first("confidence").alias("confidence"),
        F.first("reason").alias("reason"),
        F.transform(F.array_sort(accepted), lambda s: s["chunk_id"]).alias("accepted_chunk_ids"),
        F.max("coverage").alias("best_coverage"),
        F.max("problem").alias("problem"),
    )


def relevance_refusal(classification: Column, reason: Column) -> Column:
    """Refusal reason of a verdict, null if it is `correct`."""
    return (
        F.when(classification == "ambiguous", "ambiguous_retrieval")
        .when((classification == "incorrect") & (reason == "off_topic"), "off_topic")
        .when(classification == "incorrect", "no_relevant_context")
    )


def sensitive_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.isin(*V.NEGATION_TOKENS) | t.rlike(r"\p{N}"))


def sentence_support(claim_tokens: Column, claim_content: Column, evidence: Column) -> Column:
    """Multiset share of claim content tokens present in the evidence tokens.

    0 if a negation or a number of the claim is missing from the evidence.  The
    evidence is first cut to tokens the claim holds, so counting stays short.
    """
    shared = F.filter(evidence, lambda t: F.array_contains(claim_content, t))

    def matched(total: Column, token: Column) -> Column:
        have = F.size(F.filter(claim_content, lambda t: t == token))
        found = F.size(F.filter(shared, lambda t: t == token))
        return total + F.least(have, found)

    overlap = F.aggregate(F.array_distinct(claim_content), F.lit(0), matched)
    missing = F.size(F.array_except(sensitive_tokens(claim_tokens), evidence)) > 0
    return (
        F.when((F.size(claim_content) == 0) | missing, 0.0)
        .otherwise(F.try_divide(overlap, F.size(claim_content)))
    )


def is_safe_refusal(answer: Column, refusals: tuple[str, ...] = (V.SAFE_REFUSAL_TEXT,)) -> Column:
    """The whole answer is one configured refusal, up to spacing and case."""
    plain = T.collapse_spaces(F.lower(answer))
    return F.coalesce(plain.isin(*[" ".join(r.split()).casefold() for r in refusals]), F.lit(False))


def claims_of(answers: DataFrame) -> DataFrame:
    """One row per sentence of each answer, list marks removed; `is_claim` if it has words.

    An answer without sentences keeps one row with a null claim.
    """
    return (
        answers.withColumn("_sentences", T.sentences(F.col("answer")))
        .select("*", F.posexplode_outer("_sentences").alias("claim_index", "_claim"))
        .withColumn("claim", T.strip_markdown_prefix(F.col("_claim")))
        .withColumn(
            "is_claim", F.coalesce(F.col("claim").rlike(r"[\p{L}\p{M}\p{N}]"), F.lit(False))
        )
        .drop("_claim", "_sentences")
    )


def groundedness(
    answers: DataFrame,
    min_support: float = V.MIN_SUPPORT,
    ambiguous_support: float = V.AMBIGUOUS_SUPPORT,
    min_judge_budget_ms: float = V.MIN_JUDGE_BUDGET_MS,
    refusals: tuple[str, ...] = (V.SAFE_REFUSAL_TEXT,),
) -> DataFrame:
    """Check every claim of an answer against the chunks it cites.

    `answers`: request_id, answer, evidence array<struct<chunk_id, tokens>> (bounded by
    final_k) and optionally problem, judge_verdict, budget_ms.  A judge's verdict counts
    only if claims are ambiguous, none is unsupported and the budget allows it.
    """
    if not 0 <= ambiguous_support <= min_support <= 1:
        raise ValueError("thresholds must satisfy 0 <= ambiguous <= minimum <= 1")
    has_judge = F.lit("judge_verdict" in answers.columns)
    for name, kind in (("problem", "string"), ("judge_verdict", "boolean"), ("budget_ms", "double")):
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit(None).cast(kind))
    carried = [c for c in answers.columns if c != "request_id"]
    checked = (
        claims_of(answers)
        .withColumn("cited", T.citations(F.col("claim")))
        .withColumn("plain", T.strip_citations(F.col("claim")))
        .withColumn("claim_tokens", T.lexical_tokens(F.col("plain")))
        .withColumn("claim_content", T.drop_function_words(F.col("claim_tokens"), V.ENGLISH_FUNCTION_WORDS))
        .withColumn("known", F.transform("evidence", lambda e: e["chunk_id"]))
        .withColumn(
            "cited_tokens",
            F.flatten(
                F.transform(
                    F.filter("evidence", lambda e: F.array_contains(F.col("cited"), e["chunk_id"])),
                    lambda e: e["tokens"],
                )
            ),
        )
        .withColumn(
            "valid",
            F.col("is_claim")
            & (F.size("cited") > 0)
            & (F.size(F.array_except("cited", "known")) == 0)
            & (F.size("claim_content") > 0),
        )
        .withColumn(
            "support",
            F.when(
                F.col("valid"),
                sentence_support(F.col("claim_tokens"), F.col("claim_content"), F.col("cited_tokens")),
            ).otherwise(0.0),
        )
        .withColumn(
            "verdict",
            F.when(~F.col("is_claim"), F.lit(None).cast("string"))
            .when(F.col("valid") & (F.col("support") >= min_support), "supported")
            .when(F.col("valid") & (F.col("support") >= ambiguous_support), "ambiguous")
            .otherwise("unsupported"),
        )
    )
    pick = lambda v, c: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.struct("claim_index", c.alias("x"))))),
        lambda s: s["x"],
    )
    per_answer = checked.groupBy("request_id").agg(
        F.nullif(F.count_if("is_claim"), F.lit(0)).alias("claims"),
        F.avg(F.when(F.col("is_claim"), F.col("support"))).alias("score"),
        F.array_distinct(F.flatten(pick("supported", F.col("cited")))).alias("supporting_chunk_ids"),
        F.count_if(F.col("verdict") == "ambiguous").alias("ambiguous_claims"),
        F.count_if(F.col("verdict") == "unsupported").alias("unsupported"),
        pick("unsupported", F.when(F.col("plain") != "", F.col("plain")).otherwise(F.col("claim"))).alias("_unsupported"),
        pick("ambiguous", F.col("plain")).alias("_ambiguous"),
        *[F.first(c).alias(c) for c in carried],
    )
    none = F.array().cast("array<string>")
    refusal = is_safe_refusal(F.col("answer"), refusals)
    empty = ~F.coalesce(F.col("answer"), F.lit("")).rlike(r"[\p{L}\p{M}\p{N}]")
    broken = F.col("problem").isNotNull() | (F.size("evidence") == 0)
    affordable = has_judge & (F.coalesce(F.col("budget_ms"), F.lit(-1.0)) >= min_judge_budget_ms)
    asked = affordable & (F.col("ambiguous_claims") > 0) & (F.col("unsupported") == 0)
    early = refusal | empty | broken | F.col("claims").isNull()
    accepted = ~early & asked & F.coalesce(F.col("judge_verdict"), F.lit(False))
    grounded = ~early & (
        ((F.col("unsupported") == 0) & (F.col("ambiguous_claims") == 0)) | accepted
    )
    return (
        per_answer.withColumn("is_grounded", F.coalesce(grounded, F.lit(False)))
        .withColumn("_accepted", F.coalesce(accepted, F.lit(False)))
        .withColumn(
            "judge_used",
            F.coalesce(F.col("_accepted") | (~early & ~F.col("is_grounded") & affordable), F.lit(False)),
        )
        .withColumn(
            "ground_reason",
            F.when(refusal, "safe_refusal")
            .when(empty, "invalid_answer")
            .when(broken, "invalid_evidence")
            .when(F.col("claims").isNull(), "invalid_answer")
            .when(F.col("is_grounded"), "grounded_answer")
            .otherwise("ungrounded_answer"),
        )
        .withColumn(
            "unsupported_claims",
            F.when(refusal, none)
            .when(empty, F.array(F.lit("<empty answer>")))
            .when(broken, F.array(T.strip(F.col("answer"))))
            .when(F.col("claims").isNull(), F.array(F.lit("<no factual sentence>")))
            .when(F.col("is_grounded"), none)
            .when(F.size("_unsupported") > 0, F.col("_unsupported"))
            .otherwise(F.col("_ambiguous")),
        )
        .withColumn("ground_score", F.when(early, 0.0).otherwise(F.col("score")))
        .withColumn(
            "supporting_chunk_ids",
            F.when(early, none)
            .when(F.col("_accepted"), F.array_distinct(T.citations(F.col("answer"))))
            .otherwise(F.col("supporting_chunk_ids")),
        )
        .drop("score", "claims", "ambiguous_claims", "unsupported", "_unsupported", "_ambiguous", "_accepted")
    )


def citation_contract(answers: DataFrame) -> DataFrame:
    """Add `violation` (null if fine) and `cited`, from answer, finish_reason, known ids."""
    cites = T.citations(F.col("answer"))
    refusal = F.col("answer") == V.SAFE_REFUSAL_TEXT
    unknown = F.array_sort(F.array_except(cites, F.col("known")))
    violation = (
        F.when(~F.col("finish_reason").eqNullSafe(F.lit("stop")), "not_finished")
        .when(refusal, F.lit(None).cast("string"))
        .when(F.size(cites) == 0, "no_citation")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(unknown, ",")))
    )
    return answers.withColumn("violation", violation).withColumn(
        "cited",
        F.when(refusal | violation.isNotNull(), F.array().cast("array<string>")).otherwise(
            F.array_distinct(cites)
        ),
    )


def unknown_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request_id, chunk_id) cited but absent from the request's evidence."""
    cited = answers.select("request_id", F.explode(T.citations(F.col("answer"))).alias("chunk_id")).distinct()
    return cited.join(evidence.select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_anti")


def token_overlap(mine: DataFrame, theirs: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Multiset overlap `matched` of token rows per `keys`, against the tokens of the same `shared` keys.

    Tokens are counted before they meet, so a frequent token is one row on each side.
    """
    left = mine.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    right = theirs.groupBy(*shared, "token").agg(F.count(F.lit(1)).alias("m"))
    return left.join(right, [*shared, "token"]).groupBy(*keys).agg(F.sum(F.least("n", "m")).alias("matched"))

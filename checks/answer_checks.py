"""Guardrail, answer selection, request and end-to-end keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.base import CTES, content, query, r6, sents, strip, tok, words
from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.functions import vectors
from tessarine.operators import answers as A
from tessarine.operators import guardrails as G
from tessarine.operators import requests as R
from tessarine.operators import retrieval as K
from tessarine.plans import answer_batch as P
from tessarine.session import materialize

# Safety -----------------------------------------------------------------------

_rules = " ".join(
    f"WHEN regexp_matches(q, '{pattern.replace(chr(39), chr(39) * 2)}', 'is') THEN '{rule}'"
    for _, rule, pattern in V.UNSAFE_RULES
)
_categories = " ".join(f"WHEN '{rule}' THEN '{group}'" for group, rule, _ in V.UNSAFE_RULES)


def _safety(source: str) -> str:
    return rf"""SELECT *, CASE matched_rule WHEN 'non_lexical_input' THEN 'invalid' WHEN 'control_characters' THEN 'invalid'
    {_categories} ELSE 'safe' END AS category, matched_rule IS NULL AS is_safe FROM (
    SELECT *, CASE WHEN NOT regexp_matches(q, '[\p{{L}}\p{{M}}\p{{N}}]') THEN 'non_lexical_input'
      WHEN regexp_matches(q, '{V.CONTROL_CHARACTERS}') THEN 'control_characters' {_rules} END AS matched_rule
    FROM (SELECT *, {strip("query")} AS q FROM {source}))"""


CTES["fx_safety"] = _safety("fx_requests")


@query("input_safety", "SELECT request_id, category, matched_rule, is_safe FROM fx_safety")
def input_safety(spark, sf):
    return G.input_safety(X.requests(spark, sf)).select("request_id", "category", "matched_rule", "is_safe")


# Evidence ---------------------------------------------------------------------

EVIDENCE = ["request_id", "query", "language_code", "budget_ms", "chunk_id", "document_id", "text", "mrl_score", "full_score", "rank"]


def evidence(spark, sf):
    """Final rows of every request, safe or not, with chunk text."""
    return P.retrieve_evidence(X.requests(spark, sf), X.chunks(spark, sf))


def assessed(spark, sf):
    return G.assess_relevance(evidence(spark, sf))


CTES["fx_evidence"] = """
SELECT k.request_id, k.query, k.language_code, k.budget_ms, k.chunk_id, c.document_id, c.text, k.mrl_score, k.full_score, k.rank
FROM fx_cut k JOIN fx_chunks c ON c.chunk_id = k.chunk_id"""
CTES["fx_etok"] = f"SELECT chunk_id, {tok('text')} AS et FROM fx_chunks"
CTES["fx_qtok"] = f"""SELECT request_id, list_distinct({content("qt", V.ENGLISH_FUNCTION_WORDS)}) AS qc, qt
FROM (SELECT request_id, {tok("query")} AS qt FROM fx_requests)"""
CTES["fx_cov"] = f"""
SELECT e.*, q.qc, t.et, CASE WHEN len(qc) = 0 THEN 0.0
  WHEN len(qc) = 1 AND NOT list_contains(et, qc[1]) AND length(qc[1]) >= 4 AND contains(array_to_string(et, ''), qc[1]) THEN 1.0
  ELSE len(list_filter(qc, lambda t: list_contains(et, t))) / len(qc) END AS coverage
FROM fx_evidence e JOIN fx_qtok q USING (request_id) JOIN fx_etok t ON t.chunk_id = e.chunk_id"""
CTES["fx_class"] = """
SELECT *, CASE WHEN full_score + 1e-4 >= 0.68 AND coverage >= 0.60 THEN 'correct'
   WHEN full_score + 1e-4 >= 0.58 AND coverage >= 0.34 THEN 'ambiguous' ELSE 'incorrect' END AS classification FROM fx_cov"""
CTES["fx_set"] = """
SELECT c.*, best_coverage, CASE WHEN nc > 0 THEN 'correct' WHEN na > 0 THEN 'ambiguous' ELSE 'incorrect' END AS set_class,
  len(qc) > 0 AND ((nc > 0 AND classification = 'correct') OR (nc = 0 AND classification = 'ambiguous')) AS accepted,
  CASE WHEN len(qc) = 0 THEN 'invalid_query' WHEN nc > 0 THEN 'relevant_evidence' WHEN na > 0 THEN 'ambiguous_retrieval'
       WHEN best_coverage = 0 THEN 'off_topic' ELSE 'no_relevant_context' END AS reason
FROM fx_class c JOIN (SELECT request_id, count_if(classification = 'correct') AS nc, count_if(classification = 'ambiguous') AS na,
   max(coverage) AS best_coverage FROM fx_class GROUP BY request_id) s USING (request_id)"""
CTES["fx_relset"] = """
SELECT s.request_id, any_value(set_class) AS classification, any_value(reason) AS reason, any_value(best_coverage) AS best_coverage,
  coalesce(string_agg(chunk_id, '|' ORDER BY rank) FILTER (accepted), '') AS accepted_ids,
  CASE any_value(reason) WHEN 'invalid_query' THEN 1.0 WHEN 'off_topic' THEN 0.90 WHEN 'no_relevant_context' THEN 0.60
    ELSE least(0.95, greatest(0.0, (least(1.0, greatest(0.0, (arg_max(full_score, {c: coverage, s: full_score, r: -rank}) FILTER (accepted) + 1) / 2))
      + arg_max(coverage, {c: coverage, s: full_score, r: -rank}) FILTER (accepted)) / 2)) END AS confidence
FROM fx_set s GROUP BY s.request_id"""


@query("query_coverage", "SELECT request_id, chunk_id, round(coverage, 6) AS coverage FROM fx_cov")
def query_coverage(spark, sf):
    tokens = evidence(spark, sf).withColumn("q", T.content_tokens(F.col("query"))).withColumn("e", T.lexical_tokens(F.col("text")))
    return tokens.select("request_id", "chunk_id", r6(G.query_coverage(F.col("q"), F.col("e"))).alias("coverage"))


@query("chunk_relevance", "SELECT request_id, chunk_id, classification, round(coverage, 6) AS coverage FROM fx_class")
def chunk_relevance(spark, sf):
    return assessed(spark, sf).select("request_id", "chunk_id", "classification", r6("coverage").alias("coverage"))


_RELSET = "SELECT request_id, classification, reason, accepted_ids, round(confidence, 6) AS confidence FROM fx_relset"


def relset(spark, sf):
    return G.relevance_set(assessed(spark, sf))


@query("relevance_set", _RELSET)
def relevance_set(spark, sf):
    return relset(spark, sf).select(
        "request_id", "classification", "reason",
        F.array_join("accepted_chunk_ids", "|").alias("accepted_ids"), r6("confidence").alias("confidence"),
    )


_SCOPE = ("the of and la de el le und der", "eauouon")
CTES["fx_scope"] = f"""SELECT list_distinct(list_concat({", ".join(content(tok("'" + s + "'"), V.ENGLISH_FUNCTION_WORDS) for s in _SCOPE)})) AS terms"""


@query(
    "scope_gate",
    """SELECT request_id, len(qc) > 0 AND NOT list_has_any(qc, terms) AS out_of_scope,
         CASE WHEN len(qc) > 0 AND NOT list_has_any(qc, terms) THEN 0.95::DOUBLE END AS confidence
       FROM fx_qtok JOIN (SELECT DISTINCT request_id FROM fx_evidence) USING (request_id), fx_scope""",
)
def scope_gate(spark, sf):
    judged = G.relevance_set(G.assess_relevance(evidence(spark, sf), _SCOPE))
    out = (F.col("reason") == "off_topic") & (F.col("confidence") == 0.95)
    return judged.select("request_id", out.alias("out_of_scope"), F.when(out, F.col("confidence")).alias("confidence"))


@query(
    "relevance_refusal",
    """SELECT request_id, CASE WHEN classification = 'ambiguous' THEN 'ambiguous_retrieval'
       WHEN classification = 'incorrect' AND reason = 'off_topic' THEN 'off_topic'
       WHEN classification = 'incorrect' THEN 'no_relevant_context' END AS refusal FROM fx_relset""",
)
def relevance_refusal(spark, sf):
    return relset(spark, sf).select(
        "request_id", G.relevance_refusal(F.col("classification"), F.col("reason")).alias("refusal")
    )


@query("accepted_evidence", "SELECT request_id, chunk_id, rank FROM fx_set WHERE accepted")
def accepted_evidence(spark, sf):
    narrow = assessed(spark, sf).drop("query", "text", "query_tokens", "evidence_tokens")
    rows = materialize(narrow, "assessed")  # read twice: the search runs once
    accepted = G.relevance_set(rows).select("request_id", F.explode("accepted_chunk_ids").alias("chunk_id"))
    return R.accepted_evidence(rows, accepted).select("request_id", "chunk_id", "rank")


@query(
    "validate_evidence",
    """SELECT request_id, arg_min(p, {r: rank, c: chunk_id}) FILTER (p IS NOT NULL) AS problem FROM (
       SELECT request_id, rank2 AS rank, chunk_id, CASE WHEN row_number() OVER (PARTITION BY request_id, rank2 ORDER BY chunk_id) > 1 THEN 'duplicate_rank'
         WHEN s IS NULL THEN 'non_finite_full_score' WHEN abs(mrl_score) > 1.0001 THEN 'out_of_range_mrl_score' WHEN abs(s) > 1.0001 THEN 'out_of_range_full_score' END AS p
       FROM (SELECT *, CASE WHEN rank = 5 AND right(request_id, 1) = '3' THEN 4 ELSE rank END AS rank2,
          CASE WHEN right(request_id, 1) = '7' AND rank = 2 THEN 1.5 WHEN right(request_id, 1) = '8' AND rank = 3 THEN NULL ELSE full_score END AS s FROM fx_evidence))
       GROUP BY request_id""",
)
def validate_evidence(spark, sf):
    """Evidence with some ranks and scores spoilt on purpose."""
    last = F.substring("request_id", -1, 1)
    spoilt = (
        evidence(spark, sf)
        .withColumn("full_score", F.when((last == "7") & (F.col("rank") == 2), 1.5).when((last == "8") & (F.col("rank") == 3), float("nan")).otherwise(F.col("full_score")))
        .withColumn("rank", F.when((last == "3") & (F.col("rank") == 5), 4).otherwise(F.col("rank")))
    )
    return G.evidence_problem(spoilt).groupBy("request_id").agg(F.max("problem").alias("problem"))


# Claims and grounding -----------------------------------------------------------
# Answers under test: two sentences of the request's own chunk, cited to it, with a
# changed number, an added negation, an unknown citation or a missing one by turn.

CTES["fx_answers"] = r"""
SELECT request_id, own_chunk_id, CASE doc_id % 6
   WHEN 0 THEN '[chunk:' || own_chunk_id || '] ' || base
   WHEN 1 THEN base || ' never [chunk:' || own_chunk_id || ']'
   WHEN 2 THEN base || ' 77123 [chunk:' || own_chunk_id || ']'
   WHEN 3 THEN '- ' || base || ' [chunk:invented]'
   WHEN 4 THEN 'I cannot  answer from the PROVIDED context.'
   ELSE base END AS answer, CASE WHEN doc_id % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason
FROM (SELECT 'r' || doc_id AS request_id, chunk_id AS own_chunk_id, doc_id, base FROM fx_base)"""


def sample_answers(spark, sf):
    """Own-chunk answers in six variants, each with its evidence tokens."""
    own = X.chunks(spark, sf).withColumn("s", T.sentences(F.col("text")))
    base = F.coalesce(F.try_element_at("s", F.lit(2)), F.try_element_at("s", F.lit(1)), F.lit(""))
    cite = F.concat(F.lit("[chunk:"), F.col("chunk_id"), F.lit("]"))
    v = F.col("doc_id") % 6
    answer = (
        F.when(v == 0, F.concat(cite, F.lit(" "), base))
        .when(v == 1, F.concat(base, F.lit(" never "), cite))
        .when(v == 2, F.concat(base, F.lit(" 77123 "), cite))
        .when(v == 3, F.concat(F.lit("- "), base, F.lit(" [chunk:invented]")))
        .when(v == 4, F.lit("I cannot  answer from the PROVIDED context."))
        .otherwise(base)
    )
    tokens = T.lexical_tokens(F.col("text"))
    return own.select(
        F.concat(F.lit("r"), "doc_id").alias("request_id"),
        "chunk_id",
        answer.alias("answer"),
        F.when(F.col("doc_id") % 7 == 0, "length").otherwise("stop").alias("finish_reason"),
        F.array(F.struct("chunk_id", tokens.alias("tokens"))).alias("evidence"),
    )


CTES["fx_claims"] = rf"""
SELECT request_id, own_chunk_id, i AS claim_index, claim, regexp_extract_all(claim, '\[chunk:([^\]\s]+)\]', 1) AS cited,
  {strip(r"regexp_replace(claim, '\[chunk:([^\]\s]+)\]', '', 'g')")} AS plain
FROM (SELECT request_id, own_chunk_id, unnest(range(len(s))) AS i,
   regexp_replace(unnest(s), '^\s*(?:[-*+]\s+|#{{1,6}}\s+|\d+[.)]\s+)', '') AS claim
   FROM (SELECT *, {sents("answer")} AS s FROM fx_answers))
WHERE regexp_matches(claim, '[\p{{L}}\p{{M}}\p{{N}}]')"""
CTES["fx_ctok"] = f"SELECT *, {tok('plain')} AS ct FROM fx_claims"
CTES["fx_ccont"] = f"SELECT c.*, {content('ct', V.ENGLISH_FUNCTION_WORDS)} AS cc, t.et FROM fx_ctok c JOIN fx_etok t ON t.chunk_id = c.own_chunk_id"
CTES["fx_counts"] = """
SELECT request_id, claim_index, sum(least(n, m))::BIGINT AS matched FROM (
  SELECT request_id, claim_index, tk, count(*) AS n FROM (SELECT request_id, claim_index, unnest(cc) AS tk FROM fx_ccont) GROUP BY ALL) a
  JOIN (SELECT 'r' || split_part(chunk_id, ':', 2) AS request_id, tk, count(*) AS m FROM (SELECT chunk_id, unnest(et) AS tk FROM fx_etok) GROUP BY ALL) b USING (request_id, tk)
GROUP BY request_id, claim_index"""
CTES["fx_support"] = rf"""
SELECT c.*, coalesce(matched, 0) AS matched, len(cc) AS claim_n,
  len(list_filter(ct, lambda t: (list_contains({words(V.NEGATION_TOKENS)}, t) OR regexp_matches(t, '\p{{N}}')) AND NOT list_contains(et, t))) AS missing
FROM fx_ccont c LEFT JOIN fx_counts n USING (request_id, claim_index)"""
CTES["fx_verdict"] = """
SELECT *, CASE WHEN valid THEN CASE WHEN claim_n = 0 OR missing > 0 THEN 0.0 ELSE matched / claim_n END ELSE 0.0 END AS support FROM (
  SELECT *, len(cited) > 0 AND len(list_filter(cited, lambda c: c <> own_chunk_id)) = 0 AND claim_n > 0 AS valid FROM fx_support)"""


def own_claims(spark, sf):
    claims = G.claims_of(sample_answers(spark, sf)).filter("is_claim")
    return (
        claims.withColumn("plain", T.strip_citations(F.col("claim")))
        .withColumn("claim_tokens", T.lexical_tokens(F.col("plain")))
        .withColumn("claim_content", T.drop_function_words(F.col("claim_tokens"), V.ENGLISH_FUNCTION_WORDS))
        .withColumn("held", F.col("evidence")[0]["tokens"])
    )


@query(
    "sentence_support",
    """SELECT request_id, claim_index, round(CASE WHEN claim_n = 0 OR missing > 0 THEN 0.0 ELSE matched / claim_n END, 6) AS support FROM fx_support""",
)
def sentence_support(spark, sf):
    support = G.sentence_support(F.col("claim_tokens"), F.col("claim_content"), F.col("held"))
    return own_claims(spark, sf).select("request_id", F.col("claim_index").cast("long").alias("claim_index"), r6(support).alias("support"))


@query("token_intersection", "SELECT request_id, claim_index, matched, claim_n FROM fx_support")
def token_intersection(spark, sf):
    """Multiset overlap of claim and evidence tokens, counted by joins on the token."""
    claims = own_claims(spark, sf)
    mine = claims.select("request_id", "claim_index", F.explode("claim_content").alias("token"))
    held = sample_answers(spark, sf).select("request_id", F.explode(F.col("evidence")[0]["tokens"]).alias("token"))
    matched = G.token_overlap(mine, held, ["request_id", "claim_index"], ["request_id"])
    return claims.select("request_id", "claim_index", F.size("claim_content").cast("long").alias("claim_n")).join(
        matched, ["request_id", "claim_index"], "left"
    ).select("request_id", F.col("claim_index").cast("long").alias("claim_index"), F.coalesce("matched", F.lit(0)).alias("matched"), "claim_n")


@query(
    "token_difference",
    rf"""SELECT request_id, claim_index, array_to_string(list_sort(list_distinct(list_filter(ct, lambda t:
       (list_contains({words(V.NEGATION_TOKENS)}, t) OR regexp_matches(t, '\p{{N}}')) AND NOT list_contains(et, t)))), '|') AS missing FROM fx_ccont""",
)
def token_difference(spark, sf):
    missing = F.array_except(G.sensitive_tokens(F.col("claim_tokens")), F.col("held"))
    return own_claims(spark, sf).select(
        "request_id", F.col("claim_index").cast("long").alias("claim_index"), F.array_join(F.array_sort(missing), "|").alias("missing")
    )


_REFUSAL = r"lower(regexp_replace(trim(regexp_replace(answer, '\s+', ' ', 'g')), '\s+', ' ', 'g')) = 'i cannot answer from the provided context.'"


@query("safe_refusal_match", f"SELECT request_id, {_REFUSAL} AS refused FROM fx_answers")
def safe_refusal_match(spark, sf):
    return sample_answers(spark, sf).select("request_id", G.is_safe_refusal(F.col("answer")).alias("refused"))


def _ground(judge: bool) -> str:
    """SQL of the groundedness verdict; the judge accepts even requests within budget."""
    ask = "na > 0 AND nu = 0 AND doc % 2 = 0 AND doc % 3 > 0" if judge else "false"
    used = (
        "NOT early AND doc % 3 > 0 AND ((na > 0 AND nu = 0 AND doc % 2 = 0) OR nu > 0 OR na > 0)" if judge else "false"
    )
    return rf"""
SELECT request_id, NOT early AND ((coalesce(nu, 0) = 0 AND coalesce(na, 0) = 0) OR ({ask})) AS is_grounded,
  {used} AS judge_used, round(CASE WHEN early THEN 0.0 ELSE score END, 6) AS score,
  CASE WHEN early THEN '' WHEN {ask} THEN own_chunk_id ELSE coalesce(ids, '') END AS supporting,
  CASE WHEN refused THEN 'safe_refusal' WHEN empty OR score IS NULL THEN 'invalid_answer'
    WHEN (nu = 0 AND na = 0) OR ({ask}) THEN 'grounded_answer' ELSE 'ungrounded_answer' END AS reason
FROM (SELECT a.*, v.*  EXCLUDE (request_id), refused OR empty OR score IS NULL AS early FROM (
   SELECT request_id, own_chunk_id, substring(request_id, 2)::BIGINT AS doc, {_REFUSAL} AS refused, NOT regexp_matches(answer, '[\p{{L}}\p{{M}}\p{{N}}]') AS empty FROM fx_answers) a
  LEFT JOIN (SELECT request_id, avg(support) AS score, count_if(valid AND support < 0.8 AND support >= 0.6) AS na,
     count_if(NOT valid OR support < 0.6) AS nu, max(CASE WHEN valid AND support >= 0.8 THEN own_chunk_id END) AS ids
     FROM fx_verdict GROUP BY request_id) v USING (request_id))"""


def _grounded(df):
    return df.select(
        "request_id", "is_grounded", "judge_used", r6("ground_score").alias("score"),
        F.array_join("supporting_chunk_ids", "|").alias("supporting"), F.col("ground_reason").alias("reason"),
    )


@query("groundedness", _ground(False))
def groundedness(spark, sf):
    return _grounded(G.groundedness(sample_answers(spark, sf)))


@query("judge_gate", _ground(True))
def judge_gate(spark, sf):
    """Verdict and budget arrive as columns; a third of the requests has no time to ask."""
    doc = F.substring("request_id", 2, 20).cast("long")
    judged = sample_answers(spark, sf).withColumn("judge_verdict", doc % 2 == 0).withColumn(
        "budget_ms", F.when(doc % 3 == 0, 74.0).otherwise(75.0)
    )
    return _grounded(G.groundedness(judged))


@query(
    "citation_contract",
    r"""SELECT request_id, CASE WHEN finish_reason <> 'stop' THEN 'not_finished' WHEN answer = 'I cannot answer from the provided context.' THEN NULL
       WHEN len(c) = 0 THEN 'no_citation' WHEN len(list_filter(c, lambda x: x <> own_chunk_id)) > 0 THEN 'unknown:invented' END AS violation,
       CASE WHEN finish_reason = 'stop' AND len(c) > 0 AND NOT list_contains(c, 'invented') THEN array_to_string(list_distinct(c), '|') ELSE '' END AS cited
       FROM (SELECT *, regexp_extract_all(answer, '\[chunk:([^\]\s]+)\]', 1) AS c FROM fx_answers)""",
)
def citation_contract(spark, sf):
    known = sample_answers(spark, sf).withColumn("known", F.array("chunk_id"))
    return G.citation_contract(known).select("request_id", "violation", F.array_join("cited", "|").alias("cited"))


@query(
    "unknown_citations",
    "SELECT DISTINCT request_id, c AS chunk_id FROM (SELECT request_id, own_chunk_id, unnest(cited) AS c FROM fx_claims) WHERE c <> own_chunk_id",
)
def unknown_citations(spark, sf):
    answers = sample_answers(spark, sf)
    return G.unknown_citations(answers, answers.select("request_id", "chunk_id"))


@query(
    "extract_citations",
    r"""SELECT request_id, array_to_string(regexp_extract_all(answer, '\[chunk:([^\]\s]+)\]', 1), '|') AS ids,
       trim(regexp_replace(answer, '\[chunk:([^\]\s]+)\]', '', 'g')) AS plain FROM fx_answers""",
)
def extract_citations(spark, sf):
    a = F.col("answer")
    return sample_answers(spark, sf).select("request_id", F.array_join(T.citations(a), "|").alias("ids"), T.strip_citations(a).alias("plain"))


@query("strip_citations", r"SELECT request_id, claim_index, plain FROM fx_claims")
def strip_citations(spark, sf):
    return own_claims(spark, sf).select("request_id", F.col("claim_index").cast("long").alias("claim_index"), "plain")


@query(
    "strip_markdown_prefix",
    r"""SELECT request_id, regexp_replace(answer, '^\s*(?:[-*+]\s+|#{1,6}\s+|\d+[.)]\s+)', '') AS plain FROM fx_answers""",
)
def strip_markdown_prefix(spark, sf):
    return sample_answers(spark, sf).select("request_id", T.strip_markdown_prefix(F.col("answer")).alias("plain"))


@query(
    "first_seen_evidence",
    """SELECT doc_id, array_to_string(list_transform(list_filter(['a', 'b', 'c'], lambda x: x <> 'c' OR doc_id % 2 = 0),
       lambda x: CASE WHEN (doc_id % 3 = 0) = (x = 'a') THEN x || doc_id ELSE x || (doc_id + 1) END), '|') AS first_seen FROM documents""",
)
def first_seen_evidence(spark, sf):
    """Answers citing known, repeated and unknown ids in an order of their own."""
    n, after = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    own = [F.concat(F.lit(x), F.when((F.col("doc_id") % 3 == 0) == F.lit(x == "a"), n).otherwise(after)) for x in "abc"]
    cite = lambda c: F.concat(F.lit(" [chunk:"), c, F.lit("]"))
    answer = F.concat(F.lit("It"), cite(own[0]), cite(F.lit("invented")), cite(own[1]), cite(own[0]), cite(own[2]), cite(own[1]))
    known = F.when(F.col("doc_id") % 2 == 0, F.array(own[2], own[1], own[0])).otherwise(F.array(own[1], own[0]))
    return X.table(spark, sf, "documents").select("doc_id", F.array_join(A.first_seen(answer, known), "|").alias("first_seen"))


@query("safe_citation_id", r"SELECT request_id, regexp_matches(own_chunk_id, '^[^\]\s]+$') AS plain_id, regexp_matches(query, '^[^\]\s]+$') AS text_as_id FROM fx_requests")
def safe_citation_id(spark, sf):
    return X.requests(spark, sf).select(
        "request_id", T.is_safe_citation_id(F.col("own_chunk_id")).alias("plain_id"), T.is_safe_citation_id(F.col("query")).alias("text_as_id")
    )


@query(
    "context_json",
    """SELECT request_id, count(*) AS chunks, any_value(query) AS query, any_value(language_code) AS language, string_agg(chunk_id, '|' ORDER BY rank) AS ids,
       string_agg(md5(text), '|' ORDER BY rank) AS texts FROM fx_evidence GROUP BY request_id""",
)
def context_json(spark, sf):
    """The payload, read back from its JSON."""
    schema = "query string, requested_language_code string, context_chunks array<struct<chunk_id string, text string>>"
    read = A.context_json(evidence(spark, sf)).select("request_id", F.from_json("payload", schema).alias("p"))
    return read.select(
        "request_id",
        F.size("p.context_chunks").cast("long").alias("chunks"),
        F.col("p.query").alias("query"),
        F.col("p.requested_language_code").alias("language"),
        F.array_join("p.context_chunks.chunk_id", "|").alias("ids"),
        F.array_join(F.transform("p.context_chunks", lambda c: F.md5(c["text"].cast("binary"))), "|").alias("texts"),
    )


# Selection ------------------------------------------------------------------------

_conflict = " OR ".join(
    f"(list_has_any(qs, {words(a)}) AND list_has_any(st, {words(b)}))"
    for left, right in V.ANTONYM_GROUPS
    for a, b in ((left, right), (right, left))
)
_quantity = (
    f"(list_has_any(qs, {words(V.QUANTITY_QUESTION_TOKENS)}) AND len(list_filter(st, lambda t: regexp_matches(t, '\\p{{Nd}}'))) = 0 "
    f"AND NOT list_has_any(st, {words(V.NUMBER_WORDS)}))"
)
CTES["fx_usable"] = "SELECT * FROM fx_set WHERE accepted AND set_class = 'correct'"
CTES["fx_qsel"] = f"SELECT request_id, list_distinct({content('qt', V.SELECTION_FUNCTION_WORDS)}) AS qs FROM fx_qtok"
CTES["fx_spans"] = f"""
SELECT request_id, chunk_id, rank, full_score, unnest(range(len(s))) AS sentence_index, unnest(s) AS span
FROM (SELECT *, {sents("text")} AS s FROM fx_usable WHERE full_score + 1e-6 >= 0.68)"""
CTES["fx_stok0"] = f"SELECT *, {tok('span')} AS st0 FROM fx_spans"
CTES["fx_stok"] = f"SELECT * EXCLUDE (st0), list_distinct({content('st0', V.SELECTION_FUNCTION_WORDS)}) AS st FROM fx_stok0"
CTES["fx_matched"] = "SELECT s.*, qs, len(list_filter(qs, lambda t: list_contains(st, t))) AS matched FROM fx_stok s JOIN fx_qsel USING (request_id)"
CTES["fx_sentences"] = f"""
SELECT *, matched / len(qs) AS coverage, round(matched / len(qs) + 0.20 * least(1.0, greatest(0.0, (full_score + 1) / 2)) + 0.10 * (matched / len(st)), 9) AS selection_score
FROM fx_matched WHERE len(qs) >= 2 AND length(span) <= 600 AND len(st) >= 2 AND NOT ({_conflict}) AND NOT {_quantity}"""
CTES["fx_dedupe"] = """
SELECT * FROM fx_sentences QUALIFY row_number() OVER (PARTITION BY request_id, span ORDER BY selection_score DESC, rank, chunk_id, sentence_index) = 1"""
CTES["fx_best"] = """
SELECT *, selection_score - lead(selection_score) OVER w AS margin FROM fx_dedupe
WINDOW w AS (PARTITION BY request_id ORDER BY selection_score DESC, rank, chunk_id, sentence_index)
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY selection_score DESC, rank, chunk_id, sentence_index) = 1"""
CTES["fx_extract"] = """
SELECT r.request_id, r.budget_ms, b.chunk_id AS cited_chunk_id, coalesce('[chunk:' || b.chunk_id || '] ' || b.span, 'I cannot answer from the provided context.') AS answer
FROM fx_requests r LEFT JOIN (SELECT * FROM fx_best WHERE coverage + 1e-6 >= 0.60 AND (margin IS NULL OR margin + 1e-6 >= 0.08)) b USING (request_id)"""


def usable(spark, sf):
    rows = assessed(spark, sf)
    return rows.filter(F.col("accepted") & (F.col("set_class") == "correct")).select(*EVIDENCE)


@query("sentence_candidates", "SELECT request_id, chunk_id, sentence_index, span FROM fx_sentences")
def sentence_candidates(spark, sf):
    return A.sentence_candidates(usable(spark, sf)).select(
        "request_id", "chunk_id", F.col("sentence_index").cast("long").alias("sentence_index"), "span"
    )


@query("selection_score", "SELECT request_id, chunk_id, sentence_index, selection_score, round(coverage, 6) AS coverage FROM fx_sentences")
def selection_score(spark, sf):
    return A.sentence_candidates(usable(spark, sf)).select(
        "request_id", "chunk_id", F.col("sentence_index").cast("long").alias("sentence_index"), "selection_score", r6("sentence_coverage").alias("coverage")
    )


@query("span_dedupe", "SELECT request_id, chunk_id, span FROM fx_dedupe")
def span_dedupe(spark, sf):
    return A.span_dedupe(A.sentence_candidates(usable(spark, sf))).select("request_id", "chunk_id", "span")


@query("selection_margin", "SELECT request_id, chunk_id, span, round(margin, 6) AS margin FROM fx_best")
def selection_margin(spark, sf):
    best = A.selection_margin(A.span_dedupe(A.sentence_candidates(usable(spark, sf))))
    return best.select("request_id", "chunk_id", "span", r6("margin").alias("margin"))


@query("extractive_answer", "SELECT request_id, cited_chunk_id, answer FROM fx_extract")
def extractive_answer(spark, sf):
    return A.extractive_answer(X.requests(spark, sf), usable(spark, sf))


CTES["fx_routed"] = """
SELECT request_id, CASE WHEN e.answer <> 'I cannot answer from the provided context.' THEN 'extractive' WHEN budget_ms < 350 THEN 'budget_skipped'
   WHEN f.answer IS NOT NULL THEN 'fallback' ELSE 'fallback_missing' END AS route, e.answer AS extracted, f.answer AS fb, f.finish_reason AS fin
FROM fx_extract e LEFT JOIN fx_answers f USING (request_id)"""


@query(
    "hybrid_routing",
    """SELECT request_id, route, CASE WHEN route = 'fallback' THEN fb ELSE extracted END AS answer,
       CASE route WHEN 'budget_skipped' THEN 'budget_skipped' WHEN 'fallback' THEN fin ELSE 'stop' END AS finish_reason FROM fx_routed""",
)
def hybrid_routing(spark, sf):
    requests = X.requests(spark, sf)
    extracted = A.extractive_answer(requests, usable(spark, sf)).join(requests.select("request_id", "budget_ms"), "request_id")
    fallback = sample_answers(spark, sf).select("request_id", "answer", "finish_reason")
    return A.hybrid_routing(extracted, fallback).select("request_id", "route", "answer", "finish_reason")


@query(
    "score_to_unit",
    "SELECT request_id, chunk_id, round(least(1.0, greatest(0.0, (full_score + 1) / 2)), 6) AS share FROM fx_final",
)
def score_to_unit(spark, sf):
    rows = K.two_stage_retrieve(X.requests(spark, sf), X.chunks(spark, sf))
    return rows.select("request_id", "chunk_id", r6(vectors.score_to_unit(F.col("full_score"))).alias("share"))


# Polarity and quantity over whole documents: the first sentence asks, the others answer.

CTES["fx_talk"] = f"SELECT conv_id, turn, {content('t', V.SELECTION_FUNCTION_WORDS)} AS tk FROM (SELECT conv_id, turn, {tok('text')} AS t FROM conversations)"


def _talk(spark, sf):
    """Every turn next to the turn after it, as content tokens."""
    turns = X.table(spark, sf, "conversations").withColumn("t", T.content_tokens(F.col("text"), V.SELECTION_FUNCTION_WORDS))
    ask = turns.select("conv_id", "turn", F.col("t").alias("q"))
    reply = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("s"))
    return ask.join(reply, ["conv_id", "turn"])


_TALK = "FROM (SELECT a.conv_id, a.turn, a.tk AS qs, b.tk AS st FROM fx_talk a JOIN fx_talk b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query("polarity_conflict", f"SELECT conv_id, turn, ({_conflict}) AS conflict {_TALK}")
def polarity_conflict(spark, sf):
    return _talk(spark, sf).select("conv_id", "turn", A.polarity_conflict(F.col("q"), F.col("s")).alias("conflict"))


@query("quantity_gate", f"SELECT conv_id, turn, {_quantity} AS misses {_TALK}")
def quantity_gate(spark, sf):
    return _talk(spark, sf).select("conv_id", "turn", A.misses_quantity(F.col("q"), F.col("s")).alias("misses"))


def _poles(as_sql: bool):
    rows = [(g, p, w) for g, group in enumerate(V.ANTONYM_GROUPS) for p, pole in enumerate(group) for w in pole]
    return ", ".join(f"({g}, {p}, '{w}')" for g, p, w in rows) if as_sql else rows


@query(
    "antonym_conflict",
    f"""SELECT DISTINCT a.doc_id, x.g AS word_group FROM (SELECT doc_id, unnest({tok("text")}) AS t FROM documents) a
        JOIN (VALUES {_poles(True)}) x(g, p, w) ON x.w = a.t
        JOIN (SELECT DISTINCT doc_id, y.g, y.p FROM (SELECT doc_id, unnest({tok("text")}) AS t FROM documents) b JOIN (VALUES {_poles(True)}) y(g, p, w) ON y.w = b.t) o
        ON o.doc_id = a.doc_id AND o.g = x.g AND o.p <> x.p""",
)
def antonym_conflict(spark, sf):
    """Documents holding both poles of a group: tokens meet the antonym table."""
    poles = spark.createDataFrame(_poles(False), "word_group int, pole int, word string")
    tokens = X.documents(spark, sf).select("doc_id", F.explode(T.lexical_tokens(F.col("text"))).alias("word"))
    return A.antonym_conflicts(tokens, poles, "doc_id")


# Requests ----------------------------------------------------------------------------


@query(
    "normalize_language",
    """SELECT doc_id, raw, CASE p WHEN 'asm' THEN 'as' WHEN 'ben' THEN 'bn' WHEN 'hin' THEN 'hi' WHEN 'pun' THEN 'pa' ELSE p END AS code FROM (
       SELECT doc_id, raw, split_part(lower(trim(raw)), '-', 1) AS p FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(lang) || '-XX' WHEN 1 THEN ' ' || lang
         WHEN 2 THEN 'HIN-in' WHEN 3 THEN 'pun' ELSE lang END AS raw FROM documents))""",
)
def normalize_language(spark, sf):
    v = F.col("doc_id") % 5
    raw = (
        F.when(v == 0, F.concat(F.upper("lang"), F.lit("-XX"))).when(v == 1, F.concat(F.lit(" "), "lang"))
        .when(v == 2, "HIN-in").when(v == 3, "pun").otherwise(F.col("lang"))
    )
    return X.table(spark, sf, "documents").select("doc_id", raw.alias("raw")).withColumn("code", T.normalize_language(F.col("raw")))


@query(
    "validate_requests",
    """SELECT doc_id, CASE WHEN length(text) < 1 THEN 'query_missing' WHEN length(text) > 2000 THEN 'query_too_long' WHEN length(lang) NOT BETWEEN 2 AND 32 THEN 'language_length'
       WHEN ck NOT BETWEEN 1 AND 1000 THEN 'candidate_k_range' WHEN fk NOT BETWEEN 1 AND 100 THEN 'final_k_range' WHEN fk > ck THEN 'final_k_above_candidate_k' END AS reject_reason
       FROM (SELECT doc_id, text, lang, doc_id % 1003 AS ck, doc_id % 7 AS fk FROM documents)""",
)
def validate_requests(spark, sf):
    rows = X.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("query"), F.col("lang").alias("language_code"),
        (F.col("doc_id") % 1003).alias("candidate_k"), (F.col("doc_id") % 7).alias("final_k"),
    )
    return R.validate_requests(rows).select("doc_id", "reject_reason")


_BODIES = (
    ("{}", "query_missing"),
    ('{"query":"TEXT"}', None),
    ('{"query":"TEXT","candidate_k":"12","final_k":7.0,"language_code":null}', None),
    ('{"query":"TEXT","candidate_k":"abc"}', "candidate_k_type"),
    ('{"query":"TEXT","candidate_k":5.5}', "candidate_k_type"),
    ('{"query":"TEXT","final_k":null}', "final_k_type"),
    ('{"query":12}', "query_type"),
    ('{"query":"TEXT","language_code":5}', "language_type"),
    ('{"query":"TEXT","other":1}', "unknown_field"),
    ('["TEXT"]', "not_an_object"),
    ('{"query":"TEXT"', "not_an_object"),
    ('{"query":"TEXT","candidate_k":3,"final_k":4}', "final_k_above_candidate_k"),
    ('{"query":"TEXT","candidate_k":0}', "candidate_k_range"),
)


def _cases(of: str) -> str:
    return "CASE " + " ".join(f"WHEN {of} % {len(_BODIES)} = {i} THEN {'NULL' if r is None else repr(r)}" for i, (_, r) in enumerate(_BODIES)) + " END"


@query(
    "parse_requests",
    f"""SELECT doc_id, {_cases("doc_id")} AS reject_reason,
        CASE doc_id % {len(_BODIES)} WHEN 1 THEN 50 WHEN 2 THEN 12 END AS candidate_k, CASE doc_id % {len(_BODIES)} WHEN 1 THEN 5 WHEN 2 THEN 7 END AS final_k FROM documents""",
)
def parse_requests(spark, sf):
    """Bodies of every kind, right and wrong, around the source of each document."""
    kind = F.col("doc_id") % len(_BODIES)
    body = F.get(F.array(*[F.lit(b) for b, _ in _BODIES]), kind.cast("int"))
    raw = X.table(spark, sf, "documents").select("doc_id", F.replace(body, F.lit("TEXT"), F.col("source")).alias("body"))
    parsed = R.parse_requests(raw)
    good = F.col("reject_reason").isNull()
    return parsed.select("doc_id", "reject_reason", F.when(good, F.col("candidate_k")).alias("candidate_k"), F.when(good, F.col("final_k")).alias("final_k"))


@query("supported_languages", "SELECT DISTINCT lower(trim(language)) AS language FROM fx_chunks WHERE trim(language) <> ''")
def supported_languages(spark, sf):
    return R.supported_languages(X.chunks(spark, sf))


@query(
    "language_coverage",
    """SELECT request_id, language_code IS NULL OR language_code IN (SELECT language FROM fx_chunks WHERE language <> 'fr') AS served FROM fx_requests""",
)
def language_coverage(spark, sf):
    """An index without French: its requests are turned away before any work."""
    known = R.supported_languages(X.chunks(spark, sf).filter("language <> 'fr'"))
    served, rejected = R.language_coverage(X.requests(spark, sf), known)
    return served.select("request_id", F.lit(True).alias("served")).unionByName(
        rejected.select("request_id", F.lit(False).alias("served"))
    )


@query(
    "provenance_match",
    """SELECT vec_id, label % 3 > 0 AND label % 2 = 0 AS provenance_ok FROM embeddings""",
)
def provenance_match(spark, sf):
    label = F.col("label")
    vectors_df = X.table(spark, sf, "embeddings").select(
        "vec_id", F.when(label % 3 > 0, "encoder-a").otherwise("encoder-b").alias("model"),
        F.when(label % 2 == 0, "r1").alias("revision"),
    )
    return R.provenance_match(vectors_df, "encoder-a", "r1").select("vec_id", "provenance_ok")


@query(
    "first_passing_request",
    """SELECT request_id FROM fx_relset JOIN fx_requests USING (request_id) WHERE classification = 'correct' ORDER BY CASE WHEN v = 1 THEN 0 ELSE 1 END, doc_id LIMIT 1""",
)
def first_passing_request(spark, sf):
    """Derived requests (v = 1) are tried before the others."""
    requests = X.requests(spark, sf).withColumn("pos", F.col("doc_id"))
    return R.first_passing_request([requests.filter("v = 1"), requests.filter("v <> 1")], relset(spark, sf)).select("request_id")


# End to end -----------------------------------------------------------------------------

CTES["fx_outcome"] = """
SELECT s.request_id, s.matched_rule, s.is_safe, CASE WHEN NOT s.is_safe THEN 'unsafe_input'
   WHEN r.request_id IS NULL THEN 'no_relevant_context'
   WHEN r.classification = 'ambiguous' THEN 'ambiguous_retrieval' WHEN r.classification = 'incorrect' AND r.reason = 'off_topic' THEN 'off_topic'
   WHEN r.classification = 'incorrect' THEN 'no_relevant_context'
   WHEN e.cited_chunk_id IS NOT NULL THEN CASE WHEN g.support >= 0.8 THEN 'answered' ELSE 'ungrounded_answer' END
   WHEN e.budget_ms < 350 THEN 'latency_budget_exhausted' ELSE 'no_relevant_context' END AS outcome,
   CASE WHEN s.is_safe THEN coalesce(r.classification, 'incorrect') END AS relevance, e.answer, e.cited_chunk_id, e.budget_ms
FROM fx_safety s LEFT JOIN fx_relset r USING (request_id) LEFT JOIN fx_extract e USING (request_id) LEFT JOIN fx_extract_support g USING (request_id)"""
# Every claim of an extract is verbatim, so its weakest support decides.
CTES["fx_xclaims"] = rf"""
SELECT request_id, chunk_id, i, cited, {tok("plain")} AS ct FROM (SELECT *, {strip(r"regexp_replace(claim, '\[chunk:([^\]\s]+)\]', '', 'g')")} AS plain, regexp_extract_all(claim, '\[chunk:([^\]\s]+)\]', 1) AS cited FROM (
 SELECT request_id, cited_chunk_id AS chunk_id, unnest(range(len(s))) AS i, regexp_replace(unnest(s), '^\s*(?:[-*+]\s+|#{{1,6}}\s+|\d+[.)]\s+)', '') AS claim FROM (
  SELECT *, {sents("answer")} AS s FROM fx_extract WHERE cited_chunk_id IS NOT NULL)) WHERE regexp_matches(claim, '[\p{{L}}\p{{M}}\p{{N}}]'))"""
CTES["fx_xcont"] = f"SELECT *, {content('ct', V.ENGLISH_FUNCTION_WORDS)} AS cc FROM fx_xclaims"
CTES["fx_extract_support"] = """
SELECT request_id, min(CASE WHEN len(cited) = 0 THEN 0.0 ELSE matched / n END) AS support FROM (
  SELECT c.request_id, c.i, any_value(c.cited) AS cited, any_value(len(cc)) AS n, sum(least(c.k, coalesce(m, 0))) AS matched FROM (
    SELECT request_id, chunk_id, i, any_value(cited) AS cited, any_value(cc) AS cc, tk, count(*) AS k FROM (SELECT *, unnest(cc) AS tk FROM fx_xcont) GROUP BY request_id, chunk_id, i, tk) c
  LEFT JOIN (SELECT chunk_id, tk, count(*) AS m FROM (SELECT chunk_id, unnest(et) AS tk FROM fx_etok) GROUP BY ALL) e ON e.chunk_id = c.chunk_id AND e.tk = c.tk
  GROUP BY c.request_id, c.i) GROUP BY request_id"""


def responses(spark, sf):
    return P.answer_batch(X.requests(spark, sf), X.chunks(spark, sf))


@query(
    "answer_batch",
    """SELECT request_id, is_safe, matched_rule, relevance, CASE WHEN outcome = 'answered' THEN answer END AS answer,
       CASE WHEN outcome = 'answered' THEN cited_chunk_id END AS supporting, outcome,
       CASE WHEN outcome = 'answered' THEN 'answered' ELSE 'refused' END AS status FROM fx_outcome""",
)
def answer_batch(spark, sf):
    return responses(spark, sf).select(
        "request_id", "is_safe", "matched_rule", "relevance", "answer",
        F.array_join("supporting_chunk_ids", "|").alias("supporting"), "outcome", "status",
    )


@query("final_outcome", "SELECT outcome, count(*) AS requests FROM fx_outcome GROUP BY outcome")
def final_outcome(spark, sf):
    return responses(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))


@query("validate_response", "SELECT request_id, NULL::VARCHAR AS problem FROM fx_outcome WHERE outcome <> 'answered' UNION ALL SELECT request_id, NULL FROM fx_outcome WHERE outcome = 'answered'")
def validate_response(spark, sf):
    return responses(spark, sf).select("request_id", R.response_problem().alias("problem"))

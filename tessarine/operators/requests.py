"""Request validation, language handling, and set helpers on evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.functions import text as T

REQUEST_FIELDS = ("query", "language_code", "candidate_k", "final_k")


def request_problem() -> Column:
    """First broken rule of a request row, null if it is valid."""
    query, code = F.col("query"), F.col("language_code")
    final_k, candidate_k = F.col("final_k"), F.col("candidate_k")
    return (
        F.when(query.isNull() | (F.char_length(query) < 1), "query_missing")
        .when(F.char_length(query) > V.MAX_QUERY_CHARS, "query_too_long")
        .when(~F.char_length(code).between(2, 32), "language_length")
        .when(~candidate_k.between(1, V.MAX_CANDIDATE_K), "candidate_k_range")
        .when(~final_k.between(1, V.MAX_FINAL_K), "final_k_range")
        .when(final_k > candidate_k, "final_k_above_candidate_k")
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("reject_reason", request_problem())


def parse_requests(raw: DataFrame, column: str = "body") -> DataFrame:
    """JSON request bodies to typed rows; bad JSON, unknown fields and wrong types are rejected.

    Types are looked at before any cast: a query is a string, a language code a string or null, and
    the two counts are whole numbers (also written as such in a string). Only an absent count has a default.
    """
    keys = F.json_object_keys(column)
    unknown = F.array_except(keys, F.array(*[F.lit(f) for f in REQUEST_FIELDS]))
    body = F.try_parse_json(column)

    def kind(field: str) -> Column:
        """SQL type of a field's value: VOID for null; null where absent."""
        return F.schema_of_variant(F.try_variant_get(body, f"$.{field}", "variant"))

    def has(field: str) -> Column:
        return F.coalesce(F.array_contains(keys, field), F.lit(False))

    def read(field: str, as_type: str) -> Column:
        return F.try_variant_get(body, f"$.{field}", as_type)

    def whole(field: str) -> Column:
        number, text = read(field, "double"), read(field, "string")
        written = (kind(field) == "STRING") & text.rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$")
        return F.coalesce(((kind(field) != "STRING") & (number == F.floor(number))) | written, F.lit(False))

    def count(field: str, default: int) -> Column:
        return F.when(~has(field), default).when(whole(field), F.trim(read(field, "string")).try_cast("double").try_cast("int"))

    parsed = raw.select(
        "*",
        F.when(kind("query") == "STRING", read("query", "string")).alias("query"),
        F.when(kind("language_code") == "STRING", read("language_code", "string")).alias("language_code"),
        count("candidate_k", 50).alias("candidate_k"),
        count("final_k", 5).alias("final_k"),
        F.coalesce(~has("query") | (kind("query") == "STRING"), F.lit(False)).alias("_query"),
        F.coalesce(~has("language_code") | kind("language_code").isin("STRING", "VOID"), F.lit(False)).alias("_language"),
        *[(~has(f) | whole(f)).alias(f"_{f}") for f in ("candidate_k", "final_k")],
    )
    return parsed.withColumn(
        "reject_reason",
        F.when(keys.isNull() | body.isNull(), "not_an_object")
        .when(F.size(unknown) > 0, "unknown_field")
        .when(~F.col("_query"), "query_type")
        .when(~F.col("_language"), "language_type")
        .when(~F.col("_candidate_k"), "candidate_k_type")
        .when(~F.col("_final_k"), "final_k_type")
        .otherwise(request_problem()),
    ).drop("_query", "_language", "_candidate_k", "_final_k")


def retrieval_depth() -> Column:
    """Ranks kept before the language filter: the whole pool if a language is asked for."""
    has_language = T.normalize_language(F.col("language_code")).isNotNull()
    return F.when(has_language, F.col("candidate_k")).otherwise(F.col("final_k"))


def language_filter(hits: DataFrame) -> DataFrame:
    """Keep rows in the request's language, then cut at final_k.

    Needs language_code, language, rank, final_k.  The cut comes after the filter:
    `row_number` here counts only matching rows, while `rank` keeps its old value.
    """
    wanted = T.normalize_language(F.col("language_code"))
    order = Window.partitionBy("request_id").orderBy("rank")
    return (
        hits.filter(wanted.isNull() | (T.normalize_language(F.col("language")) == wanted))
        .withColumn("_n", F.row_number().over(order))
        .filter("_n <= final_k")
        .drop("_n")
    )


def supported_languages(chunks: DataFrame) -> DataFrame:
    code = F.lower(T.strip(F.col("language")))
    return chunks.select(code.alias("language")).filter("language <> ''").distinct()


def language_coverage(requests: DataFrame, languages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(served, rejected): a request whose language no chunk has is turned away first."""
    code = T.normalize_language(F.col("language_code"))
    keyed = requests.withColumn("_code", code)
    known = languages.select(F.col("language").alias("_code"))
    free = keyed.filter("_code is null")
    named = keyed.filter("_code is not null")
    served = free.unionByName(named.join(known, "_code", "left_semi"))
    return served.drop("_code"), named.join(known, "_code", "left_anti").drop("_code")


def accepted_evidence(evidence: DataFrame, accepted: DataFrame) -> DataFrame:
    return evidence.join(
        accepted.select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_semi"
    )


def provenance_match(vectors: DataFrame, model: str, revision: str) -> DataFrame:
    """Add `provenance_ok`: the vectors come from the same model and revision as the queries."""
    same = F.col("model").eqNullSafe(F.lit(model)) & F.col("revision").eqNullSafe(F.lit(revision))
    return vectors.withColumn("provenance_ok", same)


def response_problem() -> Column:
    """Broken cross-field rule of a response row (status, answer, refusal_reason, is_grounded)."""
    answered = F.col("status") == "answered"
    return (
        F.when(~F.coalesce(F.col("status").isin(*V.STATUSES), F.lit(False)), "unknown_status")
        .when(answered & (F.coalesce("answer", F.lit("")) == ""), "answer_missing")
        .when(answered & F.col("refusal_reason").isNotNull(), "answered_with_refusal_reason")
        .when(answered & ~F.coalesce("is_grounded", F.lit(False)), "answered_but_not_grounded")
        .when(~answered & F.col("refusal_reason").isNull(), "refusal_reason_missing")
    )


def first_passing_request(sources: list[DataFrame], verdicts: DataFrame) -> DataFrame:
    """First request in list order (earlier sources first) whose evidence is `correct`."""
    listed = [s.select("request_id", F.lit(i).alias("source"), "pos") for i, s in enumerate(sources)]
    union = listed[0]
    for more in listed[1:]:
        union = union.unionByName(more)
    good = verdicts.filter(F.col("classification") == "correct").select("request_id")
    return union.join(good, "request_id", "left_semi").orderBy("source", "pos").limit(1)

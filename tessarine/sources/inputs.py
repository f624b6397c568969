"""Readers of question lists and evaluation manifests, with reject reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.functions import text as T

QUERY_SCHEMA = "id string, query string, language string, query_id string, english_query string"


def scan_query_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of queries; see `clean_queries`."""
    return clean_queries(spark.read.schema(QUERY_SCHEMA).json(path, multiLine=True))


def clean_queries(raw: DataFrame) -> DataFrame:
    """Strip required fields, fill optional ones, and name the first problem of a row."""
    required = ("id", "query", "language")
    problem = F.lit(None).cast("string")
    for name in reversed(required):
        problem = (
            F.when(F.col(name).isNull(), f"missing_{name}").when(T.is_blank(F.col(name)), f"blank_{name}").otherwise(problem)
        )
    checked = raw.withColumn("reject_reason", problem)
    for name in required:
        checked = checked.withColumn(name, T.strip(F.col(name)))
    filled = F.coalesce(F.nullif("query_id", F.lit("")), F.col("id"))
    return checked.withColumns(
        {
            "language": F.lower("language"),
            "query_id": filled,
            "english_query": F.coalesce("english_query", F.lit("")),
        }
    )


def require_rows(df: DataFrame, minimum: int = V.MIN_WORKLOAD) -> DataFrame:
    """Fail before a benchmark that has too few valid questions."""
    valid = df.where("reject_reason is null") if "reject_reason" in df.columns else df
    found = valid.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"at least {minimum} queries are required, found {found}")
    return df


def _strings(field: str) -> Column:
    """A JSON string or list of strings as a distinct list of stripped strings; null if absent."""
    raw = F.variant_get("entry", f"$.{field}", "variant")
    one = F.try_variant_get("entry", f"$.{field}", "string")
    many = F.try_variant_get("entry", f"$.{field}", "array<string>")
    kind = F.schema_of_variant(raw)
    listed = F.when(kind == "STRING", F.array(one)).when(kind.startswith("ARRAY"), many)
    return F.when(raw.isNotNull() & ~F.is_variant_null(raw), F.coalesce(listed, F.array().cast("array<string>")))


def _is_strings(kind: Column, items: Column) -> Column:
    """Whether a value is null, a string or a list of strings only; true where it is absent."""
    listed = F.coalesce(F.forall(items, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    return kind.isNull() | kind.isin("STRING", "VOID") | (kind.startswith("ARRAY") & listed)


def scan_eval_manifest(raw: DataFrame, column: str = "body") -> DataFrame:
    """JSON evaluation samples to typed rows with `reject_reason`."""
    unknown = F.array_except(
        F.json_object_keys(column), F.array(*[F.lit(f) for f in V.EVAL_SAMPLE_FIELDS])
    )
    base = raw.withColumn("entry", F.try_parse_json(column)).withColumn("_unknown", unknown)
    keys = F.json_object_keys(column)
    kind = lambda f: F.schema_of_variant(F.try_variant_get("entry", f"$.{f}", "variant"))
    text = lambda f: F.when(kind(f) == "STRING", F.try_variant_get("entry", f"$.{f}", "string"))
    absent = lambda f: ~F.coalesce(F.array_contains(keys, f), F.lit(False))
    lists = ("expected_answer_contains", "expected_chunk_ids", "expected_document_ids")
    typed = base.withColumns(
        {
            "audio": text("audio"),
            "reference": text("reference"),
            "expected_status": F.when(absent("expected_status"), "answered").otherwise(text("expected_status")),
            "expected_refusal_reason": text("expected_refusal_reason"),
            **{f: _strings(f) for f in lists},
            "_wrong": F.coalesce(~kind("reference").isin("STRING", "VOID"), F.lit(False)),
            "_reason": F.coalesce(~kind("expected_refusal_reason").isin("STRING", "VOID"), F.lit(False)),
            "_lists": F.coalesce(
                *[F.when(~_is_strings(kind(f), F.try_variant_get("entry", f"$.{f}", "array<variant>")), True) for f in lists],
                F.lit(False),
            ),
        }
    )

    def bad(name: str) -> Column:
        items = F.col(name)
        return items.isNotNull() & ((F.size(items) == 0) | F.exists(items, lambda x: x.isNull() | T.is_blank(x)))

    oracle = F.lit(False)
    for name in lists:
        oracle = oracle | (F.coalesce(F.size(name), F.lit(0)) > 0)
    status, reason = F.col("expected_status"), F.col("expected_refusal_reason")
    wordless = F.exists("expected_answer_contains", lambda x: ~x.rlike(r"[\p{L}\p{N}_]"))
    problem = (
        F.when(F.col("_unknown").isNull(), "not_an_object")
        .when(F.size("_unknown") > 0, "unknown_field")
        .when(F.col("audio").isNull() | T.is_blank(F.col("audio")), "audio_missing")
        .when(F.col("_wrong"), "reference_type")
        .when(F.col("reference").isNotNull() & T.is_blank(F.col("reference")), "reference_blank")
        .when(status.isNull() | ~status.isin(*V.STATUSES), "status_unknown")
        .when(F.col("_reason"), "refusal_reason_not_allowed")
        .when(reason.isNotNull() & ((status != "refused") | ~reason.isin(*V.REFUSAL_REASONS)), "refusal_reason_not_allowed")
        .when(F.col("_lists"), "oracle_list_invalid")
        .when(bad(lists[0]) | bad(lists[1]) | bad(lists[2]), "oracle_list_invalid")
        .when(wordless, "answer_text_without_words")
        .when((status == "answered") & ~oracle, "oracle_missing")
        .when((status == "refused") & oracle, "oracle_forbidden")
    )
    out = typed.withColumn("reject_reason", problem).drop("entry", "_unknown", "_wrong", "_reason", "_lists")
    for name in lists:
        cleaned = F.array_distinct(F.transform(name, T.strip))
        out = out.withColumn(name, F.coalesce(cleaned, F.array().cast("array<string>")))
    return out

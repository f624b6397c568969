"""Corpus profile: coverage, lengths, categories, passage quality.

Records: language, source_lang, target_lang, meta, query, Answer, query_id, query_type,
passages, Eng_Query, Eng_Answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.operators.ordered import attach, exact_quantiles
from tessarine.sources.corpus import normalize_passages

TEXT_FIELDS = (
    ("translated_query", "query"),
    ("english_query", "Eng_Query"),
    ("translated_answer", "Answer"),
    ("english_answer", "Eng_Answer"),
)


def text_measures(prefix: str, text: Column, token_count=T.word_count) -> list[Column]:
    """(metric, value) structs of one text; null values for an empty text."""
    shown = F.when(text != "", text)
    sizes = {
        "characters": F.char_length(shown),
        "whitespace_words": T.word_count(shown),
        "utf8_bytes": F.octet_length(shown),
        "tokens": token_count(shown),
    }
    return [
        F.struct(F.lit(f"{prefix}_{name}").alias("metric"), size.cast("long").alias("value"))
        for name, size in sizes.items()
    ]


def _long(df: DataFrame, keys: list[str], structs: list[Column]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*structs))).filter("value is not null")


def passage_pairs(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per passage slot; the shorter arrays are padded with null."""
    shaped = normalize_passages(records)
    return shaped.select(
        *keys, F.posexplode(F.arrays_zip("translated", "english", "selected")).alias("slot", "p")
    ).select(*keys, "slot", "p.*")


def length_metrics(records: DataFrame, keys: list[str] | None = None, token_count=T.word_count) -> DataFrame:
    """(keys, metric, value) of every text field and passage, plus passages per record."""
    keys = ["language"] if keys is None else keys
    fields = [s for name, field in TEXT_FIELDS for s in text_measures(name, F.col(field), token_count)]
    scalars = _long(records, keys, fields)
    sides = [("translated_passage", "translated"), ("english_passage", "english")]
    passages = _long(
        passage_pairs(records, keys), keys, [s for n, f in sides for s in text_measures(n, F.col(f), token_count)]
    )
    shaped = normalize_passages(records)
    slots = F.greatest(F.size("translated"), F.size("english"), F.size("selected")).cast("long")
    per_record = shaped.select(*keys, F.lit("passages_per_record").alias("metric"), slots.alias("value")).filter("value > 0")
    return scalars.unionByName(passages).unionByName(per_record)


def _summary_columns() -> list[Column]:
    at = F.percentile("value", F.array(*[F.lit(p / 100) for p in V.SUMMARY_PERCENTILES]))
    return [F.count("value").alias("count"), F.avg("value").alias("mean"), at.alias("_p")]


def _spread_percentiles(df: DataFrame) -> DataFrame:
    ps = {f"p{p}": F.col("_p")[i] for i, p in enumerate(V.SUMMARY_PERCENTILES)}
    return df.withColumns(ps).drop("_p")


def whole_number_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """count, mean, percentiles of whole-number measures.

    `percentile` keeps one counter per distinct value, which for lengths is bounded by
    the longest text however many rows there are; counters merge before the shuffle.
    """
    return _spread_percentiles(long.groupBy(*keys).agg(*_summary_columns()))


def numeric_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same for continuous measures; null and non-finite values are dropped."""
    return exact_quantiles(df, keys, value, V.SUMMARY_PERCENTILES)


def profile_lengths(long: DataFrame) -> DataFrame:
    """Per language and overall (language null) in one pass over whole-number measures.

    Equal values are counted first, so that grouping sets and percentiles work on counts and not on rows.
    """
    counted = long.groupBy("language", "metric", "value").agg(F.count(F.lit(1)).alias("_n"))
    there = F.sum(F.when(F.col("value").isNotNull(), F.col("_n")))
    sets = counted.groupingSets([["language", "metric"], ["metric"]], "language", "metric")
    at = F.percentile("value", F.array(*[F.lit(p / 100) for p in V.SUMMARY_PERCENTILES]), F.col("_n"))
    mean = F.sum(F.col("value") * F.col("_n")) / there
    return _spread_percentiles(sets.agg(F.coalesce(there, F.lit(0)).alias("count"), mean.alias("mean"), at.alias("_p")))


def translation_ratios(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, value) character and word ratios of paired non-empty passages."""
    keys = ["language"] if keys is None else keys
    pairs = passage_pairs(records, keys).filter("translated <> '' and english <> ''")
    english_words = T.word_count(F.col("english"))
    ratios = F.array(
        F.struct(
            F.lit("passage_translation_character_ratio").alias("metric"),
            (F.char_length("translated") / F.char_length("english")).alias("value"),
        ),
        F.struct(
            F.lit("passage_translation_word_ratio").alias("metric"),
            F.try_divide(T.word_count(F.col("translated")), english_words).alias("value"),
        ),
    )
    return pairs.select(*keys, F.inline(ratios)).filter("value is not null")


def _category(field: str, kind: TY.DataType) -> Column:
    column = F.col(field)
    if isinstance(kind, (TY.DoubleType, TY.FloatType)):
        return T.missing_float_key(column)
    return T.missing_key(column.cast("string"))


def categorical_counts(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, field, value, n) for the categorical fields and passage labels."""
    keys = ["language"] if keys is None else keys
    meta = records.schema["meta"].dataType
    fields = [(f"meta.{f}", meta[f].dataType) for f in V.META_FIELDS if f in meta.fieldNames()]
    fields += [(f, records.schema[f].dataType) for f in ("source_lang", "target_lang", "query_type")]
    pairs = [F.struct(F.lit(f).alias("field"), _category(f, k).alias("value")) for f, k in fields]
    scalars = records.select(*keys, F.inline(F.array(*pairs)))
    labels = passage_pairs(records, keys).select(
        *keys, F.lit("is_selected").alias("field"), T.missing_key(F.col("selected")).alias("value")
    )
    return scalars.unionByName(labels).groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def top_categories(counts: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """First `n` categories of each field by count, then value."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys, "field").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def _present(name: str, kind: TY.DataType) -> Column:
    column = F.col(name)
    if isinstance(kind, TY.StringType):
        return column.isNotNull() & (column != "")
    if isinstance(kind, (TY.ArrayType, TY.MapType)):
        return column.isNotNull() & (F.size(column) > 0)
    return column.isNotNull()


def field_coverage(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, field, present, records, rate), one pass over the records."""
    keys = ["language"] if keys is None else keys
    meta = records.schema["meta"].dataType
    fields = {f: _present(f, records.schema[f].dataType) for f in V.RECORD_FIELDS if f in records.columns}
    fields |= {f"meta.{f}": _present(f"meta.{f}", meta[f].dataType) for f in V.META_FIELDS if f in meta.fieldNames()}
    counts = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(c).alias(f.replace(".", "__")) for f, c in fields.items()],
    )
    rows = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f.replace(".", "__")).alias("present")) for f in fields]
    )
    return counts.select(*keys, "records", F.inline(rows)).withColumn("rate", F.col("present") / F.col("records"))


def passage_quality(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row of passage counts per key."""
    keys = ["language"] if keys is None else keys
    shaped = normalize_passages(records)
    sizes = [F.size(c) for c in ("translated", "english", "selected")]
    per_record = shaped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.greatest(*sizes) == 0).alias("records_without_passages"),
        F.count_if(F.greatest(*sizes) != F.least(*sizes)).alias("records_with_mismatched_passage_arrays"),
    )
    left = F.coalesce(F.col("translated") != "", F.lit(False))
    right = F.coalesce(F.col("english") != "", F.lit(False))
    label = F.coalesce("selected", F.lit(""))
    same = T.strip(F.col("translated")) == T.strip(F.col("english"))
    slots = passage_pairs(records, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("passage_slots"),
        F.count_if(left).alias("nonempty_translated_passages"),
        F.count_if(~left).alias("empty_or_missing_translated_passages"),
        F.count_if(right).alias("nonempty_english_passages"),
        F.count_if(~right).alias("empty_or_missing_english_passages"),
        F.count_if(left & right).alias("paired_nonempty_passages"),
        F.count_if(left & right & same).alias("translated_passages_equal_to_english"),
        F.count_if(label.isin("1", "true", "1.0")).alias("selected_passages"),
        F.count_if(~label.isin("1", "true", "1.0", "0", "false", "0.0", "")).alias("invalid_is_selected_labels"),
    )
    joined = attach(per_record, slots, keys, "left") if keys else per_record.crossJoin(slots)
    return joined.na.fill(0)


def duplicate_ids(records: DataFrame, keys: list[str] | None = None, key: str = "query_id") -> DataFrame:
    """Repeats of an id inside a language."""
    keys = ["language"] if keys is None else keys
    counted = records.groupBy(*keys, T.missing_key(F.col(key).cast("string")).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def language_mix(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sampled records, target languages and byte share per language."""
    counts = records.groupBy("language").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("target_lang").alias("target_values")
    )
    total = sizes.agg(F.sum("size").alias("total"))  # one row
    shares = sizes.join(F.broadcast(total)).select("language", "size", (F.col("size") / F.col("total")).alias("byte_share"))
    return shares.join(counts, "language", "left").na.fill(0, ["records", "target_values"])


def observed_schema(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Merged schema of a JSON column; rows that are not JSON are counted, not fatal."""
    parsed = df.withColumn("_parsed", F.try_parse_json(column))
    bad = F.col(column).isNotNull() & F.col("_parsed").isNull()
    return parsed.groupBy(*(keys or [])).agg(
        F.schema_of_variant_agg("_parsed").alias("observed"), F.sum(bad.cast("long")).alias("malformed")
    )


def _json_depth(text: Column) -> Column:
    """How deep objects and lists stand in each other; what is inside strings does not count."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def walk(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, start, walk)["most"]


def _json_type(value: Column) -> Column:
    """Type of a variant: object, array, str, int, float, bool or NoneType.

    Numbers with a point or exponent arrive as doubles or decimals without closing zeros; whole
    numbers arrive as long, and as decimals of 19 digits or more beyond it.
    """
    kind = F.schema_of_variant(value)
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "VOID", "NoneType")
        .when(kind == "BIGINT", "int")
        .when((digits != "") & (F.try_to_number(digits, F.lit("99")) >= 19), "int")
        .otherwise("float")
    )


def schema_paths(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, path, types): every path met in a JSON column and the sorted set of types met there.

    The root is `$`, members are joined by dots, a list's items are `path[]`; of a list its first item
    that is not null is looked at, as in the records' profile. The text is walked level by level, as deep as its
    deepest row, and each level shrinks to its distinct (path, type) pairs before a shuffle. Rows that
    are not JSON, and nulls, are passed over (`observed_schema` counts them).
    """
    by = keys or []
    rows = df.select(*by, F.col(column).alias("_text"), F.try_parse_json(column).alias("_v")).where("_v is not null")
    deepest = rows.agg(F.max(_json_depth(F.col("_text")))).first()[0] or 0
    level = rows.select(*by, F.lit("").alias("_path"), "_v")
    member = F.when(F.col("_path") == "", F.lit("")).otherwise(F.concat("_path", F.lit(".")))
    members = F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))
    items = F.filter(F.try_variant_get("_v", "$", "array<variant>"), lambda v: ~F.is_variant_null(v))
    inside = F.when(
        F.col("_type") == "object",
        F.transform(members, lambda e: F.struct(F.concat(member, e["key"]).alias("_path"), e["value"].alias("_v"))),
    ).when(
        (F.col("_type") == "array") & (F.size(items) > 0),
        F.array(F.struct(F.concat("_path", F.lit("[]")).alias("_path"), F.get(items, 0).alias("_v"))),
    )
    found = None
    for at in range(deepest + 1):
        typed = level.withColumn("_type", _json_type(F.col("_v")))
        met = typed.groupBy(*by, "_path").agg(F.collect_set("_type").alias("_types"))
        found = met if found is None else found.unionByName(met)
        if at < deepest:
            level = typed.select(*by, F.inline(inside))
    path = F.when(F.col("_path") == "", "$").otherwise(F.col("_path")).alias("path")
    # A member whose name holds a dot may have the path of a deeper one.
    return found.groupBy(*by, path).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_types")))).alias("types"))

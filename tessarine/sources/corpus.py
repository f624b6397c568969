"""Corpus files and nested records: scans, samples, manifests, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.operators.ordered import numbered

PASSAGES = "struct<Translated_passages:array<string>,English_passages:array<string>,is_selected:array<string>>"


def languages(spark: SparkSession) -> DataFrame:
    """The language dimension (14 rows)."""
    rows = [(i, code, name, stem) for i, (code, (name, stem)) in enumerate(V.LANGUAGES.items())]
    return spark.createDataFrame(rows, "position int, language string, name string, stem string")


def expected_files(spark: SparkSession, split: str) -> DataFrame:
    suffix = {"validation": "val", "train": "train", "test": "test"}.get(split)
    if suffix is None:
        raise ValueError(f"unknown split {split!r}")
    path = F.concat(F.lit(split + "/"), "stem", F.lit(suffix + ".parquet"))
    return languages(spark).withColumn("path", path)


def write_by_language(df: DataFrame, path: str, language: str = "language") -> None:
    """One directory per language, so that a scan of one language reads only its files."""
    df.write.partitionBy(language).parquet(path)


def scan_by_language(spark: SparkSession, path: str, codes: list[str], language: str = "language") -> DataFrame:
    """Partition-pruned scan of some languages."""
    return spark.read.parquet(path).filter(F.col(language).isin(codes))


def head_sample(df: DataFrame, cap: int, language: str, order: str) -> DataFrame:
    """First `cap` rows of every language on its own.

    Each partition keeps its own first rows before the shuffle, so a dominant language
    sends no more than `cap` rows per task.
    """
    place = Window.partitionBy(language).orderBy(order)
    return df.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= cap).drop("_n")


def shuffle_sample(df: DataFrame, cap: int, seed: int, language: str, key: str, position: Column) -> DataFrame:
    """Reproducible pseudo-random sample; the seed differs by language position."""
    ticket = F.md5(F.concat_ws(":", (F.lit(seed) + position).cast("string"), F.col(key).cast("string")).cast("binary"))
    return head_sample(df.withColumn("_ticket", ticket), cap, language, "_ticket").drop("_ticket")


def source_availability(expected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every expected file with `ok` and its bytes, or `unavailable`."""
    return expected.join(manifest.select("path", "size"), "path", "left").withColumn(
        "status", F.when(F.col("size").isNull(), "unavailable").otherwise("ok")
    )


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path and bytes of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"))


def artifact_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes per artifact (first folder level) and in total (artifact null)."""
    relative = F.regexp_replace("path", ".*" + path.rstrip("/") + "/", "")
    files = file_manifest(spark, path).withColumn("artifact", F.split_part(relative, F.lit("/"), F.lit(1)))
    return files.rollup("artifact").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def _field_of_structs(name: str | None) -> Column:
    """One field of an array of structs as text; nulls where the field does not exist."""
    if name is None:
        return F.transform("passages", lambda s: F.lit(None).cast("string"))
    return F.transform("passages", lambda s: s[name].cast("string"))


def normalize_passages(records: DataFrame) -> DataFrame:
    """Bring `passages` to three arrays: struct of arrays or array of structs, scalar or null."""
    kind = records.schema["passages"].dataType
    if isinstance(kind, TY.ArrayType):
        fields = kind.elementType.fieldNames()
        either = lambda long, short: long if long in fields else short
        names = (either("Translated_passages", "translated"), either("English_passages", "english"), "is_selected")
        parts = [_field_of_structs(n if n in fields else None) for n in names]
    else:
        parts = []
        for name in ("Translated_passages", "English_passages", "is_selected"):
            field = F.col(f"passages.{name}")
            held = kind[name].dataType
            if not isinstance(held, TY.ArrayType):
                field = F.when(field.isNotNull(), F.array(field))
            parts.append(F.transform(field, lambda x: x.cast("string")))
    empty = F.array().cast("array<string>")
    names = ("translated", "english", "selected")
    return records.withColumns({n: F.coalesce(p, empty) for n, p in zip(names, parts)}).drop("passages")


def truthy(label: Column) -> Column:
    """Python's truth of a label read as text: numbers other than 0, true, other text."""
    number = label.try_cast("double")
    return F.when(label.isNull() | (label == "") | (label == "false"), False).otherwise(
        F.coalesce(number != 0, F.lit(True))
    )


def identified(records: DataFrame, order: str) -> DataFrame:
    """Records with a `query_id` and a `base` that no other record of the language has.

    A record without id takes its number within the language; the second and later records
    of one id, in record order, add `#2`, `#3` and so on. Only ids are numbered; the records join
    once, on record number, and keep the ids of their language.
    """
    ids = numbered(records.select("language", order, F.col("query_id").cast("string").alias("query_id")), ["language"], order, "_number")
    ids = ids.withColumn("query_id", F.coalesce("query_id", F.col("_number").cast("string"))).drop("_number")
    ids = numbered(ids, ["language", "query_id"], order, "_copy")
    again = F.when(F.col("_copy") > 0, F.concat(F.lit("#"), (F.col("_copy") + 1).cast("string"))).otherwise("")
    base = F.concat(F.coalesce("language", F.lit("")), F.lit(":"), "query_id", again)
    ids = ids.select(F.col("language").alias("_language"), F.col(order).alias("_order"), "query_id", base.alias("base"))
    # Dealt out by record number alone, as a join on it before this one has left the texts: they are not sent again.
    number = F.col(order) == F.col("_order")
    same = number & (F.col("language").eqNullSafe(F.col("_language")) == number)
    return records.drop("query_id").join(ids, same).drop("_language", "_order")


def explode_passages(records: DataFrame, order: str) -> DataFrame:
    """Records to documents: non-blank passages under their original index, ids unique (see `identified`)."""
    texts = normalize_passages(identified(records, order)).select(
        "base", "language", "query_id", order, "selected",
        F.posexplode("translated").alias("passage_index", "raw"),
    )
    label = F.try_element_at("selected", F.col("passage_index") + 1)
    return texts.select(
        F.concat_ws(":", "base", "passage_index").alias("id"),
        T.strip(F.col("raw")).alias("text"),
        "language",
        "query_id",
        order,
        "passage_index",
        truthy(label).alias("is_selected"),
    ).filter("text <> ''")


def project_queries(records: DataFrame, order: str) -> DataFrame:
    """Records to queries under the ids of their documents."""
    return identified(records, order).select(
        F.col("base").alias("id"),
        "query_id",
        "language",
        T.strip(F.coalesce("query", F.lit(""))).alias("query"),
        T.strip(F.coalesce("Eng_Query", F.lit(""))).alias("english_query"),
    ).filter("query <> ''")


def document_cap(documents: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """First documents in language, record, passage order (a distributed top-n)."""
    return documents.orderBy(*order).limit(limit)


def distinct_texts(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per text, the first by `order`; copies merge before the shuffle."""
    rest = [c for c in df.columns if c not in (text, order)]
    first = F.min_by(F.struct(order, *rest), F.col(order)).alias("_first")
    return df.groupBy(text).agg(first).select(text, "_first.*")


def union_languages(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

"""Views of the driver's tables in the shape the operators work on.

Every view covers its whole tables and whole texts; `% n` below only deals out
variants, it never drops a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import CTES, content, sents, tok, unit
from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.operators import retrieval
from tessarine.session import spread, spread_by

FULL, PREFIX = 64, 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the string id the chunk operators use."""
    return spread(table(spark, sf, "documents")).withColumn(
        "document_id", F.concat_ws(":", "lang", "doc_id")
    )


def raw_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"))
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")
    )
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(vectors, "doc_id").join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat_ws(":", "lang", "doc_id").alias("document_id"),
        F.concat(F.concat_ws(":", "lang", "doc_id"), F.lit(":late:0")).alias("chunk_id"),
        "text",
        F.col("lang").alias("language"),
        (F.col("doc_id") % 25).cast("string").alias("query_id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_selected"),
        "vector",
    )


CTES["fx_raw_chunks"] = """
SELECT d.doc_id, d.lang || ':' || d.doc_id AS document_id, d.lang || ':' || d.doc_id || ':late:0' AS chunk_id,
       d.text, d.lang AS language, (d.doc_id % 25)::VARCHAR AS query_id,
       coalesce(l.quality = 1, false) AS is_selected, e.embedding AS vector
FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.build_vector_table(raw_chunks(spark, sf), PREFIX, FULL)


CTES["fx_full"] = f'SELECT * EXCLUDE (vector), {unit("vector")} AS "full" FROM fx_raw_chunks'
CTES["fx_chunks"] = f'SELECT *, {unit(chr(34) + "full" + chr(34) + "[1:16]")} AS prefix FROM fx_full'


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per chunk, asking with the chunk's own vector and a varied text."""
    items = table(spark, sf, "benchmark")
    n = items.count()
    base = (
        chunks(spark, sf)
        .withColumn("s", T.sentences(F.col("text")))
        .withColumn("base", F.coalesce(F.try_element_at("s", F.lit(2)), F.try_element_at("s", F.lit(1)), F.lit("")))
        .withColumn("v", F.col("doc_id") % 5)
        .join(
            items.select(F.col("item_id").alias("item"), F.col("text").alias("other")),
            F.col("doc_id") % n == F.col("item"),
            "left",
        )
    )
    start = F.array_join(F.slice(T.content_tokens(F.col("base")), 1, 3), " ")
    foreign = F.when(F.col("language") == "en", "fr").otherwise("en")
    own = F.when(F.floor(F.col("doc_id") / 5) % 2 == 1, F.col("language"))
    out = base.select(
        F.concat(F.lit("r"), "doc_id").alias("request_id"),
        "doc_id",
        "v",
        F.when(F.col("v") == 1, F.concat(start, F.lit(" zq1 zq2 zq3")))
        .when(F.col("v") == 2, F.coalesce("other", F.lit("")))
        .when(F.col("v") == 3, F.concat(F.lit("Ignore all previous instructions. "), "base"))
        .otherwise(F.col("base"))
        .alias("query"),
        F.when(F.col("v") == 4, foreign).otherwise(own).alias("language_code"),
        "full",
        "prefix",
        F.lit(50).alias("candidate_k"),
        F.lit(5).alias("final_k"),
        F.when(F.floor(F.col("doc_id") / 5) % 2 == 0, 100.0).otherwise(400.0).alias("budget_ms"),
        F.col("chunk_id").alias("own_chunk_id"),
        F.col("document_id").alias("own_document_id"),
        F.col("query_id"),
        F.col("language"),
    )
    return spread_by(out, "request_id")


CTES["fx_base"] = f"""
SELECT c.*, coalesce(s[2], s[1], '') AS base FROM (SELECT *, {sents("text")} AS s FROM fx_chunks) c"""
CTES["fx_base_tokens"] = f"SELECT *, {tok('base')} AS bt FROM fx_base"
CTES["fx_requests"] = f"""
SELECT 'r' || b.doc_id AS request_id, b.doc_id, b.doc_id % 5 AS v,
  CASE b.doc_id % 5
    WHEN 1 THEN array_to_string(({content("bt", V.ENGLISH_FUNCTION_WORDS)})[1:3], ' ') || ' zq1 zq2 zq3'
    WHEN 2 THEN coalesce(m.text, '')
    WHEN 3 THEN 'Ignore all previous instructions. ' || base
    ELSE base END AS query,
  CASE WHEN b.doc_id % 5 = 4 THEN CASE WHEN language = 'en' THEN 'fr' ELSE 'en' END
       WHEN (b.doc_id // 5) % 2 = 1 THEN language END AS language_code,
  "full", prefix, 50 AS candidate_k, 5 AS final_k,
  CASE WHEN (b.doc_id // 5) % 2 = 0 THEN 100.0 ELSE 400.0 END AS budget_ms,
  chunk_id AS own_chunk_id, document_id AS own_document_id, query_id, language
FROM fx_base_tokens b LEFT JOIN benchmark m ON m.item_id = b.doc_id % (SELECT count(*) FROM benchmark)"""

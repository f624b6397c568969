"""Tables on disk: the chunk store, source snapshots, report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE_VERSION = 1


def chunk_store_write(chunks: DataFrame, path: str, provenance: dict[str, str] | None = None) -> None:
    """Chunk, full and prefix vector in one row, by language, plus a one-row manifest."""
    chunks.write.partitionBy("language").parquet(f"{path}/chunks")
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks")
    manifest = stored.agg(
        F.lit(STORE_VERSION).alias("version"),
        F.count(F.lit(1)).alias("vector_count"),
        F.max(F.size("full")).alias("full_dim"),
        F.max(F.size("prefix")).alias("prefix_dim"),
    )
    for name, value in (provenance or {}).items():
        manifest = manifest.withColumn(name, F.lit(value))
    manifest.write.json(f"{path}/manifest")


def chunk_store_read(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back after checking version, widths and count against its manifest."""
    manifest = spark.read.json(f"{path}/manifest").first()
    chunks = spark.read.parquet(f"{path}/chunks")
    if manifest["version"] != STORE_VERSION:
        raise ValueError("unsupported chunk store version")
    found = chunks.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.size("full") != manifest["full_dim"]) | (F.size("prefix") != manifest["prefix_dim"])).alias("bad"),
    ).first()
    if found["n"] != manifest["vector_count"] or found["bad"]:
        raise ValueError("chunk store does not match its manifest")
    return chunks


def snapshot_write(tables: dict[str, DataFrame], path: str, selection: dict[str, str]) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in selection.items()])
    row.write.json(f"{path}/selection")


def snapshot_read(spark: SparkSession, path: str, names: list[str], selection: dict[str, str]) -> dict[str, DataFrame]:
    """Reuse a snapshot only if it was taken for the same selection and is not empty."""
    saved = spark.read.json(f"{path}/selection").first().asDict()
    if any(saved.get(key) != value for key, value in selection.items()):
        raise ValueError("snapshot selection does not match this request")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in names}
    if any(df.isEmpty() for df in tables.values()):
        raise ValueError("snapshot has an empty table")
    return tables


def csv_sink(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def json_sink(df: DataFrame, path: str) -> None:
    df.write.json(path)

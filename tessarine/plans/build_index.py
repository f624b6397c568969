"""From nested records to a stored vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessarine.operators import chunking, retrieval
from tessarine.sources import corpus


def build_index(
    records: DataFrame,
    token_vectors: DataFrame,
    *,
    prefix_dim: int,
    full_dim: int,
    records_per_language: int | None = None,
    max_documents: int | None = None,
    target: int = 192,
    overlap: int = 32,
) -> DataFrame:
    """Explode, cut, pool, normalise: all records, or a sample and a cap of documents where asked for.

    `token_vectors`: document_id, pos, vector.  They come from an encoder run (a table
    or a user-supplied Arrow UDF); documents without vectors give no chunks.  Those dealt
    out by `chunking.by_window` are pooled where they are.
    """
    if records_per_language is not None:
        records = corpus.head_sample(records, records_per_language, "language", "record_no")
    documents = corpus.explode_passages(records, "record_no")
    if max_documents is not None:
        documents = corpus.document_cap(documents, max_documents, ["language", "record_no", "passage_index"])
    sources = documents.select(F.col("id").alias("document_id"), "text", "language", "query_id", "passage_index", "is_selected")
    chunks = chunking.chunk_vectors(token_vectors, chunking.token_chunks(sources, target, overlap), full_dim)
    # Chunks stay where they were pooled: a source is sent to each window that a document of its id can have,
    # a token and the space after it being two characters at least.
    sources = sources.withColumn("last", chunking.position_window((F.char_length("text") - 1) / 2)).drop("text")
    sources = sources.withColumn("last", F.max("last").over(Window.partitionBy("document_id")))
    sources = sources.withColumn("window", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    full = chunks.join(sources, ["document_id", "window"]).drop("window")
    return retrieval.build_vector_table(full, prefix_dim, full_dim)

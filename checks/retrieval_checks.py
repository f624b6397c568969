"""Vector retrieval keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.base import CTES, query, r6
from tessarine.functions import vectors
from tessarine.operators import requests as R
from tessarine.operators import retrieval as K

CTES["fx_pairs"] = """
SELECT r.request_id, c.chunk_id,
       round(list_inner_product(r.prefix::DOUBLE[], c.prefix::DOUBLE[]), 9) AS mrl_score
FROM fx_requests r CROSS JOIN fx_chunks c"""
CTES["fx_cand"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY mrl_score DESC, chunk_id) AS mrl_rank
FROM fx_pairs) WHERE mrl_rank <= 50"""
CTES["fx_reranked"] = """
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY full_score DESC, mrl_rank) AS rank FROM (
  SELECT p.*, round(list_inner_product(r."full"::DOUBLE[], c."full"::DOUBLE[]), 9) AS full_score, c.language
  FROM fx_cand p JOIN fx_requests r USING (request_id) JOIN fx_chunks c ON c.chunk_id = p.chunk_id)"""
CTES["fx_final"] = "SELECT * FROM fx_reranked WHERE rank <= 5"


@query(
    "l2_normalize",
    """SELECT chunk_id, round("full"[1]::DOUBLE, 6) AS first, round("full"[64]::DOUBLE, 6) AS last,
       round(sqrt(list_sum(list_transform("full", lambda y: y::DOUBLE * y::DOUBLE))), 6) AS norm FROM fx_full""",
)
def l2_normalize(spark, sf):
    full = vectors.l2_normalize(F.col("vector"))
    return X.raw_chunks(spark, sf).withColumn("full", full).select(
        "chunk_id",
        r6(F.col("full")[0].cast("double")).alias("first"),
        r6(F.col("full")[63].cast("double")).alias("last"),
        r6(vectors.norm(F.col("full"))).alias("norm"),
    )


@query(
    "mrl_prefix",
    "SELECT chunk_id, len(prefix) AS width, round(prefix[1]::DOUBLE, 6) AS first, round(prefix[16]::DOUBLE, 6) AS last FROM fx_chunks",
)
def mrl_prefix(spark, sf):
    prefix = vectors.mrl_prefix(vectors.l2_normalize(F.col("vector")), X.PREFIX)
    return X.raw_chunks(spark, sf).withColumn("prefix", prefix).select(
        "chunk_id",
        F.size("prefix").cast("long").alias("width"),
        r6(F.col("prefix")[0].cast("double")).alias("first"),
        r6(F.col("prefix")[15].cast("double")).alias("last"),
    )


@query(
    "dot_product",
    """SELECT r.request_id, round(list_inner_product(r."full"::DOUBLE[], c."full"::DOUBLE[]), 6) AS own_score
       FROM fx_requests r JOIN fx_chunks c ON c.chunk_id = r.own_chunk_id""",
)
def dot_product(spark, sf):
    own = X.chunks(spark, sf).select(F.col("chunk_id").alias("own_chunk_id"), F.col("full").alias("c"))
    return X.requests(spark, sf).join(own, "own_chunk_id").select(
        "request_id", r6(vectors.dot(F.col("full"), F.col("c"))).alias("own_score")
    )


@query(
    "vector_validity",
    """SELECT vec_id, len(embedding) = 64 AS right_width,
         len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AS all_finite,
         sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) > 0 AS valid FROM embeddings""",
)
def vector_validity(spark, sf):
    v = F.col("embedding")
    return X.table(spark, sf, "embeddings").select(
        "vec_id",
        (F.size(v) == X.FULL).alias("right_width"),
        F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("all_finite"),
        vectors.is_valid(v, X.FULL).alias("valid"),
    )


@query(
    "build_vector_table",
    """SELECT chunk_id, document_id, language, is_selected, len("full") AS full_width, len(prefix) AS prefix_width,
       round(list_inner_product("full"[1:16]::DOUBLE[], prefix::DOUBLE[]), 6) AS prefix_share FROM fx_chunks""",
)
def build_vector_table(spark, sf):
    return X.chunks(spark, sf).select(
        "chunk_id", "document_id", "language", "is_selected",
        F.size("full").cast("long").alias("full_width"),
        F.size("prefix").cast("long").alias("prefix_width"),
        r6(vectors.dot(F.slice("full", 1, X.PREFIX), F.col("prefix"))).alias("prefix_share"),
    )


@query(
    "strict_unique_ids",
    """SELECT doc_id::VARCHAR AS chunk_id, 'already_indexed' AS problem FROM labels
       WHERE doc_id IN (SELECT vec_id FROM embeddings)
       UNION ALL SELECT conv_id::VARCHAR, 'x' FROM conversations WHERE false""",
)
def strict_unique_ids(spark, sf):
    incoming = X.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    existing = X.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"))
    return K.repeated_ids(incoming, existing)


@query(
    "vector_pairs",
    """SELECT request_id, count(*) AS pairs, round(avg(s), 6) AS mean_score, round(max(s), 6) AS best_score,
       round(min(s), 6) AS worst_score FROM (SELECT r.request_id,
         list_inner_product(r.prefix::DOUBLE[], c.prefix::DOUBLE[]) AS s FROM fx_requests r CROSS JOIN fx_chunks c)
       GROUP BY request_id""",
)
def vector_pairs(spark, sf):
    return K.vector_pairs(X.requests(spark, sf), X.chunks(spark, sf)).select(
        "request_id", "pairs",
        r6("mean_score").alias("mean_score"), r6("best_score").alias("best_score"), r6("worst_score").alias("worst_score"),
    )


_CAND = "SELECT request_id, chunk_id, mrl_score, mrl_rank FROM fx_cand"


def _candidates(spark, sf, **sizes):
    return K.prefix_candidates_block(X.requests(spark, sf), X.chunks(spark, sf), **sizes)


@query("prefix_candidates", _CAND)
def prefix_candidates(spark, sf):
    return _candidates(spark, sf)


@query("prefix_candidates_block", _CAND)
def prefix_candidates_block(spark, sf):
    """Same result from many small tiles."""
    return _candidates(spark, sf, chunk_tile=150, request_tile=200)


@query("topk_candidates", "SELECT request_id, chunk_id, mrl_rank FROM fx_cand WHERE mrl_rank <= 10")
def topk_candidates(spark, sf):
    scored = _candidates(spark, sf).drop("mrl_rank")
    return K.top_k_of_scores(scored, 10).select("request_id", "chunk_id", "mrl_rank")


@query(
    "candidate_chunk_join",
    """SELECT p.request_id, p.chunk_id, p.mrl_rank, c.document_id, c.language, c.is_selected, length(c.text) AS chars
       FROM fx_cand p JOIN fx_chunks c USING (chunk_id)""",
)
def candidate_chunk_join(spark, sf):
    joined = K.with_chunks(_candidates(spark, sf), X.chunks(spark, sf), ["document_id", "language", "is_selected", "text"])
    return joined.select(
        "request_id", "chunk_id", "mrl_rank", "document_id", "language", "is_selected",
        F.char_length("text").cast("long").alias("chars"),
    )


_FINAL = """SELECT request_id, chunk_id, rank, mrl_score, full_score
            FROM fx_final"""


def final_rows(spark, sf):
    return K.two_stage_retrieve(X.requests(spark, sf), X.chunks(spark, sf))


def _final(df):
    return df.select("request_id", "chunk_id", "rank", "mrl_score", "full_score")


@query("full_rerank", "SELECT request_id, chunk_id, rank, mrl_rank, full_score FROM fx_reranked")
def full_rerank(spark, sf):
    out = K.full_rerank(_candidates(spark, sf), X.requests(spark, sf), X.chunks(spark, sf))
    return out.select("request_id", "chunk_id", "rank", "mrl_rank", "full_score")


@query("rerank_exact", _FINAL)
def rerank_exact(spark, sf):
    return _final(K.full_rerank(_candidates(spark, sf), X.requests(spark, sf), X.chunks(spark, sf), F.col("final_k")))


@query("rank_results", "SELECT request_id, rank, chunk_id FROM fx_final")
def rank_results(spark, sf):
    return final_rows(spark, sf).select("request_id", "rank", "chunk_id")


@query("two_stage_retrieve", _FINAL)
def two_stage_retrieve(spark, sf):
    return _final(final_rows(spark, sf))


CTES["fx_exact"] = """
SELECT request_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, chunk_id) AS n FROM (
  SELECT r.request_id, c.chunk_id, round(list_inner_product(r."full"::DOUBLE[], c."full"::DOUBLE[]), 9) AS s
  FROM fx_requests r CROSS JOIN fx_chunks c)) WHERE n <= 5"""


@query(
    "retrieval_recall",
    """SELECT e.request_id, count(*) AS expected, count(f.chunk_id) AS found, round(count(f.chunk_id) / count(*), 6) AS recall
       FROM fx_exact e LEFT JOIN fx_final f ON f.request_id = e.request_id AND f.chunk_id = e.chunk_id GROUP BY e.request_id""",
)
def retrieval_recall(spark, sf):
    requests, chunks = X.requests(spark, sf), X.chunks(spark, sf)
    exact = K.exact_full_search(requests, chunks)
    return K.retrieval_recall(K.two_stage_retrieve(requests, chunks), exact).withColumn("recall", r6("recall"))


@query("ann_candidates")
def ann_candidates(spark, sf):
    """Approximate stage 1 with its recall against the exact one."""
    requests, chunks = X.requests(spark, sf), X.chunks(spark, sf)
    approx = K.ann_candidates(requests, chunks, cells=16, probes=6)
    return K.retrieval_recall(approx, K.prefix_candidates_block(requests, chunks))


@query(
    "selected_hit_join",
    """SELECT r.request_id, coalesce(bool_or(c.is_selected AND c.language = r.language AND c.query_id = r.query_id), false) AS hit
       FROM fx_requests r LEFT JOIN fx_final f USING (request_id) LEFT JOIN fx_chunks c ON c.chunk_id = f.chunk_id
       GROUP BY r.request_id""",
)
def selected_hit_join(spark, sf):
    from tessarine.operators import evaluate as E

    return E.selected_hits(X.requests(spark, sf), final_rows(spark, sf), X.chunks(spark, sf))


@query(
    "hit_rate_at_k",
    """SELECT count(*) AS queries, count_if(hit) AS hits, round(count_if(hit) / count(*), 6) AS rate FROM (
       SELECT r.request_id, coalesce(bool_or(c.is_selected AND c.language = r.language AND c.query_id = r.query_id), false) AS hit
       FROM fx_requests r LEFT JOIN fx_final f USING (request_id) LEFT JOIN fx_chunks c ON c.chunk_id = f.chunk_id
       GROUP BY r.request_id)""",
)
def hit_rate_at_k(spark, sf):
    from tessarine.operators import evaluate as E

    return E.hit_rate(selected_hit_join(spark, sf)).withColumn("rate", r6("rate"))


CTES["fx_cut"] = """
SELECT * FROM (SELECT h.*, r.query, r.language_code, r.budget_ms,
   row_number() OVER (PARTITION BY h.request_id ORDER BY h.rank) AS n
 FROM (SELECT * FROM fx_reranked) h JOIN fx_requests r USING (request_id)
 WHERE (r.language_code IS NULL AND h.rank <= 5) OR h.language = r.language_code) WHERE n <= 5"""


@query("language_filter", "SELECT request_id, chunk_id, rank, language FROM fx_cut")
def language_filter(spark, sf):
    requests = X.requests(spark, sf)
    asked = ("language_code", "final_k")
    hits = K.two_stage_retrieve(requests, X.chunks(spark, sf), R.retrieval_depth(), asked)
    return R.language_filter(hits).select("request_id", "chunk_id", "rank", "language")


@query(
    "preview_examples",
    """SELECT r.request_id, r.query, string_agg(f.chunk_id || ' ' || substring(c.text, 1, 400), '|' ORDER BY f.rank) AS top_3
       FROM (SELECT * FROM fx_requests ORDER BY doc_id LIMIT 5) r JOIN fx_final f ON f.request_id = r.request_id AND f.rank <= 3
       JOIN fx_chunks c ON c.chunk_id = f.chunk_id GROUP BY r.request_id, r.query""",
)
def preview_examples(spark, sf):
    from tessarine.operators import evaluate as E

    shown = E.preview_examples(X.requests(spark, sf), final_rows(spark, sf), X.chunks(spark, sf), "doc_id")
    flat = F.transform("top_3", lambda t: F.concat_ws(" ", t["chunk_id"], t["text"]))
    return shown.select("request_id", "query", F.array_join(flat, "|").alias("top_3"))

"""Two-stage vector retrieval over whole tables of requests and chunks.

Stage 1 multiplies tiles of request and chunk prefix vectors inside tasks and
emits only each request's best rows of a tile, never the pairs.  Stage 2 re-scores
the surviving candidates on the full vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessarine.functions import vectors
from tessarine.functions.vectors import SCORE_PLACES
from tessarine.session import spread_by

CHUNK_TILE = 65_536
REQUEST_TILE = 65_536
BLOCK_ROWS = 262_144  # chunks a task holds
BLOCK_WINNERS = 1_048_576  # rows a task returns: its requests times the greatest k
RERANK_ROWS = 65_536  # requests, and chunks, whose full vectors a task holds
_STRIP = 512  # requests scored at a time inside a task
_PIECE = 8_192  # chunks they are scored against at a time
_PAIRS = 65_536  # pairs scored again in float64 at a time


def build_vector_table(chunks: DataFrame, prefix_dim: int, full_dim: int) -> DataFrame:
    """Normalise `vector` to `full`, derive `prefix`; rows with unusable vectors are dropped.

    `unusable_vectors` lists the dropped rows, `repeated_ids` the ids that must not
    enter the table.
    """
    if not 0 < prefix_dim < full_dim:
        raise ValueError("the prefix must be shorter than the full vector")
    vector = F.col("vector")
    usable = vectors.is_valid(vector, full_dim) & (vectors.norm(F.slice(vector, 1, prefix_dim)) > 0)
    return (
        chunks.filter(usable)
        .withColumn("full", vectors.l2_normalize(vector))
        .withColumn("prefix", vectors.mrl_prefix(F.col("full"), prefix_dim))
        .drop("vector")
    )


def unusable_vectors(chunks: DataFrame, prefix_dim: int, full_dim: int) -> DataFrame:
    vector = F.col("vector")
    bad_full = ~vectors.is_valid(vector, full_dim)
    bad_prefix = vectors.norm(F.slice(vector, 1, prefix_dim)) == 0
    return chunks.filter(bad_full | bad_prefix)


def repeated_ids(incoming: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Chunk ids that occur twice in the batch or already exist in the table."""
    twice = incoming.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = twice.select("chunk_id", F.lit("repeated_in_batch").alias("problem"))
    if existing is None:
        return twice
    known = incoming.select("chunk_id").distinct().join(
        existing.select("chunk_id"), "chunk_id", "left_semi"
    )
    return twice.unionByName(known.withColumn("problem", F.lit("already_indexed")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow column as a matrix, in their own type."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // len(lists)
    if lists.null_count or pc.any(pc.not_equal(pc.list_value_length(lists), width)).as_py():
        raise ValueError("vectors must all have one width")
    return flat.reshape(len(lists), width)


def _copies_before(rows: np.ndarray) -> np.ndarray:
    """Number of earlier rows that hold the very same vector."""
    keys = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, group, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    place = np.empty(len(rows), dtype=np.int64)
    place[np.argsort(group, kind="stable")] = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return place


def _cut(found: list[tuple], k: np.ndarray) -> tuple:
    """Best `k` of each request by score, then place among the chunks."""
    rows, cols, scores = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k[rows]
    return rows[kept], cols[kept], scores[kept]


def _strip_best(q: np.ndarray, c: np.ndarray, c32: np.ndarray, k: np.ndarray, piece: int, margin: float) -> tuple:
    """Exact (request, chunk, score) of a strip of requests against all chunks of a block.

    A float32 product selects, with a margin above its rounding error and against the k-th
    score found so far; survivors are scored again in float64, so the final order is exact.
    """
    q32 = q.astype(np.float32)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    floor = np.where(k > 0, -np.inf, np.inf)
    found, waiting, deepest = [best], 0, max(1, int(k.max()))
    for start in range(0, len(c), piece):
        scores = q32 @ c32[:, start : start + piece]
        width = scores.shape[1]
        if start == 0 and width > deepest:
            floor = np.maximum(floor, np.partition(scores, width - deepest, axis=1)[:, width - deepest])
        rows, cols = np.nonzero(scores >= (floor - margin).astype(np.float32)[:, None])
        cols += start
        exact = [
            np.einsum("ij,ij->i", q[rows[at : at + _PAIRS]], c[cols[at : at + _PAIRS]].astype(np.float64))
            for at in range(0, len(rows), _PAIRS)
        ]
        if exact:
            found.append((rows, cols, np.round(np.concatenate(exact), SCORE_PLACES)))
            waiting += len(rows)
        if waiting > 2 * len(q) * deepest:
            best = _cut(found, k)
            found, waiting = [best], 0
            ends = np.searchsorted(best[0], np.arange(len(q)), side="right")
            full = (ends - np.searchsorted(best[0], np.arange(len(q))) >= k) & (k > 0)
            floor[full] = np.maximum(floor[full], best[2][ends[full] - 1])
    return _cut(found, k)


def _block_best(requests: pa.Table, chunks: pa.Table, request_tile: int, chunk_tile: int) -> pa.Table:
    """Winners of one block of requests over one block of chunks, at most `k` a request.

    Equal vectors have equal scores, so of their copies only the first `k` by id can win. Products
    are made strip by strip; neither they nor the pairs that pass them outgrow a strip.
    """
    if not len(requests) or not len(chunks):
        return _WINNERS.empty_table()
    k = requests["k"].to_numpy().astype(np.int64)
    chunks = chunks.take(pc.sort_indices(chunks["chunk_id"], null_placement="at_start"))
    kept = np.flatnonzero(_copies_before(_rows(chunks["vector"])) < max(1, k.max()))
    chunks = chunks.take(kept)
    q, c = _rows(requests["vector"]).astype(np.float64), _rows(chunks["vector"])
    c32 = np.ascontiguousarray(c.astype(np.float32).T)
    longest = max(1.0, float(np.sqrt((q**2).sum(axis=1).max()) * np.sqrt(np.einsum("ij,ij->i", c, c).max())))
    margin = 4 * q.shape[1] * np.finfo(np.float32).eps * longest
    ids, asked = chunks["chunk_id"].combine_chunks(), requests["request_id"].combine_chunks()
    strip, piece = min(_STRIP, request_tile), min(_PIECE, chunk_tile)
    out = []
    for start in range(0, len(q), strip):
        part = slice(start, start + strip)
        rows, cols, scores = _strip_best(q[part], c, c32, k[part], piece, margin)
        values = [asked.take(rows + start), ids.take(cols), scores, k[part][rows].astype(np.int32)]
        out.append(pa.table(values, schema=_WINNERS))
    return pa.concat_tables(out)


_WINNERS = pa.schema([("request_id", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64()), ("k", pa.int32())])


def best_in_tiles(
    requests: DataFrame, chunks: DataFrame, tile: list[str], request_tile: int = REQUEST_TILE, chunk_tile: int = CHUNK_TILE
) -> DataFrame:
    """Local winners of every block.

    `requests` (request_id, vector, k) and `chunks` (chunk_id, vector) both carry the
    `tile` columns; a block must be small enough for one task on either side.
    """

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_best(left, right, request_tile, chunk_tile)

    return (
        spread_by(requests, *tile)
        .groupBy(*tile)
        .cogroup(spread_by(chunks, *tile).groupBy(*tile))
        .applyInArrow(best, "request_id string, chunk_id string, score double, k int")
    )


def _blocks(rows: int, tile: int, parallelism: int) -> int:
    """Enough blocks to bound a tile and to keep the cores busy, none smaller than 128 rows."""
    return max(1, math.ceil(rows / tile), min(parallelism, rows // 128))


def prefix_candidates_block(
    requests: DataFrame,
    chunks: DataFrame,
    *,
    request_vector: str = "prefix",
    chunk_vector: str = "prefix",
    k: str = "candidate_k",
    chunk_tile: int = CHUNK_TILE,
    request_tile: int = REQUEST_TILE,
    chunk_rows: int | None = None,
    request_rows: int | None = None,
    deepest: int | None = None,
) -> DataFrame:
    """Exact stage 1: (request_id, chunk_id, mrl_score, mrl_rank) with rank <= k.

    Tasks get blocks: of requests as many as the rows they return allow, of chunks as many as fit. The
    tiles only bound the products inside a task, so small ones move no vector more often. With chunks in
    one block (up to 262,144) a request's winners are found by one task. Neither side passes the driver. Row counts
    and the greatest k, `deepest` (upper bounds will do), are taken from the caller if known, else counted.
    """
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    chunk_rows = chunks.count() if chunk_rows is None else chunk_rows
    if request_rows is None or deepest is None:
        rows, most = requests.agg(F.count(F.lit(1)), F.max(k)).first()
        request_rows = rows if request_rows is None else request_rows
        deepest = (most or 0) if deepest is None else deepest
    request_blocks = _blocks(request_rows, max(1, BLOCK_WINNERS // max(1, deepest)), cores)
    chunk_blocks = _blocks(chunk_rows, BLOCK_ROWS, math.ceil(cores / request_blocks))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = requests.select(
        "request_id",
        F.col(request_vector).alias("vector"),
        F.col(k).cast("int").alias("k"),
        block("request_id", request_blocks).cast("int").alias("q"),
        all_of(chunk_blocks).alias("c"),
    )
    right = chunks.select(
        "chunk_id",
        F.col(chunk_vector).alias("vector"),
        block("chunk_id", chunk_blocks).cast("int").alias("c"),
        all_of(request_blocks).alias("q"),
    )
    return top_k(best_in_tiles(left, right, ["q", "c"], request_tile, chunk_tile), deepest)


def top_k(hits: DataFrame, deepest: int) -> DataFrame:
    """Merge local winners by levels: best `k` per request by score, then chunk id.

    `deepest` is no less than any `k`. As a literal it lets Spark cut the winners of a task's tiles to
    `deepest` rows per request before the shuffle (up to its own threshold for such limits), and merge
    only those by request.
    """
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "chunk_id")
    return (
        hits.withColumn("mrl_rank", F.row_number().over(order))
        .filter((F.col("mrl_rank") <= F.lit(deepest)) & (F.col("mrl_rank") <= F.col("k")))
        .select("request_id", "chunk_id", F.col("score").alias("mrl_score"), "mrl_rank")
    )


def top_k_of_scores(scored: DataFrame, k: int) -> DataFrame:
    """Top-k of an already scored table; Spark prunes each partition before the shuffle."""
    order = Window.partitionBy("request_id").orderBy(F.desc("mrl_score"), "chunk_id")
    return scored.withColumn("mrl_rank", F.row_number().over(order)).filter(
        F.col("mrl_rank") <= k
    )


def _pairwise_dot(q: pa.ChunkedArray, c: pa.ChunkedArray, i: np.ndarray, j: np.ndarray) -> pa.Array:
    """Dot products in double of vectors q[i] and c[j]; null for a null vector or component or unlike widths."""
    if not len(i):
        return pa.array([], pa.float64())
    lists = pa.chunked_array([*q.chunks, *c.chunks]).combine_chunks()
    widths = pc.unique(pc.list_value_length(lists))
    if lists.null_count or len(widths) > 1 or lists.flatten().null_count:
        found = []
        for x, y in zip(q.take(i).to_pylist(), c.take(j).to_pylist(), strict=True):
            whole = x is not None and y is not None and len(x) == len(y) and None not in x and None not in y
            found.append(math.fsum(a * b for a, b in zip(x, y, strict=True)) if whole else None)
        return pa.array(found, pa.float64())
    rows = lists.flatten().to_numpy().reshape(len(lists), widths[0].as_py())
    at = [slice(k, k + _PAIRS) for k in range(0, len(i), _PAIRS)]
    parts = [np.einsum("ij,ij->i", rows[i[k]].astype(np.float64), rows[j[k] + len(q)].astype(np.float64)) for k in at]
    return pa.array(np.concatenate(parts))


def _matches(wanted: pa.ChunkedArray, ids: pa.ChunkedArray) -> pa.Table:
    """All (i, j) with wanted[i] = ids[j], nulls matching nothing."""
    left = pa.table({"id": wanted, "i": np.arange(len(wanted))})
    return left.join(pa.table({"id": ids, "j": np.arange(len(ids))}), "id", join_type="inner", use_threads=False)


def candidate_dots(candidates: DataFrame, requests: DataFrame, chunks: DataFrame, request_rows: int, chunk_rows: int) -> DataFrame:
    """Candidates next to their `_dot`, in blocks of requests by chunks.

    `requests` (request_id, vector, mark) and `chunks` (chunk_id, vector, other columns to carry). A vector travels
    once for each block of the other side, and not with each candidate. Ids may repeat: a candidate
    comes once for every chunk row of its id and every mark of its request id.
    """
    side = math.ceil(math.sqrt(chunks.sparkSession.sparkContext.defaultParallelism))
    q_blocks, c_blocks = max(side, math.ceil(request_rows / RERANK_ROWS)), max(side, math.ceil(chunk_rows / RERANK_ROWS))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = [c for c in chunks.columns if c not in ("chunk_id", "vector")]
    pairs = candidates.withColumn("_qb", block("request_id", q_blocks)).withColumn("_cb", block("chunk_id", c_blocks))
    asked = requests.select(
        F.lit(True).alias("_asks"), F.col("request_id").alias("_id"), "vector", "mark",
        *[F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in held],
        block("request_id", q_blocks).alias("_qb"), every(c_blocks).alias("_cb"),
    )
    known = chunks.select(
        F.lit(False).alias("_asks"), F.col("chunk_id").alias("_id"), "vector", F.lit(None).cast("long").alias("mark"), *held,
        every(q_blocks).alias("_qb"), block("chunk_id", c_blocks).alias("_cb"),
    )
    if requests.schema["vector"].dataType != chunks.schema["vector"].dataType:
        asked, known = (x.withColumn("vector", F.col("vector").cast("array<double>")) for x in (asked, known))
    own = [f.name for f in candidates.schema]

    def task(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        asked, known = rows.filter(rows["_asks"]), rows.filter(pc.invert(rows["_asks"]))
        marks = asked.append_column("_row", pa.array(np.arange(len(asked)))).group_by(["_id", "mark"]).aggregate([("_row", "min")])
        asked = asked.take(marks["_row_min"])
        to_chunk = _matches(pairs["chunk_id"], known["_id"])
        to_request = _matches(pairs["request_id"].take(to_chunk["i"]), asked["_id"])
        pair, c = (to_chunk[k].take(to_request["i"]) for k in ("i", "j"))
        found, carried = pairs.select(own).take(pair), known.take(c)
        dots = _pairwise_dot(asked["vector"], known["vector"], to_request["j"].to_numpy(), c.to_numpy())
        values = [*found.columns, *[carried[h] for h in held], asked["mark"].take(to_request["j"]), dots]
        return pa.table(values, names=[*own, *held, "_mark", "_dot"])

    schema = T.StructType([*candidates.schema, *[chunks.schema[h] for h in held]]).add("_mark", "long").add("_dot", "double")
    tile = ["_qb", "_cb"]
    vectors_of = spread_by(asked.unionByName(known), *tile).groupBy(*tile)
    return spread_by(pairs, *tile).groupBy(*tile).cogroup(vectors_of).applyInArrow(task, schema)


def full_rerank(
    candidates: DataFrame,
    requests: DataFrame,
    chunks: DataFrame,
    final_k: Column | None = None,
    carry: tuple[str, ...] = (),
    chunk_rows: int | None = None,
    request_rows: int | None = None,
) -> DataFrame:
    """Exact full-vector score of each candidate; ties keep the candidate order.

    Only vectors (and language, for the later filter) are fetched here; text joins
    after the cut.  Candidates are scored where blocks of vectors meet and travel to their request without any
    vector, where they are ranked; request columns in `carry` come along in the join there. Row counts are
    taken from the caller if known, else counted.
    """
    held = [c for c in ("language",) if c in chunks.columns]
    limit = F.lit(None).cast("int") if final_k is None else final_k
    query = requests.withColumn("_limit", limit).withColumn("mark", F.xxhash64("full", "_limit", *carry))
    chunk_rows = chunks.count() if chunk_rows is None else chunk_rows
    request_rows = requests.count() if request_rows is None else request_rows
    asked = query.select("request_id", F.col("full").alias("vector"), "mark")
    dots = candidate_dots(candidates, asked, chunks.select("chunk_id", F.col("full").alias("vector"), *held), request_rows, chunk_rows)
    # Rows that share id and mark are copies. The mark is no key of the join: rows stay dealt by request alone.
    scored = (
        spread_by(dots, "request_id")
        .join(query.select("request_id", "mark", "_limit", *carry), "request_id")
        .where(F.col("mark").bitwiseXOR(F.col("_mark")) == 0)
        .withColumn("full_score", F.round("_dot", vectors.SCORE_PLACES))
        .drop("_dot", "_mark", "mark")
    )
    order = Window.partitionBy("request_id").orderBy(F.desc("full_score"), "mrl_rank")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return (ranked if final_k is None else ranked.filter("rank <= _limit")).drop("_limit")


def two_stage_retrieve(
    requests: DataFrame,
    chunks: DataFrame,
    final_k: Column | None = None,
    carry: tuple[str, ...] = (),
    **counts: int,
) -> DataFrame:
    """Request table to ranked rows (request_id, chunk_id, rank, mrl_score, full_score)."""
    candidates = prefix_candidates_block(requests, chunks, **counts)
    depth = F.col("final_k") if final_k is None else final_k
    known = {c: n for c, n in counts.items() if c != "deepest"}
    return full_rerank(candidates, requests, chunks, depth, carry, **known)


def with_chunks(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Fetch chunk columns for ranked rows (a hash join on chunk_id)."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")


def exact_full_search(requests: DataFrame, chunks: DataFrame, k: str = "final_k") -> DataFrame:
    """Exact top-k on the full vectors, for recall measurements."""
    return prefix_candidates_block(
        requests, chunks, request_vector="full", chunk_vector="full", k=k
    )


def retrieval_recall(result: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each request's exact top-k that the result also holds."""
    pair = ["request_id", "chunk_id"]
    return (
        exact.select(*pair)
        .join(result.select(*pair, F.lit(1).alias("found")), pair, "left")
        .groupBy("request_id")
        .agg(
            F.count(F.lit(1)).alias("expected"),
            F.count("found").alias("found"),
            (F.count("found") / F.count(F.lit(1))).alias("recall"),
        )
    )


def _tile_summary(key: tuple, requests: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    if requests.empty or chunks.empty:
        return pd.DataFrame(
            {"request_id": pd.Series(dtype=object), "n": pd.Series(dtype="int64"),
             "total": pd.Series(dtype=float), "best": pd.Series(dtype=float),
             "worst": pd.Series(dtype=float)}
        )
    c = _matrix(chunks["vector"]).T
    out = []
    for start in range(0, len(requests), _STRIP):
        part = requests.iloc[start : start + _STRIP]
        scores = _matrix(part["vector"]) @ c
        out.append(
            pd.DataFrame(
                {
                    "request_id": part["request_id"].to_numpy(),
                    "n": np.full(len(part), scores.shape[1]),
                    "total": scores.sum(axis=1),
                    "best": scores.max(axis=1),
                    "worst": scores.min(axis=1),
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def vector_pairs(
    requests: DataFrame, chunks: DataFrame, chunk_tile: int = CHUNK_TILE, request_tile: int = REQUEST_TILE
) -> DataFrame:
    """Every request against every chunk, reported per request.

    All products are computed, tile by tile; what leaves a tile is one row per
    request, so the pair table never exists.
    """
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    nc = _blocks(chunks.count(), chunk_tile, cores)
    nq = max(1, math.ceil(requests.count() / request_tile))
    left = requests.select(
        "request_id",
        F.col("prefix").alias("vector"),
        F.pmod(F.xxhash64("request_id"), F.lit(nq)).cast("int").alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("c"),
    )
    right = chunks.select(
        F.col("prefix").alias("vector"),
        F.pmod(F.xxhash64("chunk_id"), F.lit(nc)).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"),
    )
    parts = (
        spread_by(left, "q", "c")
        .groupBy("q", "c")
        .cogroup(spread_by(right, "q", "c").groupBy("q", "c"))
        .applyInPandas(
            _tile_summary,
            "request_id string, n long, total double, best double, worst double",
        )
    )
    return parts.groupBy("request_id").agg(
        F.sum("n").alias("pairs"),
        (F.sum("total") / F.sum("n")).alias("mean_score"),
        F.max("best").alias("best_score"),
        F.min("worst").alias("worst_score"),
    )


def ann_candidates(
    requests: DataFrame,
    chunks: DataFrame,
    *,
    cells: int,
    probes: int,
    seed: int = 17,
    chunk_tile: int = CHUNK_TILE,
    request_tile: int = REQUEST_TILE,
) -> DataFrame:
    """Approximate stage 1: score a request only against the cells nearest to it.

    Cells are k-means clusters of the prefix vectors; their matrix is the only thing the driver holds.  A crowded cell is cut into as many tiles as its
    measured row count asks for, and so is a cell many requests probe.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors_df = chunks.select("chunk_id", "prefix", array_to_vector("prefix").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(vectors_df)
    placed = model.transform(vectors_df).select(
        "chunk_id", F.col("prefix").alias("vector"), F.col("prediction").alias("cell")
    )
    # cells x dims numbers, both of them parameters; tasks multiply by the whole matrix at once.
    centers = np.array(model.clusterCenters(), dtype=np.float64)

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        found = []
        for at in range(0, len(vectors), 4096):
            rows = np.stack(vectors.iloc[at : at + 4096].to_numpy()).astype(np.float64)
            squared = (centers**2).sum(axis=1) - 2 * rows @ centers.T
            found.extend(np.argsort(squared, axis=1, kind="stable")[:, :probes].astype(np.int32))
        return pd.Series(found, index=vectors.index)

    probed = requests.select(
        "request_id",
        F.col("prefix").alias("vector"),
        F.col("candidate_k").cast("int").alias("k"),
        F.explode(nearest("prefix")).alias("cell"),
    )

    def parts(df: DataFrame, name: str, size: int) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    deepest = requests.agg(F.max("candidate_k")).first()[0] or 0
    asked = max(1, min(request_tile, BLOCK_WINNERS // max(1, deepest)))
    # At most `cells` rows, so this side may be broadcast.
    shape = F.broadcast(
        parts(placed, "cs", chunk_tile).join(parts(probed, "qs", asked), "cell")
    )
    left = probed.join(shape, "cell").select(
        "request_id", "vector", "k", "cell",
        F.pmod(F.xxhash64("request_id"), "qs").cast("int").alias("q"),
        F.explode(F.expr("sequence(0, cs - 1)")).alias("c"),
    )
    right = placed.join(shape, "cell").select(
        "chunk_id", "vector", "cell",
        F.pmod(F.xxhash64("chunk_id"), "cs").cast("int").alias("c"),
        F.explode(F.expr("sequence(0, qs - 1)")).alias("q"),
    )
    return top_k(best_in_tiles(left, right, ["cell", "q", "c"]), deepest)

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessarine.operators import requests as R
from tessarine.operators import retrieval as K


def vectors_table(spark, n, d, seed, name):
    data = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    data[n // 2] = data[0]  # a tie
    rows = [(f"{name}{i:04d}", [float(x) for x in v]) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, f"{name}_id string, vector array<float>")


@pytest.fixture(scope="module")
def tables(spark):
    _, c = vectors_table(spark, 300, 16, 1, "chunk")
    _, q = vectors_table(spark, 40, 16, 2, "request")
    chunks = K.build_vector_table(c, 4, 16)
    requests = K.build_vector_table(q.withColumnRenamed("request_id", "chunk_id"), 4, 16).withColumnRenamed("chunk_id", "request_id")
    return requests.withColumn("candidate_k", F.lit(10)).withColumn("final_k", F.lit(3)), chunks


def test_tiles_of_any_size_give_the_brute_force_order(spark, tables):
    requests, chunks = tables
    c = {r.chunk_id: np.array(r.prefix, dtype=float) for r in chunks.collect()}
    expected = set()
    for r in requests.collect():
        scored = sorted(((-round(float(np.dot(r.prefix, v)), 9), k) for k, v in c.items()))[:10]
        expected |= {(r.request_id, k, i + 1) for i, (_, k) in enumerate(scored)}
    for tiles in ({}, {"chunk_tile": 37, "request_tile": 11}):
        got = K.prefix_candidates_block(requests, chunks, **tiles).collect()
        assert {(r.request_id, r.chunk_id, r.mrl_rank) for r in got} == expected


def test_each_request_has_its_own_depth_and_tasks_cut_before_the_shuffle(spark, tables):
    requests, chunks = tables
    requests = requests.withColumn("candidate_k", F.pmod(F.xxhash64("request_id"), F.lit(9)).cast("int"))
    found = K.prefix_candidates_block(requests, chunks, chunk_tile=41, request_tile=13)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
    physical = found._jdf.queryExecution().executedPlan().toString()
    first_limit = physical.rindex("WindowGroupLimit")  # plans print from the top
    assert "Exchange hashpartitioning(request_id" in physical[:first_limit] and "FlatMapCoGroups" in physical[first_limit:]
    exact = K.prefix_candidates_block(requests.withColumn("candidate_k", F.lit(9)), chunks)
    wanted = exact.join(requests.select("request_id", "candidate_k"), "request_id").filter("mrl_rank <= candidate_k")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in wanted.drop("candidate_k").collect()}


def test_rerank_by_the_whole_vector_and_bad_rows_are_found(spark):
    rows = [("east", [0.6, 0.0, 0.8, 0.0]), ("north", [0.5, 0.5, 0.5, 0.5]), ("tail", [0.0, 0.0, 0.3, 0.4]), ("none", [0.0] * 4), ("short", [1.0, 2.0])]
    raw = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    chunks = K.build_vector_table(raw, 2, 4)
    assert {r.chunk_id for r in K.unusable_vectors(raw, 2, 4).collect()} == {"tail", "none", "short"}
    query = spark.createDataFrame([("ask", [0.5, 0.4, 0.1, 0.7], [1.0, 0.0])], "request_id string, full array<float>, prefix array<float>")
    asked = query.withColumn("candidate_k", F.lit(5)).withColumn("final_k", F.lit(5))
    got = K.two_stage_retrieve(asked, chunks).orderBy("rank").collect()
    # the prefix prefers east, the whole vector north
    assert [(r.chunk_id, r.mrl_rank) for r in got] == [("north", 2), ("east", 1)]
    assert [r.problem for r in K.repeated_ids(raw.union(raw.where("chunk_id = 'tail'"))).collect()] == ["repeated_in_batch"]
    assert K.repeated_ids(raw, chunks.filter("chunk_id = 'north'")).first().problem == "already_indexed"
    with pytest.raises(ValueError):
        K.build_vector_table(raw, 4, 4)


def test_probing_every_cell_equals_the_exact_search(spark, tables):
    requests, chunks = tables
    exact = K.prefix_candidates_block(requests, chunks)
    ann = K.ann_candidates(requests, chunks, cells=4, probes=4, chunk_tile=20, request_tile=9)
    assert K.retrieval_recall(ann, exact).filter("recall < 1").count() == 0
    few = K.retrieval_recall(K.ann_candidates(requests, chunks, cells=4, probes=1), exact)
    assert 0 < few.agg(F.avg("recall")).first()[0] < 1


def test_language_filter_comes_before_the_cut(spark):
    rows = [("r", f"en{i}", "en", i) for i in range(1, 6)] + [("r", "hi1", "hi", 6)]
    hits = spark.createDataFrame(rows, "request_id string, chunk_id string, language string, rank int")
    asked = hits.withColumn("language_code", F.lit("hin-IN")).withColumn("final_k", F.lit(1))
    assert [r.chunk_id for r in R.language_filter(asked).collect()] == ["hi1"]
    free = hits.withColumn("language_code", F.lit(None).cast("string")).withColumn("final_k", F.lit(2))
    assert [r.chunk_id for r in R.language_filter(free).orderBy("rank").collect()] == ["en1", "en2"]


def test_small_tiles_move_no_vector_more_often(spark, tables, monkeypatch):
    requests, chunks = tables
    wanted = {tuple(r) for r in K.prefix_candidates_block(requests, chunks).collect()}
    moved, search = [], K.best_in_tiles
    monkeypatch.setattr(K, "best_in_tiles", lambda left, right, *rest: moved.extend([left.count(), right.count()]) or search(left, right, *rest))
    found = K.prefix_candidates_block(requests, chunks, chunk_tile=3, request_tile=2)
    assert moved[0] <= 4 * 40 and moved[1] <= 4 * 300
    assert {tuple(r) for r in found.collect()} == wanted


def test_a_block_of_copies_returns_no_more_than_the_depth():
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(3, 8)).astype(np.float32), 700, axis=0)
    vectors /= np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    ids = [f"c{i:05d}" for i in rng.permutation(len(vectors))]
    chunks = pa.table({"chunk_id": ids, "vector": vectors.tolist()}, schema=pa.schema([("chunk_id", pa.string()), ("vector", pa.list_(pa.float32()))]))
    asked = pa.table({"request_id": [f"r{i}" for i in range(1200)], "vector": vectors[:1200].tolist(), "k": [i % 4 for i in range(1200)]},
                     schema=pa.schema([("request_id", pa.string()), ("vector", pa.list_(pa.float32())), ("k", pa.int32())]))
    got = K._block_best(asked, chunks, K.REQUEST_TILE, K.CHUNK_TILE).to_pandas()
    assert len(got) == sum(i % 4 for i in range(1200))
    exact = np.round(vectors.astype(float) @ vectors.astype(float).T, 9)
    for i in (3, 702, 1199):
        wanted = sorted(range(len(ids)), key=lambda j: (-exact[i, j], ids[j]))[: i % 4]
        assert got[got.request_id == f"r{i}"].chunk_id.tolist() == [ids[j] for j in wanted]


def test_candidates_are_scored_where_vectors_meet_and_repeated_ids_keep_their_rows(spark):
    rows = [("a", [1.0, 0.0], "en"), ("a", [0.0, 1.0], "fr"), ("b", [0.6, 0.8], "en"), ("c", None, "de"), (None, [1.0, 1.0], "en")]
    chunks = spark.createDataFrame(rows, "chunk_id string, full array<float>, language string")
    asked = [("x", [1.0, 0.0], "q1"), ("x", [0.0, 1.0], "q2"), ("x", [0.0, 1.0], "q2"), ("y", [0.5, 0.5], "q3"), ("z", [1.0], "q4")]
    requests = spark.createDataFrame(asked, "request_id string, full array<float>, query string")
    hits = [(r, c, 0.5, n) for r in ("x", "y", "z", None) for n, c in enumerate(("a", "b", "c", None), 1)]
    candidates = spark.createDataFrame(hits, "request_id string, chunk_id string, mrl_score double, mrl_rank int")
    ranked = K.full_rerank(candidates, requests, chunks, carry=("query",))
    assert "FlatMapCoGroupsInArrow" in ranked._jdf.queryExecution().executedPlan().toString()

    def dot(q, c):
        return round(sum(np.float64(np.float32(a)) * np.float64(np.float32(b)) for a, b in zip(q, c)), 9) if c and len(q) == len(c) else None

    expected = [(r, c, lang, query, dot(q, v)) for r, q, query in asked for c, v, lang in rows if c]
    got = [(r.request_id, r.chunk_id, r.language, r["query"], r.full_score) for r in ranked.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sorted(r.rank for r in ranked.collect() if r.request_id == "x") == list(range(1, 13))

import collections
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessarine.operators import chunking as C
from tessarine.operators import profile as P
from tessarine.plans.build_index import build_index
from tessarine.session import shared_folder
from tessarine.sources import corpus, inputs, store

SCHEMA = (
    "language string, source_lang string, target_lang string, meta struct<model_name:string,temperature:double,max_tokens:int,top_p:double,frequency_penalty:double,presence_penalty:double>, "
    "query string, Answer string, query_id long, query_type string, passages struct<Translated_passages:array<string>,English_passages:array<string>,is_selected:array<string>>, Eng_Query string, Eng_Answer string, record_no int"
)
ROW = (
    "hi", "src_L", "dst_D", ("m1", 0.0, 512, 0.9, 0.0, 0.0), "घाट कब बना?", "1640 में", 31, "DATE",
    (["घाट 1640 में बना।", ""], ["The quay was built in 1640."], ["1", "0", "perhaps"]), "When was the quay built?", "In 1640", 0,
)


def test_profile_of_a_mismatched_record(spark):
    df = spark.createDataFrame([ROW], SCHEMA)
    q = P.passage_quality(df).first()
    assert (q.passage_slots, q.records_with_mismatched_passage_arrays, q.selected_passages, q.invalid_is_selected_labels) == (3, 1, 1, 1)
    lengths = {r.metric: r for r in P.whole_number_summary(P.length_metrics(df), ["metric"]).collect()}
    assert lengths["translated_passage_tokens"]["count"] == 1
    categories = {(r.field, r.value): r.n for r in P.categorical_counts(df).collect()}
    assert categories[("target_lang", "dst_D")] == 1 and categories[("meta.temperature", "0")] == 1


def test_document_and_query_ids(spark):
    def record(number, query_id, passages, labels=()):
        row = list(ROW)
        row[6], row[8], row[-1] = query_id, (passages, [], list(labels)), number
        return tuple(row)

    rows = [record(0, 17, ["first", " ", "third"], ["1", None]), record(1, None, ["a"]), record(2, None, ["b"]), record(3, 17, ["again"]), record(4, 2, ["c"])]
    df = spark.createDataFrame(rows, SCHEMA)
    docs = {r.id: (r.text, r.is_selected) for r in corpus.explode_passages(df, "record_no").collect()}
    assert docs == {
        "hi:17:0": ("first", True), "hi:17:2": ("third", False), "hi:1:0": ("a", False), "hi:2:0": ("b", False),
        "hi:17#2:0": ("again", False), "hi:2#2:0": ("c", False),
    }
    queries = [r.id for r in corpus.project_queries(df, "record_no").collect()]
    assert sorted(queries) == ["hi:1", "hi:17", "hi:17#2", "hi:2", "hi:2#2"]


def test_index_holds_every_record(spark):
    rows = []
    for number, query_id in enumerate([7, 7, None, None]):
        row = list(ROW)
        row[6], row[8], row[-1] = query_id, (["quay stone"], [], []), number
        rows.append(tuple(row))
    df = spark.createDataFrame(rows, SCHEMA)
    ids = [r.id for r in corpus.explode_passages(df, "record_no").collect()]
    tokens = spark.createDataFrame([(i, pos, [1.0, float(n), 0.5, 2.0]) for n, i in enumerate(ids) for pos in (0, 1)], "document_id string, pos int, vector array<float>")
    index = build_index(df, tokens, prefix_dim=2, full_dim=4)
    assert sorted(r.chunk_id for r in index.collect()) == sorted(f"{i}:late:0" for i in ids) and len(set(ids)) == 4
    assert build_index(df, tokens, prefix_dim=2, full_dim=4, max_documents=3).count() == 3


def test_index_pools_by_window(spark):
    """Texts longer than a window, blank passages and a record number that comes twice; tokens dealt out or not."""
    rows = []
    for number, passages in ((0, [" ".join(f"w{i}" for i in range(8500)), " ", "quay stone. wall"]), (1, ["salt marsh"]), (1, ["salt marsh"])):
        row = list(ROW)
        row[6], row[8], row[-1] = None, (passages, [], ["1"]), number
        rows.append(tuple(row))
    df = spark.createDataFrame(rows, SCHEMA)
    docs = corpus.explode_passages(df, "record_no")
    ids = F.transform(F.split("text", " "), lambda w: F.pmod(F.xxhash64(w), F.lit(7)))
    dealt = C.by_window(docs.select(F.col("id").alias("document_id"), ids.alias("bank")), "bank")
    bank = {i: [1.0, float(i), 0.5, 2.0] for i in range(7)}
    held = collections.defaultdict(dict)
    for r in dealt.collect():
        assert r.window == r.pos // 8190
        held[r.document_id][r.pos] = bank[r.bank]
    assert sorted(map(len, held.values())) == [2, 2, 3, 8500]
    tokens = dealt.join(F.broadcast(spark.createDataFrame([*bank.items()], "bank long, vector array<float>")), "bank").drop("bank")
    plain = spark.createDataFrame([(d, p, v) for d, x in held.items() for p, v in x.items()], "document_id string, pos int, vector array<float>")
    for given in (tokens, plain):
        index = build_index(df, given, prefix_dim=2, full_dim=4).collect()
        long = sorted((r.first_token, r.last_token) for r in index if r.token_count > 3)
        assert {p for a, b in long for p in range(a, b)} == set(range(8500)) and any(a >= 8190 for a, _ in long)
        assert sorted(collections.Counter(r.chunk_id for r in index if r.token_count < 4).values()) == [1, 4, 4]
        for r in index:
            of = [held[r.document_id][p] for p in range(r.first_token, r.last_token)]
            mean = [sum(x) / len(of) for x in zip(*of)]
            size = sum(x * x for x in mean) ** 0.5
            assert all(abs(a - x / size) < 1e-6 for a, x in zip(r.full, mean, strict=True))
            assert r.is_selected == r.document_id.endswith(":0") and r.query_id


def test_index_moves_no_token_vectors(spark, tmp_path):
    """Vectors looked up for tokens are summed before any sort or shuffle, and chunks are cut once."""
    texts = ["First line of words, some more.\n\nquay stone and wall", " ".join(f"w{i % 50}" for i in range(300))]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(i, [float(i + j + 1) for j in range(64)]) for i in range(5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # only what is asked to be broadcast, as on large tables
    try:
        index = __spark_entry__.queries()["build_index"](spark, str(tmp_path))
        rows = index.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert {r.text for r in rows} >= {"First line of words, some more.", "quay stone and wall"} and {(r.full_dim, r.prefix_dim) for r in rows} == {(64, 16)}
    assert {p for r in rows if r.token_count > 10 for p in range(r.first_token, r.last_token)} == set(range(300))
    plan = index._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    summed, looked_up = plan.index("partial_sum"), re.search(r"BroadcastHashJoin \[(cast\()?bank_id", plan).start()
    assert summed < looked_up and "SortMergeJoin" in plan[summed:looked_up]
    assert "Sort [" not in plan[summed:looked_up] and "Exchange" not in plan[summed:looked_up]
    assert "ReusedExchange [document_id" in plan


def test_small_workloads_are_refused(spark):
    rows = spark.range(29)
    with pytest.raises(ValueError):
        inputs.require_rows(rows)
    assert inputs.require_rows(spark.range(30)).count() == 30
    with pytest.raises(ValueError):
        inputs.require_rows(spark.range(40).withColumn("reject_reason", F.when(F.col("id") % 2 == 0, "blank_query")))


def test_snapshots_and_stores_check_themselves(spark):
    path = shared_folder(spark, "t")
    store.snapshot_write({"documents": spark.range(3).toDF("id")}, path, {"split": "validation"})
    assert store.snapshot_read(spark, path, ["documents"], {"split": "validation"})["documents"].count() == 3
    with pytest.raises(ValueError):
        store.snapshot_read(spark, path, ["documents"], {"split": "train"})
    chunks = spark.createDataFrame([("c", "en", [1.0, 0.0], [1.0])], "chunk_id string, language string, full array<float>, prefix array<float>")
    path = shared_folder(spark, "s")
    store.chunk_store_write(chunks, path, {"model": "m"})
    assert store.chunk_store_read(spark, path).count() == 1
    chunks.write.mode("append").partitionBy("language").parquet(f"{path}/chunks")
    with pytest.raises(ValueError):
        store.chunk_store_read(spark, path)


def test_scan_prunes_partitions(spark):
    path = shared_folder(spark, "l")
    corpus.write_by_language(spark.createDataFrame([(1, "en"), (2, "de")], "id int, language string"), path)
    scan = corpus.scan_by_language(spark, path, ["de"])
    assert scan.first().id == 2
    assert "PartitionFilters: [isnotnull(language" in scan._jdf.queryExecution().executedPlan().toString()


def test_validation_file_names(spark):
    paths = {r.language: r.path for r in corpus.expected_files(spark, "validation").collect()}
    assert paths["hi"] == "validation/hinval.parquet" and len(paths) == 14


def test_malformed_rows_are_counted(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "body string")
    r = P.observed_schema(df, "body").first()
    assert (r.observed, r.malformed) == ("OBJECT<a: BIGINT>", 1)


def test_artifacts_and_report(spark):
    path = shared_folder(spark, "a")
    spark.range(10).write.parquet(path)
    sizes = corpus.artifact_sizes(spark, path).collect()
    assert len(sizes) > 0 and all(v > 0 for r in sizes for v in r if isinstance(v, int))


def walk_types(value, path, found):
    kind = {dict: "object", list: "array"}.get(type(value), type(value).__name__)
    found.add((path or "$", kind))
    if kind == "object":
        for key, child in value.items():
            walk_types(child, f"{path}.{key}" if path else key, found)
    if kind == "array":
        for child in [x for x in value if x is not None][:1]:
            walk_types(child, path + "[]", found)


def test_schema_paths_equal_a_plain_walk(spark):
    import json

    texts = [
        '{"a": 1, "b": [null, {"c": "x"}], "d": {"e": {"f": [[1.5, "no"]]}}}', '{"a": "1", "b": [], "d": null, "d.e": 3}', '{"a": 12345678901234567890, "g": 5.0, "h": 100.0}',
        '[null, null, true]', '"only { text"', "null", "7", '{"q": "\\\\\\" [[[[ {"}', '{"a": 1e400000', "", None, "{}", '{"a": -0.001, "g": 1e5}',
    ]
    found = set()
    for text in texts:
        try:
            walk_types(json.loads(text or "?"), "", found)
        except ValueError:
            pass
    df = spark.createDataFrame([(t,) for t in texts], "record string")
    got = P.schema_paths(df, "record").collect()
    assert {(r.path, t) for r in got for t in r.types} == found
    assert all(r.types == sorted(set(r.types)) for r in got)
    assert P.schema_paths(df.limit(0), "record").count() == 0


def test_ratios_are_cut_from_the_texts_once(spark):
    from tessarine.plans.profile_corpus import profile_corpus

    schema = "language string, query string, Answer string, Eng_Query string, Eng_Answer string, passages struct<Translated_passages:array<string>,English_passages:array<string>,is_selected:array<int>>"
    records = spark.createDataFrame([("de", "q", "a", None, None, (["eins zwei", ""], ["one", "two"], [1, 0]))], schema)
    profile = profile_corpus(records)
    ratio = {(r.language, r.metric): r["p50"] for r in profile.filter("metric like '%ratio'").collect()}
    assert ratio == {(x, f"passage_translation_{m}_ratio"): v for x in ("de", None) for m, v in (("character", 3.0), ("word", 2.0))}
    assert "passage_translation_word_ratio" not in profile._jdf.queryExecution().optimizedPlan().toString()


def test_lengths_are_counted_before_percentiles(spark):
    rows = [("de", "m", v) for v in (1, 1, 1, 4, None)] + [("fr", "m", 9)]
    profile = P.profile_lengths(spark.createDataFrame(rows, "language string, metric string, value long"))
    got = {r.language: (r["count"], r["mean"], r["p50"]) for r in profile.collect()}
    assert got == {"de": (4, 1.75, 1.0), "fr": (1, 9.0, 9.0), None: (5, 3.2, 1.0)}
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("count(1)")

"""Sources, projections, text functions, chunking and profile keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.base import CTES, content, query, r6, sents, strip, tok
from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.operators import chunking as C
from tessarine.operators import profile as P
from tessarine.plans.build_index import build_index
from tessarine.plans.profile_corpus import profile_corpus, write_report
from tessarine.session import shared_folder
from tessarine.sources import corpus, inputs, store

docs = X.documents

# Nested records: one per document; lines as translated passages (blank ones included),
# sentences as English ones, labels only where the document has them.


def records(spark, sf):
    labels = X.table(spark, sf, "labels")
    d = docs(spark, sf).join(labels, "doc_id", "left")
    lines = F.split("text", "\n")
    return d.select(
        F.col("lang").alias("language"),
        F.lit("en").alias("source_lang"),
        F.col("lang").alias("target_lang"),
        F.struct(
            F.col("source").alias("model_name"),
            (F.col("quality") / 2).alias("temperature"),
            F.col("n_chars").cast("int").alias("max_tokens"),
            F.lit(1.0).alias("top_p"),
        ).alias("meta"),
        F.concat(F.substring_index("text", ".", 1), F.lit(" ")).alias("query"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("Answer"),
        F.when(F.col("doc_id") % 9 > 0, F.col("doc_id").cast("string")).alias("query_id"),
        F.col("source").alias("query_type"),
        F.struct(
            lines.alias("Translated_passages"),
            T.sentences(F.col("text")).alias("English_passages"),
            F.when(F.col("quality").isNotNull(), F.array("quality", "toxic")).alias("is_selected"),
        ).alias("passages"),
        F.when(F.col("lang") == "en", F.col("source")).alias("Eng_Query"),
        F.lit("").alias("Eng_Answer"),
        F.col("doc_id").alias("record_no"),
    )


CTES["fx_records"] = rf"""
SELECT lang AS language, 'en' AS source_lang, lang AS target_lang, source AS model_name, quality / 2 AS temperature, n_chars AS max_tokens,
  split_part(text, '.', 1) || ' ' AS query, coalesce(string_split(text, chr(10))[2], '') AS answer,
  CASE WHEN d.doc_id % 9 > 0 THEN d.doc_id::VARCHAR END AS query_id, source AS query_type, string_split(text, chr(10)) AS translated,
  {sents("text")} AS english, CASE WHEN quality IS NOT NULL THEN [quality, toxic] ELSE [] END AS selected,
  CASE WHEN lang = 'en' THEN source END AS eng_query, d.doc_id AS record_no
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
CTES["fx_slots"] = """
SELECT language, record_no, query_id, i, translated[i] AS t, english[i] AS e, selected[i] AS s FROM (
  SELECT *, unnest(range(1, 1 + greatest(len(translated), len(english), len(selected)))) AS i FROM fx_records)"""


@query("scan_by_language", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr')")
def scan_by_language(spark, sf):
    path = shared_folder(spark, "by-language")
    corpus.write_by_language(X.table(spark, sf, "documents"), path, "lang")
    return corpus.scan_by_language(spark, path, ["de", "fr"], "lang").select("doc_id", "lang", "source")


@query("head_sample_per_language", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 25")
def head_sample_per_language(spark, sf):
    return corpus.head_sample(X.table(spark, sf, "documents"), 25, "lang", "doc_id").select("doc_id", "lang")


@query(
    "seeded_shuffle_sample",
    """SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang
       ORDER BY md5((2026 + CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END)::VARCHAR || ':' || doc_id)) <= 25""",
)
def seeded_shuffle_sample(spark, sf):
    position = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    return corpus.shuffle_sample(X.table(spark, sf, "documents"), 25, 2026, "lang", "doc_id", position).select("doc_id", "lang")


def _availability(spark, sf):
    known = corpus.expected_files(spark, "validation").select("language", F.col("language").alias("path"))
    extra = spark.createDataFrame([(c, c) for c in ("en", "fr", "de", "es")], "language string, path string")
    manifest = X.table(spark, sf, "documents").groupBy(F.col("lang").alias("path")).agg(F.sum(F.octet_length("text")).alias("size"))
    return corpus.source_availability(known.unionByName(extra), manifest).select("path", "size", "status")


_AVAILABILITY = f"""SELECT e.path, m.size, CASE WHEN m.size IS NULL THEN 'unavailable' ELSE 'ok' END AS status
  FROM (VALUES {", ".join(f"('{c}')" for c in (*V.LANGUAGES, "en", "fr", "de", "es"))}) e(path)
  LEFT JOIN (SELECT lang, sum(strlen(text))::BIGINT AS size FROM documents GROUP BY lang) m ON m.lang = e.path"""


@query("source_availability", _AVAILABILITY)
def source_availability(spark, sf):
    return _availability(spark, sf)


@query("manifest_left_join", f"SELECT status, count(*) AS files, sum(size)::BIGINT AS bytes FROM ({_AVAILABILITY}) GROUP BY status")
def manifest_left_join(spark, sf):
    return _availability(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(
    "scan_query_json",
    rf"""SELECT {strip("id")} AS id, {strip("query")} AS query, lower(language) AS language, id AS query_id, '' AS english_query,
       CASE WHEN query IS NULL THEN 'missing_query' WHEN {strip("query")} = '' THEN 'blank_query' END AS reject_reason
       FROM (SELECT doc_id::VARCHAR AS id, CASE doc_id % 4 WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE text END AS query, upper(lang) AS language FROM documents)""",
)
def scan_query_json(spark, sf):
    v = F.col("doc_id") % 4
    path = shared_folder(spark, "queries")
    X.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.when(v == 1, "  ").when(v != 2, F.col("text")).alias("query"), F.upper("lang").alias("language")
    ).write.json(path)
    return inputs.require_rows(inputs.clean_queries(spark.read.schema(inputs.QUERY_SCHEMA).json(path)))


@query(
    "scan_eval_manifest",
    """SELECT doc_id, CASE v WHEN 0 THEN NULL WHEN 1 THEN 'oracle_missing' WHEN 2 THEN NULL WHEN 3 THEN 'oracle_forbidden' WHEN 4 THEN 'status_unknown'
       WHEN 5 THEN 'unknown_field' WHEN 6 THEN 'refusal_reason_not_allowed' ELSE 'audio_missing' END AS reject_reason,
       CASE WHEN v = 0 THEN doc_id::VARCHAR || '|x' WHEN v = 3 THEN doc_id::VARCHAR ELSE '' END AS chunk_ids FROM (SELECT doc_id, doc_id % 8 AS v FROM documents)""",
)
def scan_eval_manifest(spark, sf):
    v, d = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    q = lambda s: F.lit(s.replace("'", '"'))
    body = (
        F.when(v == 0, F.concat(q("{'audio':'a','expected_chunk_ids':[' "), d, q("','x','"), d, q("']}")))
        .when(v == 1, q("{'audio':'a'}"))
        .when(v == 2, q("{'audio':'a','expected_status':'refused','expected_refusal_reason':'off_topic'}"))
        .when(v == 3, F.concat(q("{'audio':'a','expected_status':'refused','expected_chunk_ids':'"), d, q("'}")))
        .when(v == 4, q("{'audio':'a','expected_status':'maybe'}"))
        .when(v == 5, q("{'audio':'a','sound':'b'}"))
        .when(v == 6, q("{'audio':'a','expected_refusal_reason':'off_topic'}"))
        .otherwise(q("{'audio':' '}"))
    )
    rows = inputs.scan_eval_manifest(X.table(spark, sf, "documents").select("doc_id", body.alias("body")))
    return rows.select("doc_id", "reject_reason", F.array_join("expected_chunk_ids", "|").alias("chunk_ids"))


@query("chunk_store_write", "SELECT chunk_id, language, len(\"full\") AS full_dim, len(prefix) AS prefix_dim, is_selected FROM fx_chunks")
def chunk_store_write(spark, sf):
    path = shared_folder(spark, "store")
    store.chunk_store_write(X.chunks(spark, sf), path, {"model": "given"})
    read = store.chunk_store_read(spark, path)
    return read.select("chunk_id", "language", F.size("full").cast("long").alias("full_dim"), F.size("prefix").cast("long").alias("prefix_dim"), "is_selected")


@query("chunk_store_read", "SELECT language, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM fx_chunks GROUP BY language")
def chunk_store_read(spark, sf):
    path = shared_folder(spark, "store")
    store.chunk_store_write(X.chunks(spark, sf), path)
    return store.chunk_store_read(spark, path).groupBy("language").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("text")).alias("chars"))


@query("source_snapshot", "SELECT doc_id, lang FROM documents")
def source_snapshot(spark, sf):
    path, selection = shared_folder(spark, "snapshot"), {"split": "validation", "languages": "all"}
    store.snapshot_write({"documents": X.table(spark, sf, "documents")}, path, selection)
    return store.snapshot_read(spark, path, ["documents"], selection)["documents"].select("doc_id", "lang")


@query("summary_csv_sink")
def summary_csv_sink(spark, sf):
    path = shared_folder(spark, "report")
    write_report(records(spark, sf), path)
    return spark.read.option("header", True).csv(f"{path}/metrics")


@query("artifact_sizes")
def artifact_sizes(spark, sf):
    path = shared_folder(spark, "store")
    store.chunk_store_write(X.chunks(spark, sf), path)
    return corpus.artifact_sizes(spark, path)


CTES["fx_identified"] = """
SELECT *, language || ':' || qid || CASE WHEN copy > 1 THEN '#' || copy ELSE '' END AS base FROM (
  SELECT *, row_number() OVER (PARTITION BY language, qid ORDER BY record_no) AS copy FROM (
    SELECT *, coalesce(query_id, (row_number() OVER (PARTITION BY language ORDER BY record_no) - 1)::VARCHAR) AS qid FROM fx_records))"""
CTES["fx_passages"] = f"""
SELECT base || ':' || (i - 1) AS id, {strip("t")} AS text, i - 1 AS passage_index, coalesce(s, 0) <> 0 AS is_selected, language
FROM (SELECT *, unnest(range(1, 1 + len(translated))) AS i, unnest(translated) AS t, selected[i] AS s FROM fx_identified) WHERE {strip("t")} <> ''"""


@query("explode_passages", "SELECT id, text, passage_index, is_selected FROM fx_passages")
def explode_passages(spark, sf):
    out = corpus.explode_passages(records(spark, sf), "record_no")
    return out.select("id", "text", F.col("passage_index").cast("long").alias("passage_index"), "is_selected")


@query(
    "project_queries",
    f"SELECT base AS id, qid AS query_id, {strip('query')} AS query, {strip("coalesce(eng_query, '')")} AS english_query FROM fx_identified WHERE {strip('query')} <> ''",
)
def project_queries(spark, sf):
    return corpus.project_queries(records(spark, sf), "record_no").drop("language")


@query("normalize_passage_shape", "SELECT record_no, len(translated) AS translated, len(english) AS english, len(selected) AS selected FROM fx_records")
def normalize_passage_shape(spark, sf):
    """Struct of arrays for even records, array of structs for odd ones."""
    r = records(spark, sf)
    wide = corpus.normalize_passages(r.filter("record_no % 2 = 0"))
    zipped = F.arrays_zip("passages.Translated_passages", "passages.English_passages")
    as_rows = r.filter("record_no % 2 = 1").withColumn("passages", zipped)
    rows = corpus.normalize_passages(as_rows)
    count = lambda c: F.size(c).cast("long").alias(c)
    even = wide.select("record_no", count("translated"), count("english"), count("selected"))
    trimmed = lambda c: F.size(F.filter(c, lambda x: x.isNotNull())).cast("long").alias(c)
    odd = rows.select("record_no", trimmed("translated"), trimmed("english")).join(
        r.select("record_no", F.coalesce(F.size("passages.is_selected"), F.lit(0)).cast("long").alias("selected")), "record_no"
    )
    return even.unionByName(odd)


@query("validate_chunk_offsets", "SELECT NULL::VARCHAR AS problem, count(*) AS chunks FROM fx_naive", )
def validate_chunk_offsets(spark, sf):
    d = docs(spark, sf)
    return C.offset_problems(C.naive_chunks(d), d).groupBy("problem").agg(F.count(F.lit(1)).alias("chunks"))


@query("redact_literals", r"""SELECT doc_id, replace(replace(text, 'the', '[REDACTED]'), 'ation', '[REDACTED]') AS redacted FROM documents""")
def redact_literals(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.redact(F.col("text"), ["the", "", "ation"]).alias("redacted"))


@query("union_languages", "SELECT lang, count(*) AS documents FROM documents GROUP BY lang")
def union_languages(spark, sf):
    d = X.table(spark, sf, "documents")
    parts = [d.filter(F.col("lang") == c).select("doc_id", "lang") for c in ("de", "en", "es", "fr")]
    return corpus.union_languages(parts).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))


@query("distinct_texts", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def distinct_texts(spark, sf):
    return corpus.distinct_texts(X.table(spark, sf, "documents").select("text", "doc_id", "lang"), "text", "doc_id").drop("text")


@query("document_cap", "SELECT doc_id FROM documents ORDER BY lang, doc_id LIMIT 300")
def document_cap(spark, sf):
    return corpus.document_cap(X.table(spark, sf, "documents"), 300, ["lang", "doc_id"]).select("doc_id")


# Text functions ------------------------------------------------------------------


def _text(spark, sf, *columns):
    return docs(spark, sf).select("doc_id", *columns)


@query("lexical_tokens", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def lexical_tokens(spark, sf):
    t = F.col("t")
    return _text(spark, sf, T.lexical_tokens(F.col("text")).alias("t")).select(
        "doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest")
    )


@query(
    "content_tokens",
    f"SELECT doc_id, len({content('t', V.ENGLISH_FUNCTION_WORDS)}) AS english, len({content('t', V.SELECTION_FUNCTION_WORDS)}) AS multilingual FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
)
def content_tokens(spark, sf):
    return _text(spark, sf, T.lexical_tokens(F.col("text")).alias("t")).select(
        "doc_id",
        F.size(T.drop_function_words(F.col("t"), V.ENGLISH_FUNCTION_WORDS)).cast("long").alias("english"),
        F.size(T.drop_function_words(F.col("t"), V.SELECTION_FUNCTION_WORDS)).cast("long").alias("multilingual"),
    )


@query("fold_unicode", "SELECT doc_id, md5(replace(lower(text), 'ß', 'ss')) AS digest FROM documents")
def fold_unicode(spark, sf):
    return _text(spark, sf, F.md5(T.fold(F.col("text")).cast("binary")).alias("digest"))


@query("sentences", f"SELECT doc_id, i AS sentence_index, s[i + 1] AS sentence FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, {sents('text')} AS s FROM documents))")
def sentences(spark, sf):
    return _text(spark, sf, F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence")).select(
        "doc_id", F.col("i").cast("long").alias("sentence_index"), "sentence"
    )


CTES["fx_normal"] = r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM documents"""


@query("normalize_transcript", "SELECT doc_id, normal FROM fx_normal")
def normalize_transcript(spark, sf):
    return _text(spark, sf, T.normalize_transcript(F.col("text")).alias("normal"))


@query("normalize_answer", r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS normal FROM documents")
def normalize_answer(spark, sf):
    return _text(spark, sf, T.normalize_answer(F.col("text")).alias("normal"))


@query("control_chars", r"SELECT page_id, regexp_matches(html, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') AS found FROM pages")
def control_chars(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.has_control_characters(F.col("html")).alias("found"))


@query(
    "trimmed_offsets",
    f"""SELECT doc_id, 7 + length(raw) - length(ltrim(raw, ' ' || chr(10))) AS start_char, 7 + length(rtrim(raw, ' ' || chr(10))) AS end_char, {strip("raw")} AS text
        FROM (SELECT doc_id, '  ' || chr(10) || text || ' ' AS raw FROM documents)""",
)
def trimmed_offsets(spark, sf):
    raw = F.concat(F.lit("  \n"), "text", F.lit(" "))
    return _text(spark, sf, T.trimmed_offsets(raw, F.lit(7)).alias("o")).select(
        "doc_id", F.col("o.start_char").cast("long").alias("start_char"), F.col("o.end_char").cast("long").alias("end_char"), "o.text"
    )


@query("text_lengths", r"SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\S+')) AS words, strlen(text) AS bytes FROM documents")
def text_lengths(spark, sf):
    t = F.col("text")
    return _text(spark, sf, *[c.cast("long").alias(n) for n, c in (("chars", F.char_length(t)), ("words", T.word_count(t)), ("bytes", F.octet_length(t)))])


@query("missing_key", "SELECT doc_id, coalesce(nullif(replace(source, 'src0', ''), ''), '<missing>') AS key, CASE WHEN quality IS NULL THEN '<missing>' WHEN quality = 0 THEN '0' ELSE '0.5' END AS ratio FROM documents LEFT JOIN labels USING (doc_id)")
def missing_key(spark, sf):
    d = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", T.missing_key(F.replace("source", F.lit("src0"), F.lit(""))).alias("key"), T.missing_float_key(F.col("quality") / 2).alias("ratio"))


@query("has_digit_token", f"SELECT doc_id, len(list_filter({tok('text')}, lambda t: regexp_matches(t, '[\\p{{Nd}}²³¹]'))) > 0 AS digits FROM documents")
def has_digit_token(spark, sf):
    from tessarine.operators.answers import has_digit_token as check

    return _text(spark, sf, check(T.lexical_tokens(F.col("text"))).alias("digits"))


@query("metadata_merge", "SELECT doc_id, 'late' AS strategy, lang AS language FROM documents")
def metadata_merge(spark, sf):
    base = F.create_map(F.lit("language"), F.col("lang"), F.lit("strategy"), F.lit("none"))
    own = F.create_map(F.lit("strategy"), F.lit("late"), F.lit("source"), F.col("source"))
    return _text(spark, sf, C.merge_metadata(base, own).alias("m")).select("doc_id", F.col("m")["strategy"].alias("strategy"), F.col("m")["language"].alias("language"))


@query("content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf):
    return _text(spark, sf, F.sha2("text", 256).alias("digest"))


# Chunking -------------------------------------------------------------------------

_B = r"(?:\n\s*\n|[.!?;:।॥]\s+|\n|,\s+)"
CTES["fx_walk"] = rf"""/*recursive*/
SELECT doc_id, text, length(text) AS len, 0 AS start, -1 AS stop, 0 AS k FROM documents WHERE length(text) > 0
UNION ALL
SELECT doc_id, text, len, CASE WHEN stop = len THEN -1 ELSE greatest(start + 1, stop - 100) END, stop, k + 1 FROM (
  SELECT doc_id, text, len, s AS start, CASE WHEN hard < len AND found > 0 THEN s + 300 + found ELSE hard END AS stop, k FROM (
    SELECT *, list_sum(list_transform(regexp_extract_all(substring(text, s + 301, hard - s - 300), '(?s).*?{_B}'), lambda p: length(p)))::BIGINT AS found
    FROM (SELECT *, start AS s, least(start + 600, len) AS hard FROM fx_walk WHERE start >= 0)))"""
CTES["fx_naive_raw"] = """
SELECT doc_id, k, prev AS start, stop, substring(text, prev + 1, stop - prev) AS raw FROM (
  SELECT *, lag(start) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM fx_walk) WHERE k > 0"""
CTES["fx_naive"] = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, start + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start_char,
  start + length(regexp_replace(raw, '\\s+$', '')) AS end_char, {strip("raw")} AS text FROM fx_naive_raw WHERE {strip("raw")} <> ''"""


def _doc_id(column="document_id"):
    return F.split_part(column, F.lit(":"), F.lit(2)).cast("long").alias("doc_id")


@query("naive_chunks", "SELECT doc_id, chunk_index, start_char, end_char, text FROM fx_naive")
def naive_chunks(spark, sf):
    longs = [F.col(c).cast("long").alias(c) for c in ("chunk_index", "start_char", "end_char")]
    return C.naive_chunks(docs(spark, sf)).select(_doc_id(), *longs, "text")


@query("chunk_numbering", "SELECT doc_id, count(*) AS chunks, max(chunk_index) AS last FROM fx_naive GROUP BY doc_id")
def chunk_numbering(spark, sf):
    return C.naive_chunks(docs(spark, sf)).groupBy(_doc_id()).agg(
        F.count(F.lit(1)).alias("chunks"), F.max("chunk_index").cast("long").alias("last")
    )


# Token walk: the SQL holds token offsets as lists; windows of 500 tokens.
CTES["fx_token_ends"] = r"""
SELECT doc_id, text, n, list(e::BIGINT ORDER BY i) AS ends, list((e - w)::BIGINT ORDER BY i) AS starts FROM (
  SELECT doc_id, text, n, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(regexp_replace(p, '^\s+', '')) AS w FROM (
    SELECT doc_id, text, len(pieces) AS n, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS p FROM (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+') AS pieces FROM documents)))
GROUP BY doc_id, text, n"""
CTES["fx_twalk"] = rf"""/*recursive*/
SELECT doc_id, text, starts, ends, w, least((w + 1) * 500, n)::BIGINT AS fin, (w * 500)::BIGINT AS s, -1::BIGINT AS stop, 0 AS k FROM (SELECT *, unnest(range((n + 499) // 500)) AS w FROM fx_token_ends)
UNION ALL
SELECT doc_id, text, starts, ends, w, fin, CASE WHEN stop = fin THEN -1 ELSE greatest(s + 1, stop - 32) END, stop, k + 1 FROM (
  SELECT *, CASE WHEN hard < fin AND found > 0 AND inside > 0 THEN s + 96 + inside ELSE hard END AS stop FROM (
    SELECT *, len(list_filter(ends[s + 97:hard], lambda e: e <= c0 + found)) AS inside FROM (
      SELECT *, list_sum(list_transform(regexp_extract_all(substring(text, c0 + 1, ends[hard] - c0), '(?s).*?{_B}'), lambda p: length(p)))::BIGINT AS found FROM (
        SELECT *, starts[least(s + 97, hard)]::BIGINT AS c0 FROM (SELECT * EXCLUDE (stop), least(s + 192, fin) AS hard FROM fx_twalk WHERE s >= 0)))))"""
CTES["fx_tspans"] = """
SELECT doc_id, w, k, first_token, stop AS last_token, starts[first_token + 1] AS start_char, ends[stop] AS end_char, substring(text, starts[first_token + 1]::BIGINT + 1, (ends[stop] - starts[first_token + 1])::BIGINT) AS text
FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id, w ORDER BY k) AS first_token FROM fx_twalk) WHERE k > 0"""
CTES["fx_late"] = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY w, k) - 1 AS chunk_index, first_token, last_token, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char, text FROM fx_tspans"""


def late(spark, sf):
    return C.token_chunks(docs(spark, sf), window_tokens=500)


@query("token_chunk_spans", "SELECT doc_id, chunk_index, first_token, last_token, start_char, end_char, text FROM fx_late")
def token_chunk_spans(spark, sf):
    longs = [F.col(c).cast("long").alias(c) for c in ("chunk_index", "first_token", "last_token", "start_char", "end_char")]
    return late(spark, sf).select(_doc_id(), *longs, "text")


@query(
    "document_windows",
    "SELECT doc_id, w AS window_index, w * 500 AS token_offset, least(500, n - w * 500) AS window_tokens FROM (SELECT doc_id, n, unnest(range((n + 499) // 500)) AS w FROM fx_token_ends)",
)
def document_windows(spark, sf):
    return C.document_windows(docs(spark, sf), 500).select(
        _doc_id(), *[F.col(c).cast("long").alias(c) for c in ("window_index", "token_offset", "window_tokens")]
    )


# The whole embeddings table as token streams, one per label.
CTES["fx_tokens"] = "SELECT label AS doc, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding AS v FROM embeddings"
CTES["fx_fixed"] = """
SELECT doc, span, span * 6 AS first_token, least(span * 6 + 8, n) AS last_token FROM (SELECT doc, n, unnest(range(greatest(0, ceil((n - 2) / 6)::BIGINT - 1) + 1)) AS span FROM (SELECT doc, count(*) AS n FROM fx_tokens GROUP BY doc))"""


def token_vectors(spark, sf):
    from tessarine.operators.ordered import numbered

    e = X.table(spark, sf, "embeddings").withColumn("document_id", F.col("label").cast("string"))
    return numbered(e, ["document_id"], "vec_id", "pos").select("document_id", "pos", F.col("embedding").alias("vector"), "vec_id")


@query(
    "late_pool",
    """SELECT doc::VARCHAR AS document_id, span, token_count, round(m[1] / norm, 5) AS first, round(m[2] / norm, 5) AS last FROM (
       SELECT doc, span, any_value(c) AS token_count, list(m ORDER BY d) FILTER (d IN (1, 64)) AS m, sqrt(sum(m * m)) AS norm FROM (
         SELECT s.doc, span, d, avg(v[d]::DOUBLE) AS m, count(*) AS c FROM (SELECT *, unnest(range(1, 65)) AS d FROM fx_tokens) t JOIN fx_fixed s ON s.doc = t.doc AND t.pos >= first_token AND t.pos < last_token GROUP BY s.doc, span, d)
       GROUP BY doc, span)""",
)
def late_pool(spark, sf):
    tokens = token_vectors(spark, sf)
    spans = C.fixed_spans(tokens.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("n")), 8, 2)
    return C.late_pool(tokens, spans).select(
        "document_id", F.col("span").cast("long").alias("span"), "token_count",
        F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.round(F.col("vector")[63].cast("double"), 5).alias("last"),
    )


@query(
    "mean_pool_masked",
    """SELECT doc::VARCHAR AS document_id, round(m[1] / greatest(norm, 1e-12), 5) AS first, round(m[2] / greatest(norm, 1e-12), 5) AS last FROM (
       SELECT doc, list(m ORDER BY d) FILTER (d IN (1, 64)) AS m, sqrt(sum(m * m)) AS norm FROM (
         SELECT doc, d, sum(v[d]::DOUBLE * mask) / greatest(sum(mask), 1) AS m FROM (SELECT *, unnest(range(1, 65)) AS d, CASE WHEN pos % 3 > 0 THEN 1 ELSE 0 END AS mask FROM fx_tokens) GROUP BY doc, d) GROUP BY doc)""",
)
def mean_pool_masked(spark, sf):
    tokens = token_vectors(spark, sf).withColumn("mask", F.when(F.col("pos") % 3 > 0, 1).otherwise(0))
    return C.mean_pool_masked(tokens).select(
        "document_id", F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.round(F.col("vector")[63].cast("double"), 5).alias("last")
    )


@query(
    "chunk_stats",
    """SELECT count(*) AS chunks, round(avg(last_token - first_token), 6) AS mean_tokens, min(last_token - first_token) AS min_tokens, max(last_token - first_token) AS max_tokens FROM fx_late""",
)
def chunk_stats(spark, sf):
    longs = {c: F.col(c).cast("long") for c in ("min_tokens", "max_tokens")}
    return C.chunk_stats(late(spark, sf)).withColumns(longs).withColumn("mean_tokens", r6("mean_tokens"))


@query(
    "chunking_comparison",
    r"""SELECT strategy, count(*) AS chunks, round(avg(length(text)), 6) AS mean_chars, round(avg(n), 6) AS mean_tokens FROM (
        SELECT 'late' AS strategy, text, last_token - first_token AS n FROM fx_late_whole UNION ALL SELECT 'naive', text, len(regexp_extract_all(text, '\S+')) FROM fx_naive) GROUP BY strategy""",
)
def chunking_comparison(spark, sf):
    return C.chunking_comparison(docs(spark, sf)).withColumns({c: r6(c) for c in ("mean_chars", "mean_tokens")})


for _name, _body in list(CTES.items()):
    if _name in ("fx_twalk", "fx_tspans", "fx_late"):
        CTES[_name + "_whole"] = _body.replace("500", "8190").replace("499", "8189").replace("fx_twalk", "fx_twalk_whole").replace("fx_tspans", "fx_tspans_whole")


# Passages in place of documents, under the same token walk with whole windows.
CTES["fx_index_docs"] = "SELECT id AS doc_id, text, language FROM fx_passages"
for _name in ("fx_token_ends", "fx_twalk_whole", "fx_tspans_whole", "fx_late_whole"):
    _body = CTES[_name].replace("FROM documents", "FROM fx_index_docs")
    for _other in ("fx_token_ends", "fx_twalk_whole", "fx_tspans_whole"):
        _body = _body.replace(_other, _other.replace("fx_", "fx_index_"))
    CTES[_name.replace("fx_", "fx_index_")] = _body


@query(
    "build_index",
    """SELECT l.doc_id || ':late:' || chunk_index AS chunk_id, d.language, last_token - first_token AS token_count, 64 AS full_dim, 16 AS prefix_dim,
        first_token, last_token, l.text FROM fx_index_late_whole l JOIN fx_index_docs d ON d.doc_id = l.doc_id""",
)
def build_index_rows(spark, sf):
    """Every passage of every record cut, pooled and normalised; token vectors are dealt from the embeddings."""
    r = records(spark, sf)
    bank = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("bank_id"), F.col("embedding").alias("vector"))
    n = bank.count()
    lines = corpus.explode_passages(r, "record_no").select(F.col("id").alias("document_id"), "text")
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    ids = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int" if n < 1 << 31 else "long"))
    dealt = C.by_window(lines.select("document_id", ids.alias("bank_id")), "bank_id")
    # The bank is looked up like a vocabulary's table: words stay where they are pooled, up to 1,000,000 vectors of it.
    tokens = dealt.join(F.broadcast(bank) if n <= 1_000_000 else bank, "bank_id").drop("bank_id")
    index = build_index(r, tokens, prefix_dim=16, full_dim=64)
    longs = [F.col(c).cast("long").alias(c) for c in ("token_count", "first_token", "last_token")]
    return index.select("chunk_id", "language", "text", F.size("full").alias("full_dim"), F.size("prefix").alias("prefix_dim"), *longs)


# Profile --------------------------------------------------------------------------

_PCT = "[" + ",".join(str(p / 100) for p in V.SUMMARY_PERCENTILES) + "]"
_PCT_COLS = ", ".join(f"round(q[{i + 1}], 6) AS p{p}" for i, p in enumerate(V.SUMMARY_PERCENTILES))


def _sizes(prefix, expr):
    return (
        f"SELECT language, unnest(['{prefix}_characters', '{prefix}_whitespace_words', '{prefix}_utf8_bytes', '{prefix}_tokens']) AS metric, "
        f"unnest([length(x), len(regexp_extract_all(x, '\\S+')), strlen(x), len(regexp_extract_all(x, '\\S+'))]) AS value FROM ({expr}) WHERE x <> ''"
    )


CTES["fx_measures"] = " UNION ALL ".join(
    [
        _sizes("translated_query", "SELECT language, query AS x FROM fx_records"),
        _sizes("english_query", "SELECT language, eng_query AS x FROM fx_records"),
        _sizes("translated_answer", "SELECT language, answer AS x FROM fx_records"),
        _sizes("translated_passage", "SELECT language, t AS x FROM fx_slots"),
        _sizes("english_passage", "SELECT language, e AS x FROM fx_slots"),
        "SELECT language, 'passages_per_record', max(i) FROM fx_slots GROUP BY language, record_no",
    ]
)
CTES["fx_ratios"] = r"""
SELECT language, unnest(['passage_translation_character_ratio', 'passage_translation_word_ratio']) AS metric,
  unnest([length(t) / length(e), CASE WHEN len(regexp_extract_all(e, '\S+')) > 0 THEN len(regexp_extract_all(t, '\S+')) / len(regexp_extract_all(e, '\S+')) END]) AS value
FROM fx_slots WHERE t <> '' AND e <> ''"""


def _summary(source, keys):
    return f"SELECT {keys}, count, mean, {_PCT_COLS} FROM (SELECT {keys}, count(value) AS count, round(avg(value), 6) AS mean, quantile_cont(value, {_PCT}) AS q FROM {source} WHERE value IS NOT NULL GROUP BY {keys})"


def _rounded(df):
    return df.withColumns({c: r6(c) for c in ("mean", *[f"p{p}" for p in V.SUMMARY_PERCENTILES])})


@query("numeric_summary", _summary("(SELECT event_type, value FROM events)", "event_type"))
def numeric_summary(spark, sf):
    return _rounded(P.numeric_summary(X.table(spark, sf, "events"), ["event_type"], "value"))


@query("exact_percentile", "SELECT l_returnflag, count(*) AS count, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.995), 6) AS p99_5, max(l_extendedprice) AS p100 FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem) GROUP BY l_returnflag")
def exact_percentile(spark, sf):
    from tessarine.operators.ordered import exact_quantiles

    q = exact_quantiles(X.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", (50, 99.5, 100))
    return q.select("l_returnflag", "count", F.round("mean", 4).alias("mean"), r6("p50").alias("p50"), r6(F.col("`p99.5`")).alias("p99_5"), "p100")


@query("length_metrics", "SELECT language, metric, count(*) AS n, sum(value)::BIGINT AS total FROM fx_measures GROUP BY language, metric")
def length_metrics(spark, sf):
    return P.length_metrics(records(spark, sf)).groupBy("language", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


_BY_LANGUAGE = _summary("fx_measures", "language, metric")
_OVERALL = _summary("fx_measures", "metric").replace("SELECT metric, count, mean", "SELECT NULL AS language, metric, count, mean", 1)


@query("profile_by_language", f"{_BY_LANGUAGE} UNION ALL {_OVERALL}")
def profile_by_language(spark, sf):
    return _rounded(P.profile_lengths(P.length_metrics(records(spark, sf))))


@query("translation_ratios", _summary("fx_ratios", "language, metric"))
def translation_ratios(spark, sf):
    return _rounded(P.numeric_summary(P.translation_ratios(records(spark, sf)), ["language", "metric"], "value"))


@query(
    "profile_corpus",
    f"{_BY_LANGUAGE} UNION ALL {_OVERALL} UNION ALL {_summary('fx_ratios', 'language, metric')} UNION ALL "
    + _summary("fx_ratios", "metric").replace("SELECT metric, count, mean", "SELECT NULL AS language, metric, count, mean", 1),
)
def profile_corpus_rows(spark, sf):
    return _rounded(profile_corpus(records(spark, sf)))


CTES["fx_categories"] = """
SELECT language, field, value, count(*) AS n FROM (
  SELECT language, unnest(['meta.model_name', 'meta.temperature', 'meta.max_tokens', 'meta.top_p', 'source_lang', 'target_lang', 'query_type']) AS field,
    unnest([model_name, CASE WHEN temperature IS NULL THEN '<missing>' WHEN temperature = 0 THEN '0' ELSE '0.5' END, max_tokens::VARCHAR, '1', source_lang, target_lang, query_type]) AS value FROM fx_records
  UNION ALL SELECT language, 'is_selected', coalesce(s::VARCHAR, '<missing>') FROM fx_slots) GROUP BY ALL"""


@query("categorical_counts", "SELECT * FROM fx_categories")
def categorical_counts(spark, sf):
    return P.categorical_counts(records(spark, sf))


@query("top_categories", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language, field ORDER BY n DESC, value) AS place FROM fx_categories) WHERE place <= 20")
def top_categories(spark, sf):
    return P.top_categories(P.categorical_counts(records(spark, sf)), ["language"])


@query(
    "field_coverage",
    """SELECT language, field, present, records, round(present / records, 6) AS rate FROM (
       SELECT language, count(*) AS records, unnest(['source_lang', 'target_lang', 'meta', 'query', 'Answer', 'query_id', 'query_type', 'passages', 'Eng_Query', 'Eng_Answer', 'meta.model_name', 'meta.temperature', 'meta.max_tokens', 'meta.top_p']) AS field,
         unnest([count(*), count(*), count(*), count_if(query <> ''), count_if(answer <> ''), count(query_id), count(*), count(*), count_if(coalesce(eng_query, '') <> ''), 0, count_if(model_name <> ''), count(temperature), count(max_tokens), count(*)]) AS present FROM fx_records GROUP BY language)""",
)
def field_coverage(spark, sf):
    return P.field_coverage(records(spark, sf)).withColumn("rate", r6("rate"))


@query(
    "passage_quality",
    f"""SELECT language, records, coalesce(records_without_passages, 0) AS records_without_passages, records_with_mismatched_passage_arrays, s.* EXCLUDE (language) FROM (
        SELECT language, count(*) AS records, count_if(greatest(len(translated), len(english), len(selected)) = 0) AS records_without_passages,
          count_if(len(translated) <> len(english) OR len(english) <> len(selected)) AS records_with_mismatched_passage_arrays FROM fx_records GROUP BY language) r
        JOIN (SELECT language, count(*) AS passage_slots, count_if(t <> '') AS nonempty_translated_passages, count(*) - count_if(t <> '') AS empty_or_missing_translated_passages,
          count_if(e <> '') AS nonempty_english_passages, count(*) - count_if(e <> '') AS empty_or_missing_english_passages, count_if(t <> '' AND e <> '') AS paired_nonempty_passages,
          count_if(t <> '' AND e <> '' AND {strip("t")} = {strip("e")}) AS translated_passages_equal_to_english, count_if(s = 1) AS selected_passages, 0::BIGINT AS invalid_is_selected_labels FROM fx_slots GROUP BY language) s USING (language)""",
)
def passage_quality(spark, sf):
    return P.passage_quality(records(spark, sf))


@query("duplicate_ids", "SELECT lang AS language, (count(*) - count(DISTINCT source))::BIGINT AS duplicates FROM documents GROUP BY lang")
def duplicate_ids(spark, sf):
    d = X.table(spark, sf, "documents").withColumnRenamed("lang", "language")
    return P.duplicate_ids(d, key="source")


@query(
    "language_mix",
    "SELECT lang AS language, count(*) AS records, 1::BIGINT AS target_values, sum(strlen(text))::BIGINT AS size, round(sum(strlen(text)) / (SELECT sum(strlen(text)) FROM documents), 6) AS byte_share FROM documents GROUP BY lang",
)
def language_mix(spark, sf):
    sizes = X.table(spark, sf, "documents").groupBy(F.col("lang").alias("language")).agg(F.sum(F.octet_length("text")).alias("size"))
    return P.language_mix(records(spark, sf), sizes).withColumn("byte_share", r6("byte_share"))


@query("observed_schema", "SELECT DISTINCT event_type, 'OBJECT<k: ' || json_type(props, '$.k').replace('UBIGINT', 'BIGINT') || '>' AS observed, count(*) AS malformed FROM events GROUP BY ALL")
def observed_schema(spark, sf):
    """Every event once as it is and once with its body cut short."""
    events = X.table(spark, sf, "events").select("event_type", "props")
    broken = events.select("event_type", F.concat(F.lit("{"), "props").alias("props"))
    return P.observed_schema(events.unionAll(broken), "props", ["event_type"])


CTES["fx_records"] = """
SELECT event_type, CASE WHEN event_id % 11 = 0 THEN '[' || event_id || ', "x"]' WHEN event_id % 97 = 0 THEN '{"cut' ELSE concat('{"id":', event_id, ',"at.day":null,"tags":[null,',
  CASE event_id % 4 WHEN 0 THEN '"a {\\" [[["' WHEN 1 THEN '1.5' WHEN 2 THEN 'true' ELSE 'null' END, '],"body":', props, ',"deep":{"lists":[[{"v":', CASE WHEN event_id % 5 = 0 THEN '1e3' ELSE '{}' END, '}]],"x y":7}}') END AS record FROM events"""

CTES["fx_walk"] = """/*recursive*/
SELECT event_type, '' AS path, record::JSON AS j FROM fx_records WHERE json_valid(record)
UNION ALL
SELECT event_type, u.p, u.v FROM (SELECT event_type, unnest(CASE json_type(j)
  WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: {'p': CASE WHEN path = '' THEN k ELSE path || '.' || k END, 'v': json_extract(j, '$."' || k || '"')})
  WHEN 'ARRAY' THEN list_transform(list_filter(json_extract(j, '$[*]'), lambda v: json_type(v) <> 'NULL')[1:1], lambda v: {'p': path || '[]', 'v': v}) END) AS u FROM fx_walk)"""


def record_texts(events):
    n = F.col("event_id")
    tag = F.when(n % 4 == 0, '"a {\\" [[["').when(n % 4 == 1, "1.5").when(n % 4 == 2, "true").otherwise("null")
    v = F.when(n % 5 == 0, "1e3").otherwise("{}")
    whole = F.concat(
        F.lit('{"id":'), n, F.lit(',"at.day":null,"tags":[null,'), tag, F.lit('],"body":'), "props", F.lit(',"deep":{"lists":[[{"v":'), v, F.lit('}]],"x y":7}}')
    )
    record = F.when(n % 11 == 0, F.concat(F.lit("["), n, F.lit(', "x"]'))).when(n % 97 == 0, '{"cut').otherwise(whole)
    return events.select("event_type", record.alias("record"))


@query(
    "schema_paths",
    """SELECT event_type, CASE WHEN path = '' THEN '$' ELSE path END AS path, list_sort(list_distinct(list(CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'str'
      WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END))) AS types FROM fx_walk GROUP BY ALL""",
)
def schema_paths(spark, sf):
    """Events as records with lists, nested members, a list as root and rows that are not JSON."""
    return P.schema_paths(record_texts(X.table(spark, sf, "events")), "record", ["event_type"])

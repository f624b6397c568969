"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.llm import conversations, counts, decontaminate, divergence, embedding, language, lines, lm, merkle, mixing, quality, simhash, token_files
from tessarine.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id")


def byte_bpe() -> str:
    """The 50k byte-level vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_ids(table(spark, sf, "documents"), path, byte_bpe())
    return token_files.read_token_ids(spark, path, with_ids=False)


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, '')) AS draw, md5(concat(coalesce(doc_id::VARCHAR, chr(0)), ':', coalesce(text, chr(0)))) AS row_id
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS stop,
    ceil(n / greatest(384, ceil(sum(n) OVER () / 65536.0)))::BIGINT AS shards FROM by_source),
levels AS (
  SELECT *, stop / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(stop) OVER (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
targets AS (
  SELECT *, CASE WHEN ratio <= level THEN stop ELSE weight * (SELECT arg_min(level, ratio) FROM levels WHERE ratio > level) END AS target FROM levels),
seats AS (
  SELECT *, round(sum(target) OVER ())::BIGINT AS seats, target / sum(target) OVER () * round(sum(target) OVER ()) AS fair,
    least(greatest(floor(target / (shards * 128)), 1), 64)::BIGINT AS block FROM targets),
quotients AS (
  SELECT source, target / (2 * k + 1) AS quotient, k, seats FROM (
    SELECT *, unnest(range(greatest(0, floor(fair) - 30)::BIGINT, ceil(fair)::BIGINT + 30)) AS k FROM seats WHERE target > 0)),
source_low AS (SELECT source, min(k) AS low FROM quotients GROUP BY source),
won AS (
  SELECT source, count(*) AS won FROM (
    SELECT *, row_number() OVER (ORDER BY quotient DESC, source IS NULL, source, k) AS turn FROM quotients)
  WHERE turn <= seats - (SELECT sum(low) FROM source_low) GROUP BY source),
quotas AS (SELECT l.source, low + coalesce(won, 0) AS words FROM source_low l LEFT JOIN won w ON l.source IS NOT DISTINCT FROM w.source),
placed AS (
  SELECT d.*, t.source_size, t.target, coalesce(q.words, 0) AS words, t.block, ('0x' || substr(draw, 1, 8))::BIGINT % t.shards AS shard
  FROM sized d JOIN seats t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
shards AS (
  SELECT *, round(words::DOUBLE / source_size * sum(blocks) OVER (PARTITION BY source))::BIGINT AS quota,
    blocks / sum(blocks) OVER (PARTITION BY source) AS part FROM (
    SELECT source, shard, max(block) AS block, max(words) AS words, max(source_size) AS source_size, ceil(sum(size) / max(block))::BIGINT AS blocks
    FROM placed GROUP BY source, shard HAVING sum(size) > 0)),
shard_quotients AS (
  SELECT source, shard, quota, blocks / (2 * k + 1) AS quotient, k FROM (
    SELECT *, unnest(range(greatest(0, floor(part * quota) - 30)::BIGINT, ceil(part * quota)::BIGINT + 30)) AS k FROM shards)),
shard_low AS (
  SELECT source, shard, min(k) AS low FROM shard_quotients GROUP BY source, shard),
shard_open AS (
  SELECT source, sum(low) AS given FROM shard_low GROUP BY source),
shard_won AS (
  SELECT source, shard, count(*) AS won FROM (
    SELECT q.*, row_number() OVER (PARTITION BY q.source ORDER BY quotient DESC, shard, k) AS turn, given
    FROM shard_quotients q JOIN shard_open o ON q.source IS NOT DISTINCT FROM o.source) WHERE turn <= quota - given GROUP BY source, shard),
shard_quotas AS (
  SELECT s.*, least(low + coalesce(won, 0), 2 * blocks)::BIGINT AS given
  FROM shards s JOIN shard_low l ON s.source IS NOT DISTINCT FROM l.source AND s.shard = l.shard
  LEFT JOIN shard_won w ON s.source IS NOT DISTINCT FROM w.source AND s.shard = w.shard),
laid AS (
  SELECT p.*, sum(size) OVER (PARTITION BY source, shard ORDER BY draw, doc_id NULLS FIRST, size, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS b FROM placed p),
spread AS (
  SELECT l.*, b - size AS a, blocks, given // blocks AS passes, given % blocks AS once,
    ('0x' || substr(md5('7:' || coalesce(l.source, '') || ':' || l.shard), 1, 8))::BIGINT % blocks AS shift
  FROM laid l LEFT JOIN shard_quotas q ON l.source IS NOT DISTINCT FROM q.source AND l.shard = q.shard)
SELECT doc_id, size, source_size, target, (coalesce(passes, 0) * size + coalesce(list_sum(list_transform(
    list_filter(range(a // block, CASE WHEN size > 0 THEN (b - 1) // block + 1 ELSE a // block END),
      lambda j: ((j + 1) * once + shift) // blocks > (j * once + shift) // blocks),
    lambda j: least((j + 1) * block, b) - greatest(j * block, a))), 0))::BIGINT AS taken FROM spread
"""


@query("op4_mixing", MIX_SQL)
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


VECTOR_SQL = """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (
  SELECT * FROM rows WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (SELECT r AS a, r AS b FROM rows UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
named AS (SELECT a, min(vec_id) AS component_id FROM reached JOIN rows ON reached.b = rows.r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = rows.r) AS n_links, component_id,
  vec_id IS NOT DISTINCT FROM component_id AS kept FROM rows JOIN named ON named.a = rows.r
"""


@query("op5_embedding", VECTOR_SQL)
def op5_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.embedding_groups(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))


@query("op10_language")
def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    found = language.identify_held_out(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")


@query("op9_language_model")
def op9_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return lm.language_model_scores(table(spark, sf, "documents").select("doc_id", "text"))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    scores = counts.unigram_scores(public_tokenizers.path("piece_bpe_32k.model"))
    return counts.token_counts(table(spark, sf, "documents").select("doc_id", "text"), scores)


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf, "benchmark"))


LINES_SQL = """
WITH every AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
full_lines AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS s
  FROM every WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
windows AS (
  SELECT a.doc_id, a.s, a.line AS one, b.line AS two FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.s = a.s + 1),
later AS (
  SELECT doc_id, s FROM (
    SELECT *, row_number() OVER (PARTITION BY one, two ORDER BY doc_id, s) AS turn FROM windows) WHERE turn > 1),
later_long AS (
  SELECT doc_id, s FROM (
    SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, s) AS turn FROM full_lines
    WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50) WHERE turn > 1),
gone AS (SELECT doc_id, s + k AS s FROM later, (VALUES (0), (1)) AS v(k) UNION SELECT doc_id, s FROM later_long),
gone_at AS (SELECT f.doc_id, f.pos FROM full_lines f JOIN gone g ON f.doc_id = g.doc_id AND f.s = g.s)
SELECT e.doc_id, (SELECT count(*) FROM full_lines f WHERE f.doc_id = e.doc_id)::INTEGER AS lines,
  count(g.pos)::INTEGER AS deleted, md5(coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY e.pos), '')) AS text_md5
FROM every e LEFT JOIN gone_at g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
"""


@query("op2_lines", LINES_SQL)
def op2_lines(spark: SparkSession, sf: str) -> DataFrame:
    cut = lines.drop_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "lines", "deleted", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf, "documents").select("doc_id", "text"))


@query("op13_conversations")
def op13_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf, "conversations")))


MERKLE_SQL = """
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS r, doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS crc
  FROM documents),
leaves AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other
  FROM given),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM leaves),
nodes AS (
  SELECT source, 0 AS level, i, leaf AS h FROM placed
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM nodes)
  WHERE n > 1 GROUP BY source, level, i // 3),
subroots AS (
  SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY level DESC) AS turn FROM nodes) WHERE turn = 1),
upper AS (
  SELECT 0 AS level, place AS i, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY level, i // 3),
summit AS (SELECT max(level) AS top, arg_max(h, level) AS root FROM upper),
steps AS (
  SELECT p.r, n.level, n.i, n.h, n.i < p.i // (3 ** n.level)::BIGINT AS ahead FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
    JOIN nodes n ON n.source IS NOT DISTINCT FROM p.source AND n.level < s.height
      AND n.i // 3 = p.i // (3 ** (n.level + 1))::BIGINT AND n.i <> p.i // (3 ** n.level)::BIGINT
  UNION ALL
  SELECT p.r, 1000 + u.level, u.i, u.h, u.i < s.place // (3 ** u.level)::BIGINT FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source, summit, upper u
  WHERE u.level < top AND u.i // 3 = s.place // (3 ** (u.level + 1))::BIGINT AND u.i <> s.place // (3 ** u.level)::BIGINT),
every AS (
  SELECT p.r, k AS level FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source, range(s.height) AS a(k)
  UNION ALL SELECT p.r, 1000 + k FROM placed p, summit, range(top) AS b(k)),
rungs AS (
  SELECT e.r, e.level, coalesce(string_agg(h, '' ORDER BY i) FILTER (ahead), '') AS l, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT ahead), '') AS g
  FROM every e LEFT JOIN steps t ON e.r = t.r AND e.level = t.level GROUP BY e.r, e.level),
proofs AS (SELECT r, string_agg(l || g, '' ORDER BY level) AS siblings, list(l || '*' || g ORDER BY level) AS path FROM rungs GROUP BY r),
folded AS (
  SELECT p.*, s.subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(other, leaf), coalesce(path, [])), lambda node, step: sha256(replace(step, '*', node))) AS folded_root
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN proofs q ON p.r = q.r, summit)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query("op11_merkle", MERKLE_SQL)
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(table(spark, sf, "documents"), *merkle.cut_newlines())


RULES_SQL = """
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS lines,
    regexp_extract_all(lower(translate(coalesce(text, ''), '#*$%&|<>.,;:!?', '')), '[^\\x20\\x09-\\x0D]+') AS plain
  FROM documents),
looked AS (SELECT r, lang, unnest(plain) AS word FROM given),
common AS (
  SELECT lang, word, turn FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS turn FROM looked GROUP BY lang, word) WHERE turn <= 32),
windows AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM given)),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM windows), range(3) AS s(k) WHERE times > 1 GROUP BY r),
sized AS (
  SELECT g.*, len(words) AS n_words, coalesce(n, 0) AS n_repeat_words, length(text) AS size,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^\\p{Ll}]', '', 'g')) AS k1, length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) AS k2,
    length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) AS k3, length(regexp_replace(text, '[^.,;:!?]', '', 'g')) AS k4
  FROM given g LEFT JOIN repeated USING (r)),
base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [k1, k2, k3, k4, size - word_chars, n_symbols, word_chars - n_symbols - k1 - k2 - k3 - k4] AS classes FROM sized),
bins AS (SELECT r, lang, 'c' AS kind, k AS bin, classes[k] AS n FROM base, range(1, 8) AS s(k)
  UNION ALL
  SELECT r, l.lang, 'w', coalesce(turn, 0), count(*) FROM looked l LEFT JOIN common c ON l.lang IS NOT DISTINCT FROM c.lang AND l.word = c.word GROUP BY r, l.lang, turn),
refs AS (
  SELECT bins.lang, kind, bin, sum(n) AS n FROM bins JOIN base USING (r) WHERE NOT base_failed GROUP BY bins.lang, kind, bin),
own AS (SELECT r, lang, kind, bin, n / sum(n) OVER (PARTITION BY r, kind) AS p FROM bins WHERE n > 0),
whole AS (SELECT lang, kind, bin, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM refs WHERE n > 0),
met AS (
  SELECT r, own.kind, sum(p * log2(2 * p / (p + coalesce(q, 0)))) AS p_part, sum(coalesce(q * log2(2 * q / (p + q)), 0)) AS q_part, sum(coalesce(q, 0)) AS q_met
  FROM own LEFT JOIN whole ON own.lang IS NOT DISTINCT FROM whole.lang AND own.kind = whole.kind AND own.bin = whole.bin GROUP BY r, own.kind),
far AS (
  -- bins that the document lacks add the share of the reference that it did not meet
  SELECT r, kind, (p_part + q_part + 1 - q_met) / 2 AS squared FROM met WHERE q_met > 0),
judged AS (
  SELECT b.*, c.squared > 0.14 ** 2 + 5.0 / nullif(len(plain), 0) OR w.squared > 0.14 ** 2 + 12.0 / nullif(len(plain), 0) AS strange
  FROM base b LEFT JOIN far c ON b.r = c.r AND c.kind = 'c' LEFT JOIN far w ON b.r = w.r AND w.kind = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(len(plain) >= 50 AND strange, FALSE) AS kept
FROM judged
"""


@query("op12_rules", RULES_SQL)
def op12_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = divergence.divergence(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return rows.select(*divergence.BASE, "base_failed", "kept")

import random

import pytest
from pyspark.sql import functions as F

from tessarine.operators import chunking as C


def noisy_texts(n):
    rng = random.Random(11)
    return ["".join(rng.choice(["ab", "c", ". ", ", ", "\n", "\n \n", "; ", " ", " ", "।  ", "é"]) for _ in range(rng.randint(1, 120))) for _ in range(n)]


def by_document(rows, *fields):
    out = {}
    for r in sorted(rows, key=lambda r: (int(r.document_id), r.chunk_index)):
        out.setdefault(int(r.document_id), []).append(tuple(r[f] for f in fields))
    return out


CHARACTER_CASES = {
    "sentence end in the second half": ("abcdef. ghijklmnop", 10, 0, [(0, 7), (8, 18)]),
    "no boundary, overlap": ("abcdefghijklmno", 10, 3, [(0, 10), (7, 15)]),
    "line break": ("abcdefg\nhijk lmnop", 10, 0, [(0, 7), (8, 18)]),
    "boundary in the first half is passed over": ("ab. cdefghijklmn", 10, 0, [(0, 10), (10, 16)]),
    "last of two boundaries": ("abcde, fg, hijklmnop", 12, 0, [(0, 10), (11, 20)]),
    "short": ("  abc ", 10, 2, [(2, 5)]),
    "blank": (" \n ", 10, 2, []),
}
TOKEN_CASES = {
    "no boundary": ("one two three four five six", 4, 1, 100, [(0, 4), (3, 6)]),
    "comma in the second half": ("one two three, four five six seven", 5, 1, 100, [(0, 3), (2, 7)]),
    "windows are not crossed": ("one two three four five six", 4, 0, 4, [(0, 4), (4, 6)]),
    "whole": (" one  two ", 4, 1, 100, [(0, 2)]),
}


@pytest.mark.parametrize("text, size, overlap, spans", CHARACTER_CASES.values(), ids=list(CHARACTER_CASES))
def test_character_spans(spark, text, size, overlap, spans):
    df = spark.createDataFrame([("0", text)], "document_id string, text string")
    assert by_document(C.naive_chunks(df, size, overlap).collect(), "start_char", "end_char").get(0, []) == spans


@pytest.mark.parametrize("text, target, overlap, window, spans", TOKEN_CASES.values(), ids=list(TOKEN_CASES))
def test_token_spans(spark, text, target, overlap, window, spans):
    df = spark.createDataFrame([("0", text)], "document_id string, text string")
    assert by_document(C.token_chunks(df, target, overlap, window).collect(), "first_token", "last_token").get(0, []) == spans


def test_character_chunks_cover_all_texts(spark):
    texts = noisy_texts(120) + ["ab, cd. " * 3000]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")
    for size, overlap in ((32, 6), (20, 0), (9, 4)):
        found = by_document(C.naive_chunks(df, size, overlap).collect(), "start_char", "end_char", "text")
        for i, text in enumerate(texts):
            spans, covered = found.get(i, []), set()
            for start, end, piece in spans:
                assert piece == text[start:end] and 0 < end - start <= size and piece == piece.strip()
                covered |= set(range(start, end))
            assert {k for k, c in enumerate(text) if not c.isspace()} <= covered
            for (start, end, _), (after, _, _) in zip(spans, spans[1:], strict=False):
                assert start <= after and after >= end - overlap
                gap = text[end:after] if after > end else ""
                assert gap.strip() == ""


def test_token_chunks_cover_all_tokens(spark):
    texts = [t for t in noisy_texts(80) if t.strip()]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")
    for target, overlap, window in ((5, 1, 12), (6, 2, 7), (8, 0, 1000)):
        found = by_document(C.token_chunks(df, target, overlap, window).collect(), "first_token", "last_token", "text")
        for i, text in enumerate(texts):
            tokens, spans = text.split(), found[i]
            assert [t for t in range(len(tokens)) if not any(a <= t < b for a, b, _ in spans)] == []
            for first, last, piece in spans:
                assert piece.split() == tokens[first:last] and last - first <= target and first // window == (last - 1) // window
            for (_, last, _), (after, _, _) in zip(spans, spans[1:], strict=False):
                assert after == last if last % window == 0 else last - overlap <= after or after > last - target


def test_chunks_need_no_shuffle(spark):
    df = spark.createDataFrame([("0", "a b. c")], "document_id string, text string")
    for chunks in (C.naive_chunks(df), C.token_chunks(df), C.document_windows(df)):
        assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()


def test_late_pooling_gives_unit_vectors(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([("doc-1", text)], "document_id string, text string")
    chunks = C.token_chunks(df, 5, 1, 12)
    tokens = spark.createDataFrame([("doc-1", i, [float(i + 1), 78.0, float(i), 1.0]) for i in range(12)], "document_id string, pos int, vector array<float>")
    pooled = C.late_pool(tokens, chunks, "chunk_index")
    norms = [r[0] for r in pooled.select(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).collect()]
    assert len(norms) == chunks.count() > 1
    assert all(abs(n - 1) < 1e-5 for n in norms)
    assert chunks.filter("chunk_index = 0").first().text == text[: chunks.filter("chunk_index = 0").first().end_char]
    assert C.offset_problems(chunks, df).filter("problem is not null").count() == 0


def test_masked_mean_of_nothing_is_zero(spark):
    tokens = spark.createDataFrame([("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [1.0, 1.0], 0)], "document_id string, vector array<float>, mask int")
    got = {r.document_id: r.vector for r in C.mean_pool_masked(tokens).collect()}
    assert [round(x, 6) for x in got["a"]] == [0.6, 0.8] and got["b"] == [0.0, 0.0]


def test_tokens_dealt_by_block_are_pooled_where_they_are(spark):
    rows = [("long", i, i % 5) for i in range(1200)] + [("short", 0, 2), ("other", 0, 5)]
    dealt = C.by_block(spark.createDataFrame(rows, "document_id string, pos int, bank int"))
    bank = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(5)] + [(5, [1.0, 2.0])], "bank int, vector array<float>")
    tokens = dealt.join(F.broadcast(bank), "bank")
    cuts = [("long", 0, 0, 511), ("long", 1, 500, 1030), ("long", 2, 1024, 1200), ("short", 0, 0, 1), ("other", 0, 0, 1)]
    spans = spark.createDataFrame(cuts, "document_id string, span int, first_token int, last_token int")
    spans = spans.hint("merge")
    pooled = C.late_pool(tokens, spans, width=3)
    got = {(r.document_id, r.span): (r.token_count, list(r.vector)) for r in pooled.collect()}
    assert set(got) == {(d, s) for d, s, _, _ in cuts[:4]}
    for document, span, first, last in cuts[:4]:
        values = [b for d, pos, b in rows if d == document and first <= pos < last]
        mean = [1.0, sum(values) / len(values), 0.5]
        size = sum(x * x for x in mean) ** 0.5
        assert got[document, span][0] == last - first
        assert all(abs(a - x / size) < 1e-6 for a, x in zip(got[document, span][1], mean))
    plain = C.late_pool(tokens.filter("document_id <> 'other'").drop("block"), spans)
    assert {(r.document_id, r.span, r.token_count) for r in plain.collect()} == {(*k, n) for k, (n, _) in got.items()}
    plan = pooled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # the vectors join after the tokens were dealt out, and are not dealt out again before they are summed
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.index("HashAggregate") < plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
    between = plan[plan.index("SortMergeJoin") : plan.index("BroadcastHashJoin")]
    assert "Exchange hashpartitioning" not in between


def test_last_boundary_is_found_in_one_pass(spark):
    """As cutting at each boundary lazily from the left does it, and without lists or folds over them."""
    import random
    import re

    boundary = re.compile(r"\n\s*\n|[.!?;:।॥]\s+|\n|,\s+")
    rng = random.Random(11)
    pool = list("abZ.!?;:,।\n\n \t\x85\xa0 \x1c1é。")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", C.last_boundary(F.col("x")).alias("y"))
    assert all(r.y == max((m.end() for m in boundary.finditer(r.x)), default=0) for r in df.collect())
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()

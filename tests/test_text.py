import math
import random
import unicodedata

from pyspark.sql import functions as F

from tessarine.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def python_tokens(text):
    out, current = [], ""
    for ch in unicodedata.normalize("NFKC", text).casefold():
        if unicodedata.category(ch)[0] in "LMN":
            current += ch
        elif current:
            out.append(current)
            current = ""
    return out + ([current] if current else [])


def test_fold_equals_nfkc_casefold_on_random_text(spark):
    rng = random.Random(7)
    pool = [chr(c) for c in range(32, 0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    easy = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x180), *range(0x900, 0x950))]
    texts = ["".join(rng.choice(pool if i % 2 else easy) for _ in range(12)) for i in range(3000)]
    texts += ["Straße", "ſ", "ΣΑΣ", "İ", "ﬁ ½", "हिन्दी ड़", "é", "́", "ΌΣΟΣ ς"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for row in df.select("x", T.fold(F.col("x")).alias("y"), T.nfkc(F.col("x")).alias("n")).collect():
        assert row.y == unicodedata.normalize("NFKC", row.x).casefold(), repr(row.x)
        assert row.n == unicodedata.normalize("NFKC", row.x), repr(row.x)


def test_tokens_keep_marks_and_numbers(spark):
    text = "चंद्रयान-3 ｆｏｕｎｄ Über 2021!"
    assert one(spark, T.lexical_tokens(F.col("x")), text) == python_tokens(text)


def test_content_tokens_fall_back_to_all_tokens(spark):
    assert one(spark, T.content_tokens(F.col("x")), "what is the") == ["what", "is", "the"]
    assert one(spark, T.content_tokens(F.col("x")), "what is Sundarpur") == ["sundarpur"]


def test_sentences_split_on_unicode_ends_and_newlines(spark):
    got = one(spark, T.sentences(F.col("x")), "A b. C d! e.f\n\n g।  h")
    assert got == ["A b.", "C d!", "e.f", "g।", "h"]


def test_strip_removes_unicode_space(spark):
    assert one(spark, T.strip(F.col("x")), " \x1c a b \n") == "a b"
    assert one(spark, T.is_blank(F.col("x")), " \x1f ") is True


def test_transcript_normalisation_drops_combining_marks(spark):
    assert one(spark, T.normalize_transcript(F.col("x")), "हिन्दी, Straße_1!") == "ह न द strasse_1"


def test_citations(spark):
    text = "A [chunk:x-1] b [chunk:हि] [chunk:bad id]"
    assert one(spark, T.citations(F.col("x")), text) == ["x-1", "हि"]
    assert one(spark, T.is_safe_citation_id(F.col("x")), "bad id]") is False
    assert one(spark, T.is_safe_citation_id(F.col("x")), "चंद्रयान-3") is True


def test_markdown_prefix_and_control_characters(spark):
    assert one(spark, T.strip_markdown_prefix(F.col("x")), " 12) item") == "item"
    assert one(spark, T.has_control_characters(F.col("x")), "a‮b") is True
    assert one(spark, T.has_control_characters(F.col("x")), "a\tb\n") is False


def test_language_codes(spark):
    for raw, code in ((" HIN-in", "hi"), ("pun", "pa"), ("en-US", "en"), ("", None), (None, None)):
        assert one(spark, T.normalize_language(F.col("x")), raw) == code


def test_float_keys_match_eight_significant_digits(spark):
    values = [0.0, 1.0, 0.1, 4096.0, 1e-5, 1.5e8, 123456789.0, -2.5, 0.00012345678912, 1 / 3, 99999999.0, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", T.missing_float_key(F.col("x")).alias("y")).collect():
        assert row.y == format(row.x, ".8g")


def test_redaction_goes_in_order(spark):
    assert one(spark, T.redact(F.col("x"), ["abc", "", "b"]), "abcb") == "[REDACTED][REDACTED]"


def test_folding_needs_no_python_worker(spark):
    text = F.col("id").cast("string")
    df = spark.range(1).select(T.lexical_tokens(text).alias("t"), T.nfkc(text).alias("n"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert one(spark, T.fold(F.col("x")), None) is None
    assert one(spark, T.fold(F.col("x")), "") == ""

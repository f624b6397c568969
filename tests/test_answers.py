import math

import pytest
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.operators import answers as A

DONE = "The Velmora harbour was finished in 1640."
ASK = "When was the Velmora harbour finished?"


def answer(spark, query, chunks):
    rows = [("r", query, c[0], c[1], 0.8, c[3] if len(c) > 3 else 0.8, c[2]) for c in chunks]
    evidence = spark.createDataFrame(rows, "request_id string, query string, chunk_id string, text string, mrl_score double, full_score double, rank int")
    return A.extractive_answer(spark.createDataFrame([("r",)], "request_id string"), evidence).first().answer


CASES = {
    "numbers_decide_between_equal_claims": (ASK, [("a", DONE, 1, 0.84), ("b", "The Velmora harbour was finished in 1641.", 2, 0.83)], None),
    "best_sentence_of_all_chunks": (
        ASK, [("rope", "Velmora sells salt and rope. Its looms date from 1701.", 1, 0.92), ("quay", "Masons say the Velmora harbour was finished in 1640.", 2)],
        "[chunk:quay] Masons say the Velmora harbour was finished in 1640.",
    ),
    "higher_score_wins_a_tie": (ASK, [("second", DONE, 1, 0.8), ("first", DONE, 2, 0.9)], f"[chunk:first] {DONE}"),
    "score_too_low": (ASK, [("faint", DONE, 1, 0.5)], None),
    "no_shared_words": (ASK, [("kettle", "Copper pans want polishing each spring.", 1, 0.99)], None),
    "no_words_at_all": ("Velmora harbour date", [("dots", "...", 1)], None),
    "id_that_cannot_be_cited": ("Velmora harbour date", [("odd id]", "The harbour date of Velmora is 1640.", 1)], None),
    "score_that_is_no_number": ("Velmora harbour date", [("void", "The harbour date of Velmora is 1640.", 1, math.nan)], None),
    "negation_inside_one_sentence": (
        "सेतु 5 कब खुला", [("पुल-5", "सेतु 5 वर्ष 1998 में नहीं खुला; वह 2001 में खुला।", 1)], "[chunk:पुल-5] सेतु 5 वर्ष 1998 में नहीं खुला; वह 2001 में खुला।",
    ),
    "opposites_en": ("sweets low in sugar", [("x", "Sweets high in sugar include toffee and syrup.", 1)], None),
    "opposites_hi": ("चीनी में कम मिठाई", [("x", "उच्च चीनी वाली मिठाई में बर्फी शामिल है।", 1)], None),
    "opposites_ta": ("சர்க்கரை குறைவுள்ள இனிப்பு", [("x", "அதிக சர்க்கரை உள்ள இனிப்பு லட்டு அடங்கும்.", 1)], None),
    "opposites_ur": ("چینی میں کم مٹھائی", [("x", "زیادہ چینی والی مٹھائی میں لڈو شامل ہیں۔", 1)], None),
    "number_asked_none_given": ("மலைக் கோயில் வடக்குச் சாலை எண்", [("x", "மலைக் கோயில் வடக்குச் சாலை ஊரில் அமைந்துள்ளது.", 1)], None),
    "number_word_given": ("कितनी नावें खड़ी हैं", [("n", "घाट पर तीन नावें खड़ी हैं।", 1)], "[chunk:n] घाट पर तीन नावें खड़ी हैं।"),
}


@pytest.mark.parametrize("query, chunks, expected", CASES.values(), ids=list(CASES))
def test_selected_sentence(spark, query, chunks, expected):
    assert answer(spark, query, chunks) == (expected or V.SAFE_REFUSAL_TEXT)


def test_routes(spark):
    rows = [("a", "[chunk:x] y", 10.0), ("b", V.SAFE_REFUSAL_TEXT, 175.0), ("c", V.SAFE_REFUSAL_TEXT, 500.0), ("d", V.SAFE_REFUSAL_TEXT, 500.0)]
    extracted = spark.createDataFrame(rows, "request_id string, answer string, budget_ms double")
    fallback = spark.createDataFrame([("b", "late [chunk:x]", "stop"), ("c", "given [chunk:x]", "stop")], "request_id string, answer string, finish_reason string")
    got = {r.request_id: (r.route, r.finish_reason) for r in A.hybrid_routing(extracted, fallback).collect()}
    assert got == {"a": ("extractive", "stop"), "b": ("budget_skipped", "budget_skipped"), "c": ("fallback", "stop"), "d": ("fallback_missing", "stop")}


def test_digit_tokens(spark):
    df = spark.createDataFrame([(["x²"],), (["५"],), (["½"],), (["ab"],)], "t array<string>")
    assert [r[0] for r in df.select(A.has_digit_token(F.col("t"))).collect()] == [True, True, False, False]

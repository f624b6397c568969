import random

import numpy as np

from tessarine.llm import language

TONGUES = {"aa": "the and of this with that from have not are", "bb": "der und die nicht mit auf ist ein wie zu", "cc": "que los una por con para como más niño sí"}


def text(draw, lang, n):
    return " ".join(draw.choices(TONGUES[lang].split(), k=n))


def fixture():
    draw = random.Random(6)
    rows = []
    for i in range(240):
        lang = draw.choice(list(TONGUES))
        rows.append((i, text(draw, lang, draw.randint(3, 40)), lang if i % 9 else None, "src"))
    return rows


def test_held_out_documents_are_recognised(make_docs):
    rows = fixture()
    docs = make_docs([*rows, (300, None), (301, ""), (302, "123 !?"), (303, None, "zz"), (None, "the and of", "zz"), rows[3]], extra=("lang_pred", "n"))
    got = language.identify_held_out(docs).collect()
    truth = {r[0]: r[2] for r in rows if r[2]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len(got) == len(rows) + 6
    by_id = {r.doc_id: r for r in got}
    for doc_id in (300, 301, 302, 303):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score, by_id[doc_id].languages) == ("und", 0.0, [])
    assert by_id[None].lang_pred == "aa" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in got)


def test_mixed_documents_get_both_languages(make_docs):
    rows, draw = fixture(), random.Random(7)
    names, table = language.language_model(make_docs(rows).where("lang is not null"))
    assert names == ["aa", "bb", "cc"] and np.allclose(table.sum(axis=0), 1)
    mixed = text(draw, "aa", 120) + " " + text(draw, "cc", 40)
    r = language.identify(make_docs([(1, mixed)]), names, table).first()
    assert r.languages == ["aa", "cc"] and 0.6 < r.shares[0] < 0.85 and r.score == r.shares[0]
    long = language.identify(make_docs([(1, text(draw, "bb", 60_000))]), names, table).first()
    assert long.languages == ["bb"] and long.score > 0.99


def test_expectation_maximisation_finds_the_best_weights():
    draw = np.random.default_rng(2)
    chances, counts = draw.random((50, 2)) + 0.01, draw.integers(1, 9, 50).astype(float)
    weights, value = language.proportions(chances, counts)
    grid = [counts @ np.log(chances @ np.array([w, 1 - w])) for w in np.linspace(0, 1, 1001)]
    assert abs(weights.sum() - 1) < 1e-9 and value >= max(grid) - 0.05


def test_without_training_rows(make_docs):
    assert language.identify_held_out(make_docs([])).count() == 0
    assert [r.lang_pred for r in language.identify_held_out(make_docs([(1, "words")])).collect()] == ["und"]

import random

import numpy as np

from tessarine.llm import quality as Q

VOCABULARY = "the of and that with river stone garden walked over small houses while evening light came slowly down".split()


def good(draw, n):
    out = []
    for k in range(n):
        out.append(draw.choice(VOCABULARY) + ("." if k % 11 == 10 else ""))
    return " ".join(out).capitalize()


FAULTS = [
    lambda draw, n: " ".join(w.upper() + "!!" for w in good(draw, n).split()),
    lambda draw, n: " | ".join(good(draw, n).split()),
    lambda draw, n: " ".join(w + draw.choice(["***", "$$$", "%%%"]) for w in good(draw, n).split()),
    lambda draw, n: " ".join([draw.choice(VOCABULARY)] * n),
]


def fixture():
    draw = random.Random(13)
    rows, truth = [], {}
    for i in range(400):
        bad = draw.random() < 0.2
        text = draw.choice(FAULTS)(draw, draw.randint(30, 200)) if bad else good(draw, draw.randint(30, 200))
        rows.append((i, text))
        truth[i] = not bad
    return rows, truth


def test_scores_separate_good_from_bad(make_docs):
    rows, truth = fixture()
    docs = make_docs([*rows, (500, None), (501, ""), (502, " \n"), (None, rows[0][1]), rows[1], (503, "word river stone. " * 60_000)], extra=("votes", "at", "value", "score"))
    got = Q.quality_scores(docs).collect()
    assert len(got) == len(rows) + 6
    assert all(r.keep == truth[r.doc_id] for r in got if r.doc_id in truth)
    by_id = {r.doc_id: r for r in got}
    assert set(by_id[500].votes) == {Q.SILENT} and by_id[500].score == by_id[501].score == by_id[502].score
    assert by_id[None].score == by_id[0].score and all(0 <= r.score <= 1 for r in got)
    kept = Q.drop_low_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if r.keep)


def test_held_out_quality_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = Q.quality_scores(docs).join(labels, "doc_id").select("keep", "quality").collect()
    right = sum(r.keep == (r.quality == 1) for r in found)
    assert len(found) > 300 and right >= 0.98 * len(found)


def test_expectation_maximisation_recovers_accuracies():
    draw = np.random.default_rng(4)
    truth = draw.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9])
    votes = np.where(draw.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[draw.random((20_000, 4)) < 0.3] = Q.SILENT
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.label_model(patterns, counts)
    assert np.abs(model.accuracies() - right).max() < 0.03 and abs(model.good - 0.8) < 0.03


def test_empty_and_uniform_tables(make_docs):
    assert Q.quality_scores(make_docs([])).count() == 0
    assert Q.drop_low_quality(make_docs([])).count() == 0
    draw = random.Random(1)
    assert {r.keep for r in Q.quality_scores(make_docs([(i, good(draw, 80)) for i in range(30)])).collect()} == {True}


def test_variety_speaks_for_long_texts():
    junk = "buy these cheap pills now at once. " * 1200
    assert len(junk.split()) > 5000
    variety = Q.LABELLERS["variety"]
    assert variety(Q.shapes(junk)[1]) == Q.BAD
    part = " ".join(junk.split()[:5000])
    assert variety(Q.shapes(part)[1]) == Q.BAD
    many = " ".join(f"w{i % 4000}" for i in range(40_000))
    assert variety(Q.shapes(many)[1]) == variety(Q.shapes(" ".join(many.split()[:5000]))[1]) == Q.GOOD

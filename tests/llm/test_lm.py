import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessarine.llm import lm


def fixture():
    draw = random.Random(9)
    tongues = [[f"{stem}{k}" for k in range(80)] for stem in ("ab", "cd")]
    rows = [(i, " ".join(draw.choices(tongues[i % 2], weights=range(1, 81), k=draw.randint(0, 60)))) for i in range(200)]
    rows += [(200, None), (201, ""), (None, "ab1 cd1 fresh"), (202, "Never SEEN words é É"), rows[4], (203, "ab1\x0bAB1 ab1\xa0ab1 " * 3000)]
    return rows + [(500 + i, f"rare{i} ab1") for i in range(40)]


def tokens_of(text):
    return (text or "").encode().lower().split() + [b""]


def learned(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


@pytest.fixture
def small(monkeypatch):
    for name, value in (("OWN_CLASSES", 60), ("SUFFIXES", 8), ("KNOWN_WORDS", 120), ("COUNTED", 50), ("WIDTH", 8)):
        monkeypatch.setattr(lm, name, value)


def test_base_and_counts_match_brute_force(make_docs, small):
    rows = fixture()
    got = lm.language_model_scores(make_docs(rows, extra=("token", "n", "rest", "row")), epochs=1).collect()
    counts = Counter(t for i, x in rows if learned(i) for t in tokens_of(x))
    total = sum(counts.values())
    want = []
    for doc_id, text in rows:
        own = tokens_of(text)
        base = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own)
        held = doc_id is not None and not learned(doc_id)
        want.append((doc_id, held, len(own), sum(counts[t] > 0 for t in own), total, round(base, 6)))
    assert sorted(want, key=repr) == sorted(
        ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr
    )
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one_after_any_token(spark, make_docs, small):
    rows = fixture()
    training = make_docs([r for r in rows if learned(r[0])]).select("text")
    counts = lm.count_tokens(training)
    vocab = lm.vocabulary(counts)
    assert len(vocab.tokens) < vocab.distinct  # some words are not known to tasks
    model = lm.train(training, vocab, 1)
    every = sorted(bytes(r.token) for r in counts.collect() if r.token)
    texts = [f"{first} {w.decode()}" for first in ("ab1", "rare3", "cd70", "zzz") for w in [*every, b"unheard"]]
    alone = ["ab1", "rare3", "cd70", "zzz"]
    docs = make_docs(list(enumerate(texts + alone))).select("doc_id", "text")
    score = {r.doc_id: r.score for r in lm.score_texts(docs, counts, vocab, model).collect()}
    normal, known = model.log_normal(), vocab.lookup()
    end = lambda w: (model.r[c(w)] @ model.q[0] + model.b[0] - normal[c(w)]) / math.log(10)
    c = lambda w: int(lm.classes([w], known, vocab)[1][0])
    for k, first in enumerate(alone):
        start = score[len(texts) + k] - end(first.encode())  # log-probability of the first word alone
        own = range(k * (len(every) + 1), (k + 1) * (len(every) + 1))
        seconds = [*every, b"unheard"]
        total = sum(10 ** (score[i] - start - end(w)) for i, w in zip(own, seconds, strict=True)) + 10 ** end(first.encode())
        assert abs(total - 1) < 1e-4


def test_training_raises_the_likelihood():
    counts = np.array([[1000.0 if (c - b) % 20 < 3 else 0.0 for c in range(20)] for b in range(20)], dtype=np.float32)
    model = lm.Model(np.ones(20), width=8)

    def likelihood():
        logs = model.r @ model.q.T + model.b - model.log_normal()[:, None]
        return float((logs * counts).sum() / counts.sum())

    start = likelihood()
    model.train(np.arange(20), counts, 150)
    assert start < -2.9 and likelihood() > -1.3  # log(1/20) and log(1/3) are the bounds


def test_nothing_to_learn_from(make_docs):
    assert lm.language_model_scores(make_docs([])).count() == 0
    got = lm.language_model_scores(make_docs([(None, "a b"), (None, None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessarine.llm import counts

SCORES = {"▁": -9, "▁a": -5, "a": -6, "b": -6, "ab": -7, "aba": -13, "ba": -12, "bab": -11, "é": -8, "▁ab": -10}
SCORES = {k: v * counts.MICRO for k, v in SCORES.items()}


def expected(word, scores):
    """Plain search over all segmentations from the end."""
    worst, seen = min(scores.values()) - counts.MICRO, {len(word): (0, 0, 0)}
    for start in range(len(word) - 1, -1, -1):
        width = len(word[start].encode())
        score, tokens, spelt = seen[start + 1]
        options = [(score + width * worst, tokens - width, spelt + width)]
        for end in range(start + 1, len(word) + 1):
            if word[start:end] in scores:
                score, tokens, spelt = seen[end]
                options.append((score + scores[word[start:end]], tokens - 1, spelt))
        seen[start] = max(options)
    return -seen[0][1], seen[0][2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abéx", min_size=1, max_size=12), min_size=1, max_size=12))
def test_trie_equals_plain_search(words):
    trie = counts.Trie(SCORES)
    for word in words:
        assert trie.insert("▁" + word) == expected("▁" + word, SCORES)


def test_prefixes_are_computed_once():
    trie = counts.Trie(SCORES)
    for word in ("abab", "ababa", "abb", "abab"):
        trie.insert(word)
    assert len(trie.best) == 1 + 6


def test_long_words_leave_few_nodes(monkeypatch):
    monkeypatch.setattr(counts, "DEPTH", 5)
    draw, trie = random.Random(8), counts.Trie(SCORES)
    for size in (1, 4, 5, 6, 7, 30, 400):
        word = "▁" + "".join(draw.choices("abéx", k=size))
        before = len(trie.best)
        assert trie.insert(word) == expected(word, SCORES)
        assert len(trie.best) <= before + 5


def test_a_text_of_many_megabytes_without_spaces(make_docs):
    text = "".join(random.Random(9).choices("abéx", k=1_000)) * 2_000
    trie = counts.Trie(SCORES)
    trie.insert(text)
    assert len(trie.best) == counts.DEPTH + 1
    r = counts.token_counts(make_docs([(1, text)]), SCORES).first()
    assert (r.n_words, r.n_tokens, r.n_bytes) == (1, *trie.insert("▁" + text))


def test_documents(make_docs, monkeypatch):
    monkeypatch.setattr(counts, "NODES", 200)
    scores = counts.unigram_scores(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(scores) > 31_000 and "▁the" in scores
    draw = random.Random(3)
    some = ["the", "statement", "Ünïcode", "一二三", "x y", "don't", "zzzzqqq"]
    rows = [(i, " ".join(draw.choices(some, k=draw.randint(0, 12)))) for i in range(30)]
    rows += [(30, None), (31, ""), (32, " \n\t"), (None, "no id"), rows[2], (33, "word " * 40_000)]
    got = counts.token_counts(make_docs(rows, extra=("n_words", "n_tokens")), scores).collect()
    want = []
    for doc_id, text in rows:
        words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        found = [expected("▁" + w, scores) for w in words[:50]]
        if len(words) > 50:
            found = found[:1] * len(words)
        want.append((doc_id, len(words), sum(a for a, _ in found), sum(b for _, b in found)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_empty_table(make_docs):
    assert counts.token_counts(make_docs([]), SCORES).count() == 0


def test_words_met_again_do_not_walk_the_trie():
    walked, trie = [], counts.Trie(SCORES)
    plain = trie.insert
    trie.insert = lambda word: walked.append(word) or plain(word)
    known = counts.KnownWords(trie)
    for _ in range(2):
        known.learn({b"ab", b"abx", "é".encode(), b"x" * 500})
    assert sorted(walked) == sorted(["▁ab", "▁abx", "▁é", "▁" + "x" * 500, "▁" + "x" * 500])
    for word in ("ab", "abx", "é", "x" * 500):
        assert divmod(known[word.encode()], 1 << 32) == expected("▁" + word, SCORES)


def test_known_words_start_anew(monkeypatch):
    monkeypatch.setattr(counts, "KNOWN_WORDS", 3)
    draw = random.Random(4)
    known, words = counts.KnownWords(counts.Trie(SCORES)), ["".join(draw.choices("abéx", k=5)) for _ in range(60)]
    known.learn({w.encode() for w in words})
    assert len(known) <= 3
    assert all(divmod(known[w.encode()], 1 << 32) == expected("▁" + w, SCORES) for w in words)

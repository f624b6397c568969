import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessarine.llm import token_files
from tessarine.llm.encoding import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = Encoder(open(PATH).read())


def plain(text):
    return np.array(WHOLE.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\x1c\x85\xa0a'sÉß1²!|_", max_size=30)))
def test_encoder_equals_the_library(text):
    assert ENCODER.encode(text) == plain(text)


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", "it's  we'll\n \n x", "一二 ok", "x" * 5000, "a \n  b  ", "\n \n \n b"])
def test_encoder_on_chosen_texts(text):
    assert ENCODER.encode(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(2**59, 2**63 - 1)), max_size=3000))
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype=np.uint64)
    block = token_files.encode_block(ids) | {"n_ids": len(ids)}
    assert np.array_equal(token_files.decode_block(block), ids)
    for start in (0, len(ids) // 2, max(len(ids) - 1, 0)):
        assert np.array_equal(token_files.decode_block(block, start, start + 1100), ids[start : start + 1100])


def test_small_ids_share_words():
    assert len(token_files.encode_block(np.ones(600, dtype=np.uint64))["words"]) == 80


def test_files_hold_every_document_in_order(spark, make_docs, tmp_path):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(["the", "Ünder", "x1", "\n", "  ", "über-"], k=draw.randint(0, 40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "no id"), (7, rows[7][1]), (302, "long words " * 40_000)]
    draw.shuffle(rows)
    token_files.write_token_ids(make_docs(rows, extra=("shard", "mark", "ids")), str(tmp_path / "files"), PATH)
    got = token_files.read_token_ids(spark, str(tmp_path / "files")).orderBy("start").collect()
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text or "") + np.array([2], dtype="<u4").tobytes()
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == want


def test_empty_table(spark, make_docs, tmp_path):
    token_files.write_token_ids(make_docs([]), str(tmp_path / "none"), PATH)
    assert token_files.read_token_ids(spark, str(tmp_path / "none")).count() == 0


def test_words_after_a_space_are_kept_without_it():
    encoder, text = Encoder(open(PATH).read()), "one two, one two, one été <|x one"
    assert encoder.encode(text) == plain(text)
    assert set(encoder.by_chunk) == {"two,", "one", "été", "<|x"}
    for odd in (" one", "one ", "one\n ", "one \n", "\xa0 \xa0", "one\t two", "a<|endoftext|> b", "a  b"):
        assert encoder.encode(odd) == plain(odd)


def test_a_full_cache_keeps_what_is_used_again(monkeypatch):
    from tessarine.llm import encoding

    monkeypatch.setattr(encoding, "CACHED", 2)
    made = []
    cache = encoding._Cache(lambda key: made.append(key) or key.upper().encode())
    assert [cache[k] for k in ("a", "b", "c", "a", "b", "a", "d", "e", "a")] == [b"A", b"B", b"C", b"A", b"B", b"A", b"D", b"E", b"A"]
    assert made == ["a", "b", "c", "d", "e"] and len(cache) <= 2 and len(cache.older) <= 2

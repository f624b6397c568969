import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_decontaminate import expected as leaks
from test_mixing import expected_targets
from test_quality import FAULTS, VOCABULARY, good
from test_simhash import expected as groups
from test_simhash import similar_groups
from tokenizers import Tokenizer

from tessarine.llm.common import stored


def fixture():
    draw = random.Random(31)
    items = [(i, " ".join(draw.choices(VOCABULARY, k=25))) for i in range(4)]
    rows = [(i, good(draw, draw.randint(40, 200)), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[i * 5][1], "en", "s0") for i in range(8)]
    rows += [(300 + i, FAULTS[i % 4](draw, 80), "en", "s1") for i in range(30)]
    rows += [(400 + i, f"{good(draw, 60)} {items[i % 4][1]} {good(draw, 60)}", "en", "s2") for i in range(10)]
    return rows + [(500, None, None, None), (501, "", "en", "s0")], items


def test_stages_match_brute_force(spark, make_docs, tmp_path):
    rows, items = fixture()
    folder = str(tmp_path / "sf")
    docs = make_docs(rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    step, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        step = stored(stage(spark, step, folder), "test-stage")
        seen.append(step.collect())
        assert step.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
    judged, single, clean, mixed, files = seen
    kept = {r.doc_id for r in judged}
    assert not kept & set(range(300, 330)) and kept >= set(range(120)) | set(range(400, 410))
    assert {r.doc_id for r in single} == {c for _, _, c in groups([(r.doc_id, r.text) for r in judged])}
    caught = {d for d, *_ in leaks([(r.doc_id, r.text) for r in single], items)}
    assert caught == set(range(400, 410)) and {r.doc_id for r in clean} == {r.doc_id for r in single} - caught
    sizes, taken = {}, {}
    for into, part in ((sizes, clean), (taken, mixed)):
        for r in part:
            into[r.source] = into.get(r.source, 0) + len((r.text or "").split())
    for source, target in expected_targets(sizes).items():
        assert abs(taken.get(source, 0) - float(target)) <= 128
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for _, ids in sorted((r.doc_id, tokenizer.encode(r.text, add_special_tokens=False).ids + [2]) for r in mixed):
        want.append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(want) == sorted((r.n_tokens, r.ids_crc32) for r in files)
    assert max(r.start + r.n_tokens for r in files) == start
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, files))


def test_dedup_stage_drops_edited_copies(spark, make_docs):
    rows = [r for r in fixture()[0] if r[0] < 120]
    for i in range(20):
        tokens = rows[i * 5][1].split()
        tokens[len(tokens) // 2] = "edited"
        tokens[-1:] = ["other", "end"]
        rows.append((700 + i, " ".join(tokens), "en", "s0"))
    got = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, make_docs(rows), "")
    want = set(similar_groups([r[:2] for r in rows]).values())
    assert {r.doc_id for r in got.collect()} == want and len(want & set(range(700, 720))) < 10

import random

from tessarine.llm import decontaminate as D


def words_of(text):
    return [w for w in (text or "").translate({i: 32 for i in (9, 10, 11, 12, 13)}).translate({i: i + 32 for i in range(65, 91)}).split(" ") if w]


def expected(rows, items, threshold=0.8):
    out = []
    for doc_id, text in rows:
        own, best = words_of(text), {}
        for item, body in items:
            target = words_of(body)
            for start in range(len(own) - len(target) + 1 if target else 0):
                s = D.similarity(D.shingles(own[start : start + len(target)]), D.shingles(target))
                if s >= threshold and s > best.get(item, (0,))[0]:
                    best[item] = (s, start, start + len(target))
        out += [(doc_id, item, *v) for item, v in best.items()]
    return sorted(out, key=repr)


def fixture():
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(12, 45)))) for i in range(25)]
    items += [(90, "two words"), (91, None), (92, ""), (93, items[3][1]), (94, "a b a b a b a b a b"), (None, "item without an id here ok")]
    rows = []
    for i in range(120):
        body = draw.choices(vocabulary, k=draw.randint(0, 150))
        if i % 3 == 0:
            passage = draw.choice(items[:25])[1].split()
            if i % 2:
                for _ in range(i % 4):
                    passage[draw.choice([0, -1, len(passage) // 2])] = "other"
            at = draw.randint(0, len(body))
            body[at:at] = [w.upper() for w in passage] if i % 9 == 0 else passage
        rows.append((i, "\n".join(body) if i % 5 == 0 else " ".join(body)))
    rows += [(200, None), (201, ""), (None, "x " + items[4][1]), rows[0], (202, "two\t words"), (203, "a b " * 60), (204, "x item WITHOUT an id here ok")]
    return rows + [(205, "filler words " * 40_000 + items[5][1])], items


def items_frame(spark, items):
    return spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")


def test_matches_equal_brute_force(spark, make_docs):
    rows, items = fixture()
    got = D.contaminated(make_docs(rows, extra=("item_id", "similarity")), items_frame(spark, items))
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    want = expected([(i, t) for i, t in rows if i != 205], items)
    assert [g for g in got if g[0] != 205] == want and len(want) > 30
    assert {g[1] for g in got if g[0] == 205} == {5}


def test_clean_documents_stay_with_their_columns(spark, make_docs):
    rows, items = fixture()
    docs = make_docs(rows, extra=("start_word",))
    kept = D.decontaminate(docs, items_frame(spark, items))
    assert kept.columns == docs.columns
    caught = {d for d, *_ in expected([(i, t) for i, t in rows if i != 205], items)} | {205}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(i) for i, _ in rows if i not in caught)


def test_blocks_of_the_benchmark_give_the_same_matches(spark, make_docs, monkeypatch):
    rows, items = fixture()
    docs, frame = make_docs(rows[:60]), items_frame(spark, items)
    whole = sorted(map(repr, D.contaminated(docs, frame).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 1500)
    assert sorted(map(repr, D.contaminated(docs, frame).collect())) == whole


def test_index_finds_every_fingerprint_within_the_radius():
    draw = random.Random(2)
    prints = [draw.getrandbits(64) for _ in range(60)]
    part = D.Lengths(9, list(range(60)), [], None, D.np.array(prints, dtype=D.np.uint64))
    part.index(20)
    windows = []
    for p in prints:
        for bit in draw.sample(range(64), draw.randint(0, 24)):
            p ^= 1 << bit
        windows.append(p)
    found = set(part.candidates(D.np.array(windows, dtype=D.np.uint64), 20))
    assert found == {(w, i) for w, a in enumerate(windows) for i, b in enumerate(prints) if (a ^ b).bit_count() <= 20}


def test_empty_tables(spark, make_docs):
    none = items_frame(spark, [])
    assert D.contaminated(make_docs([(1, "a b c")]), none).count() == 0
    assert D.decontaminate(make_docs([(1, "a b c")]), none).count() == 1
    assert D.contaminated(make_docs([]), items_frame(spark, [(1, "a b c d e f")])).count() == 0


def test_documents_shorter_than_the_item(spark, make_docs):
    draw = random.Random(8)
    items = [(k, " ".join(draw.choices([f"w{i}" for i in range(400)], k=n))) for k, n in enumerate((5, 6, 9, 14, 24, 40, 57))]
    rows, want = [], []
    for item, text in items:
        own = text.split()
        for less in range(1, 14):
            for part in (own[less:], own[:-less], own[less // 2 : len(own) - (less - less // 2)]):
                rows.append((len(rows), " ".join(part)))
                s = D.similarity(D.shingles(part), D.shingles(own))
                want += [(len(rows) - 1, item, s, 0, len(part))] * (s >= 0.8)
    got = sorted(tuple(r) for r in D.contaminated(make_docs(rows), items_frame(spark, items)).collect())
    assert got == want and len(want) > 40
    kept = {r.doc_id for r in D.decontaminate(make_docs(rows), items_frame(spark, items)).collect()}
    assert kept == {r[0] for r in rows} - {w[0] for w in want}

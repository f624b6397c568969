import random

import xxhash

from tessarine.llm import simhash
from tessarine.llm.components import components


def expected_print(text):
    table = {i: (" " if chr(i) in " \t\n\x0b\x0c\r" else chr(i).lower()) for i in range(128)}
    tokens = [t for t in (text or "").translate(table).split(" ") if t]
    shingles = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    out = 0
    for bit in range(64):
        if sum(h >> bit & 1 for h in hashes) > len(hashes) / 2:
            out |= 1 << bit
    return out


def expected(rows):
    prints = [expected_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    group[i] = min(group[i], group[j])
    ids = {}
    for g, (doc_id, _) in zip(group, rows, strict=True):
        ids[g] = min((x for x in (ids.get(g), doc_id) if x is not None), default=None)
    return sorted(((r[0], f"{p:016x}", ids[g]) for r, p, g in zip(rows, prints, group, strict=True)), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def fixture():
    draw = random.Random(3)
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "Straße", "一二"]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))))
    for i in range(60, 100):
        tokens = rows[draw.randrange(60)][1].split()
        if tokens:
            tokens[draw.randrange(len(tokens))] = "changed"
        rows.append((i, " ".join(tokens).upper() if i % 2 else "\t".join(tokens)))
    return rows + [(100, None), (101, ""), (None, "w1 w2 w3"), (102, "w1 w2 w3"), (7, rows[7][1]), (None, None),
                   (103, "long " * 50_000), (104, "a b c"), (105, " \n ")]


def test_groups_match_brute_force(make_docs):
    rows = fixture()
    docs = make_docs(rows, extra=("fingerprint", "component_id", "fp", "row", "root"))
    assert rows_of(simhash.simhash_groups(docs)) == expected(rows)


def test_more_blocks_give_the_same_links(spark):
    draw = random.Random(5)
    base = [draw.getrandbits(63) for _ in range(40)]
    prints = {p ^ (1 << draw.randrange(62)) ^ (1 << draw.randrange(62)) for p in base for _ in range(6)} | set(base)
    df = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
    roots = [
        sorted(map(tuple, components(simhash.fingerprint_links(df, 2, blocks)).collect())) for blocks in (4, 8)
    ]
    ordered, root = sorted(prints), {p: p for p in prints}
    for _ in ordered:
        changed = False
        for i in ordered:
            low = min(root[j] for j in ordered if (i ^ j).bit_count() <= 2)
            changed |= low < root[i]
            root[i] = min(root[i], low)
        if not changed:
            break
    linked = sorted((p, root[p]) for p in ordered if any(p != j and (p ^ j).bit_count() <= 2 for j in ordered))
    assert roots[0] == roots[1] == linked


def test_one_document_of_each_group_stays(make_docs):
    rows = fixture()
    kept = simhash.drop_near_copies(make_docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {(f, c) for _, f, c in expected(rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want})


def test_empty_table(make_docs):
    assert simhash.simhash_groups(make_docs([])).count() == 0
    assert simhash.drop_near_copies(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, i) for i in range(900, 960)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (77, 78), (78, 77)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 900 for i in [*range(900, 960), 1000]}, 77: 77, 78: 77}


def similar_groups(rows):
    """Smallest doc_id of each component of five-word shingle sets at 0.8 or more."""
    sets = []
    for _, text in rows:
        tokens = (text or "").lower().split()
        n = min(5, len(tokens))
        sets.append({tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g) for g in group}


def edited_copies():
    draw = random.Random(41)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([8, 9, 12, 30, 120, 600, 3000])))) for i in range(150)]
    for i in range(150, 400):
        tokens = rows[draw.randrange(150)][1].split()
        for _ in range(draw.randint(1, max(1, len(tokens) // 25))):
            place = draw.choice([0, len(tokens) - 1, draw.randrange(len(tokens))])
            tokens[place : place + 1] = draw.choice([[], ["edited"], [tokens[place], "more"]])
        rows.append((i, " ".join(tokens)))
    chain = draw.choices(vocabulary, k=200)
    rows += [(500 + i, " ".join(["new"] * 1 + chain[8 * i : 8 * i + 120])) for i in range(9)]
    return rows + [(600, None), (601, "  "), (602, "a b"), (603, "A\tb"), (604, "a c")]


def test_edited_copies_fall_at_five_word_similarity(make_docs, monkeypatch):
    rows = edited_copies()
    kept = sorted(similar_groups(rows).values())
    assert len(kept) < len(rows) - 100
    docs = make_docs(rows, extra=("key", "root", "first", "n"))
    got = simhash.drop_similar(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == kept
    monkeypatch.setattr(simhash, "BODY_WORDS", 300)
    monkeypatch.setattr(simhash, "TILE", 8)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == kept
    assert simhash.drop_similar(make_docs([])).count() == 0


def test_dedup_jobs_run_with_small_batches_and_the_setting_comes_back(spark, monkeypatch):
    from tessarine.llm import components as C
    from tessarine.llm.common import BATCH_BYTES, stored

    seen, before = [], spark.conf.get(BATCH_BYTES, None)

    def recorded(df, name):
        seen.append(spark.conf.get(BATCH_BYTES, None))
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", recorded)
    monkeypatch.setattr(C, "stored", recorded)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "k l m")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == [1, 3]
    assert set(seen) == {"8m"} and spark.conf.get(BATCH_BYTES, None) == before

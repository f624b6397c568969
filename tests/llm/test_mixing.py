import random
from collections import Counter, defaultdict
from fractions import Fraction

from tessarine.llm import mixing


def rows_fixture():
    draw = random.Random(2)
    sources = ["b"] * 30 + ["a"] * 8 + ["c"] * 5 + ["Z", "é", None, "tiny"]
    rows = [(i, " ".join(f"w{draw.randrange(9)}" for _ in range(draw.randint(0, 900))), "en", draw.choice(sources)) for i in range(150)]
    rows += [(150, None, "en", "a"), (151, "", "en", "void"), (None, "no id " * 50, "en", "a"), rows[3], rows[3]]
    return rows + [(152, "many words\n" * 30_000, "en", "b")]


def expected_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), ceiling=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= ceiling * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in free}
        for s in full:
            target[s] = Fraction(ceiling * sizes[s])
            left -= target[s]
        free -= full
    return target


def test_targets_and_taken(make_docs):
    rows = rows_fixture()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want = expected_targets(sizes)
    docs = make_docs(rows, extra=("size", "target", "shard", "quota", "a", "b"))
    plan = mixing.mix_plan(docs, block_words=16)
    source_of = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    got, taken = plan.collect(), Counter()
    assert len(got) == len(rows)
    for r in got:
        source = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[source]
        assert abs(r.target - float(want[source])) <= 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.passes * r.size + sum(s.end - s.start for s in r.spans)
        taken[source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - float(target)) <= max(1, 0.03 * float(target)), source
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_plan(docs, block_words=16).collect()))


def test_small_sources_meet_their_targets(make_docs):
    draw, rows = random.Random(11), []
    for source, (docs, words) in enumerate([(1, 3), (1, 10), (2, 25), (1, 40), (5, 64), (1, 65), (3, 100), (40, 700), (900, 900), (400, 90_000), (1, 0)]):
        cuts = sorted(draw.choices(range(words + 1), k=docs - 1))
        for a, b in zip([0, *cuts], [*cuts, words]):
            rows.append((len(rows), "w " * (b - a), "en", f"s{source:02}"))
    sizes, taken = Counter(), Counter()
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    want = expected_targets(sizes)
    source_of = {r[0]: r[3] for r in rows}
    for r in mixing.mix_plan(make_docs(rows)).collect():
        assert 0 <= r.taken <= 2 * r.size
        taken[source_of[r.doc_id]] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - float(target)) <= max(1, 0.03 * float(target)), source


def test_mixed_texts_hold_the_taken_words(make_docs):
    rows = rows_fixture()
    docs = make_docs(rows, extra=("size",))
    mixed = mixing.mix(docs, block_words=64)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").split())
        assert r.n_chars == len(r.text)
        assert any(word in (t or "") for i, t, *_ in rows if i == r.doc_id for word in r.text.split()[:1])
    taken = Counter()
    for r in mixing.mix_plan(docs, block_words=64).collect():
        taken[r.doc_id] += r.taken
    assert +words == +taken


def test_highest_quotients(spark):
    draw = random.Random(4)
    parties = [("g", i, draw.randint(1, 5000)) for i in range(23)] + [("h", i, 10) for i in range(5)] + [(None, 1, 3), ("z", 1, 0)]
    seats = {"g": 500, "h": 7, None: 2, "z": 0}
    df = spark.createDataFrame([(*p, seats[p[0]]) for p in parties], "grp string, id int, votes long, seats long")
    got = {(r.grp, r.id): r.won for r in mixing.apportion(df, ["grp"], "votes", "seats", [mixing.F.col("id")], "won").collect()}
    for group, total in seats.items():
        own = [p for p in parties if p[0] == group and p[2]]
        ranked = sorted(((-Fraction(v, 2 * k + 1), i) for _, i, v in own for k in range(total)))[:total]
        count = Counter(i for _, i in ranked)
        assert {p[1]: got[group, p[1]] for p in own} == {p[1]: count[p[1]] for p in own}
    assert got["z", 1] == 0


def test_empty_tables(make_docs):
    assert mixing.mix_plan(make_docs([])).count() == 0
    assert mixing.mix(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix_plan(make_docs([(1, None), (2, " ")])).collect()] == [0, 0]

import math
import re
from collections import Counter, defaultdict

from tessarine.llm import divergence, queries

GAP = r"[\x20\x09-\x0D]+"
LOREM = "the rain in spain stays mainly in the plain and nobody minds it at all because umbrellas are cheap there".split()


def tokens(text):
    return [w for w in re.split(GAP, text) if w]


def plain(text):
    return tokens("".join(c for c in text if c not in "#*$%&|<>.,;:!?").lower())


def kind(c):
    import unicodedata

    category = unicodedata.category(c)
    if category in ("Ll", "Lu", "Nd"):
        return category
    return "mark" if c in ".,;:!?" else "space" if c in " \t\n\x0b\x0c\r" else "symbol" if c in "#*$%&|<>" else "rest"


def base(text):
    text = text or ""
    words = tokens(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    hit = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [line for line in text.split("\n") if tokens(line)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def distance(a, b):
    na, nb = sum(a.values()), sum(b.values())
    if not na or not nb:
        return None
    out = 0.0
    for x in set(a) | set(b):
        p, q = a[x] / na, b[x] / nb
        out += sum(s * math.log2(2 * s / (p + q)) for s in (p, q) if s)
    return math.sqrt(max(out / 2, 0))


def brute(rows):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        counts[lang].update(plain(text or ""))
    common = {k: set(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:32]) for k, c in counts.items()}
    held = [(base(t), Counter(map(kind, t or "")), Counter(w if w in common[g] else None for w in plain(t or "")), g) for _, t, g in rows]
    refs = defaultdict(lambda: (Counter(), Counter()))
    for b, classes, hits, lang in held:
        if not b[-1]:
            refs[lang][0].update(classes)
            refs[lang][1].update(hits)
    out = []
    for (doc_id, _, _), (b, classes, hits, lang) in zip(rows, held, strict=True):
        n = sum(hits.values())
        far = distance(classes, refs[lang][0]), distance(hits, refs[lang][1])
        strange = n >= 50 and None not in far and (far[0] ** 2 > 0.14**2 + 5 / n or far[1] ** 2 > 0.14**2 + 12 / n)
        out.append((doc_id, *b, not b[-1] and not strange))
    return sorted(out, key=str)


def found(df):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_rules_are_brute_force(make_docs):
    import random

    draw = random.Random(4)
    prose = [" ".join(draw.choice(LOREM) + str(draw.randrange(60)) * draw.randrange(2) for _ in range(draw.randint(0, 300))) + "." for _ in range(60)]
    rows = [(i, t, draw.choice(["en", "xx", None])) for i, t in enumerate(prose)]
    rows += [(70, None, "en"), (71, "", "en"), (72, " \n\t\x0b", None), (73, "é\n\né\n x \n x \nÉ 42", "xx"), (None, "a b c a b c", "en")]
    rows += [(80, " ".join(w.upper() + "###" for w in prose[1].split()), "en"), (81, "ab " * 5000, "en"), rows[2], rows[2]]
    rows += [(82, "\n".join(prose) * 20, "alone"), (83, "x" * 2_000_000, "en"), (84, "t " + " ".join(f"q{i}" for i in range(90)), "en")]
    docs = make_docs(rows, extra=("words", "hits", "classes", "kept", "n", "h", "i"))
    assert found(divergence.divergence(docs)) == brute(rows)


def test_strange_documents_are_rejected_and_clean_ones_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    got = found(queries.QUERIES["op12_rules"](spark, sf))
    assert got == brute(rows)
    assert sum(r[-1] for r in got) > 0.7 * len(got)


def test_empty_table(make_docs):
    assert divergence.divergence(make_docs([])).count() == 0
    assert found(divergence.divergence(make_docs([(1, None)]))) == [(1, 0, 0, 0, 0, 0, True, False)]


def test_no_python_and_no_shuffle_of_texts(make_docs):
    plan = divergence.counted(make_docs([(1, "a")]).selectExpr("*", "array('a') AS words"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_common_words_are_looked_up_by_place(spark, make_docs):
    """No list of words is compared one by one with the common words; odd words and marks are counted as before."""
    rows = [(1, "the The, a\x0b the. b,c %% (the) étè"), (2, " , the\n"), (3, ""), (4, None), (5, "x,y x y,")]
    words = spark.createDataFrame([(["the", "bc", "étè", "xy"],)], "words array<string>")
    docs = make_docs([(i, t, "en", "s") for i, t in rows]).na.fill("", ["text"])
    out = divergence.counted(docs.crossJoin(words))
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: list(r.hits) for r in out.collect()}
    for doc_id, text in rows:
        met = plain(text or "")
        hits = [met.count(w) for w in ("the", "bc", "étè", "xy")]
        assert got[doc_id] == [*hits, len(met) - sum(hits)]

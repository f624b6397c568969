import random

from tessarine.llm import lines


def expected(rows, window=2):
    """Windows seen before, in order of id; equal rows are one document."""
    out, seen = {}, set()
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        every = (text or "").split("\n")
        places = [i for i, x in enumerate(every) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for s in range(len(places) - window + 1):
            content = tuple(every[i].strip(" \t\r\x0b\x0c") for i in places[s : s + window])
            if content in seen:
                gone |= set(places[s : s + window])
            seen.add(content)
        kept = "\n".join(x for i, x in enumerate(every) if i not in gone)
        out[doc_id, text] = (kept if text is not None else None, len(places), len(gone))
    return sorted((repr((r[0], *out[r])) for r in rows))


def fixture():
    draw = random.Random(21)
    rows = []
    for i in range(90):
        chosen = [f"line {min(int(draw.expovariate(0.08)), 60)}" for _ in range(draw.randint(0, 14))]
        rows.append((i, "\n".join(x if draw.random() < 0.8 else f"  {x}\t" if draw.random() < 0.5 else x + "\n" for x in chosen)))
    rows += [(100, None), (101, ""), (102, "\n\n \n"), (None, "line 1\nline 2\nline 3"), rows[4], rows[4], (103, "x\nx\nx\nx"), (104, "x\nx")]
    return rows + [(105, "\n".join(f"long {k % 900}" for k in range(3000)))]


def test_runs_match_brute_force(make_docs):
    rows = fixture()
    for window in (2, 3):
        got = lines.drop_repeated_lines(make_docs(rows, extra=("h", "mark", "place", "anchor")), window)
        assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.columns[-2:] == ["lines", "deleted"]
        assert sorted(repr((r.doc_id, r.text, r.lines, r.deleted)) for r in got.collect()) == expected(rows, window)


def test_main_path_has_no_python(make_docs):
    plan = lines.drop_repeated_lines(make_docs([(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_clashing_counts(make_docs):
    assert lines.drop_repeated_lines(make_docs([])).count() == 0
    r = lines.drop_repeated_lines(make_docs([(1, "a\nb\nc\na\nb")], extra=("lines", "deleted"))).first()
    assert (r.text, r.lines, r.deleted) == ("a\nb\nc", 5, 2)


def test_long_lines_are_windows_of_their_own(make_docs):
    def passage(k, n):
        return " ".join(f"p{k}w{i}" for i in range(n))

    rows = [(i, f"before {i}\n  {passage(i % 3, 50)}\t\nafter {i}") for i in range(9)]
    rows += [(20 + i, passage(i % 2, 50)) for i in range(4)] + [(30, f"{passage(7, 49)}\nx"), (31, f"{passage(7, 49)}\ny")]
    rows += [(40, passage(8, 60) + "\n\n" + passage(8, 60)), (50, None), (51, "")]
    seen, want = set(), []
    for doc_id, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            words = tuple(line.split())
            if len(words) < 50 or words not in seen:
                kept.append(line)
            seen.add(words)
        want.append((doc_id, "\n".join(kept) if text is not None else None))
    got = lines.drop_repeated_lines(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id != 40) == [w for w in want if w[0] != 40]
    assert {r.doc_id: r.deleted for r in got}[40] == 1 and sum(r.deleted for r in got) == 6 + 4 + 1
    only = lines.drop_repeated_lines(make_docs(rows), long_words=None).collect()
    assert sum(r.deleted for r in only) == 0

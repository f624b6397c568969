import hashlib
import random
import zlib

import pytest

from tessarine.llm import conversations, queries
from tessarine.llm.auction import ENDING, Lattice, Step

MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SCHEMA = "conv_id long, turn long, role string, text string"


def hurt(rows):
    """Rows after damage, and all conversation ids."""
    out, ids = [], set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out, ids


def best_edits(rows):
    """Cheapest and then least edits by trying all of them from the end: rows are (initial or None, truncated)."""
    table = {}
    for at in range(len(rows), -1, -1):
        found = {}
        for state in range(4):
            ways = []
            if at == len(rows):
                if state in (0, 3):
                    ways.append((0, ""))
            else:
                initial, cut = rows[at]
                ways.append((4 + table[at + 1, state][0], "D" + table[at + 1, state][1]))
                if initial is not None:
                    if (state, initial) in MOVES:
                        rest = table[at + 1, MOVES[state, initial]]
                        ways.append((3 * cut + rest[0], "K" + rest[1]))
                    for role in "ua":
                        if (state, role) in MOVES:
                            rest = table[at + 1, MOVES[state, role]]
                            ways.append((3 + 3 * cut + rest[0], "R" + rest[1]))
            found[state] = min(ways, default=(10**9, ""))
        for _ in range(4):
            for state in range(4):
                for role in "ua":
                    if (state, role) in MOVES:
                        rest = found[MOVES[state, role]]
                        found[state] = min(found[state], (3 + rest[0], "I" + rest[1]))
        for state in range(4):
            table[at, state] = found[state]
    return table[0, 0]


def brute(rows):
    after, ids = hurt(rows)
    out = {}
    for conv in ids:
        own = [r for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, blank, duplicate, truncated, steps = set(), 0, 0, 0, []
        for _, _, role, text in own:
            shown = text.strip(" \t\n\r\x0b\x0c")
            if not shown:
                blank += 1
                steps.append((None, False))
            elif (role, text) in seen:
                duplicate += 1
                steps.append((None, False))
            else:
                truncated += shown[-1] not in ".!?"
                steps.append((role[:1], shown[-1] not in ".!?"))
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = best_edits(steps)
        state, lines, queue = 0, [], iter(own)
        for letter in audit:
            role, text = ("assistant" if state == 2 else "user"), ""
            if letter != "I":
                _, _, had, text = next(queue)
                if letter == "D":
                    continue
                role = had if letter == "K" else role
            lines.append(f"{role}:{text}")
            state = MOVES[state, role[0]]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)
    return out


def rows_of(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = df.collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r[n] for n in names) for r in found}


def sample(n, seed):
    draw, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "cut", " ", "", None, "Why?", "a\nb. ", "é.", "end\x0b", " "]
    for conv in range(n):
        for turn in range(draw.choice([1, 1, 2, 4, 5, 9])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            at = draw.choice([turn, turn, turn, turn * 3, None, -turn])
            rows.append((conv, at, role, draw.choice(texts) if draw.random() < 0.7 else f"t{draw.randrange(99)}."))
    rows += [(None, t, "user", f"t{t}.") for t in range(6)] + rows[:3]
    return rows


@pytest.mark.parametrize("stretch", [4096, 2])
def test_repair_is_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(conversations, "STRETCH_ROWS", stretch)
    rows = sample(120, stretch)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "'x' AS audit", "0 AS ends")
    assert rows_of(conversations.repair(conversations.damaged(df))) == brute(rows)


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want = brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(queries.QUERIES["op13_conversations"](spark, sf)) == want


def test_one_long_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "STRETCH_ROWS", 50)
    draw = random.Random(5)
    rows = [(7, t, draw.choice(["user", "assistant", "system"]), draw.choice(["ok.", f"t{t}.", f"t{t}", "x" * 100_000 + "."])) for t in range(900)]
    assert rows_of(conversations.repair(conversations.damaged(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_empty_table_and_all_dropped(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = rows_of(conversations.repair(conversations.damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA))))
    assert found == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_prices_are_distances():
    draw = random.Random(9)
    for _ in range(300):
        steps = [Step(draw.choice(["s", "u", "a", "t", None]), draw.random() < 0.3) for _ in range(draw.randrange(9))]
        lattice = Lattice(tuple(steps), ENDING, True)
        cost, audit = best_edits([(s.initial, s.cut) for s in steps])
        assert (lattice.distance(0), lattice.trace(0)[0]) == (cost, audit)

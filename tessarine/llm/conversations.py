"""Repair conversations to the form `(s?(ua)+)?` of role initials by the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm.auction import ENDING, FREE, STATES, Lattice, Step, ahead, crossing, wanted
from tessarine.llm.common import per_process, stored

#: Role initials that may follow each other, and what six characters are blank.
LEGAL = ("su", "ua", "au")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

#: A stretch of a conversation ends after so many rows or characters.
STRETCH_ROWS, STRETCH_CHARS = 4096, 4 << 20
KEPT_LATTICES = 1 << 15

ROLE = {"u": "user", "a": "assistant"}
COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = [("gaps", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
KINDS = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int"}


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` (nulls of role and text: one space) with rows damaged by crc32(`conv_id:turn`) % 20; `gone` marks dropped rows.

    0 drops the row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4 makes its role `user`.
    A null in the hashed key is one space too.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        kind.alias("kind"),
    )
    copies = F.when(F.col("kind") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number `n`, whether the first of them is `new`, dealt in order over partitions.

    A conversation's rows ascend by turn (nulls first), role and md5 of the text. The ranges are cut within
    a conversation too, so a long one is many tasks. Dropped rows stay as one row of n = 0, so that no
    conversation is lost.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False))
    rows = rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, F.lit("")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(gone, F.lit("")).otherwise(F.coalesce("text", F.lit(" "))).alias("text"),
        F.when(gone, 0).otherwise(1).alias("one"),
    ).withColumn("digest", F.when(F.col("one") == 1, F.md5("text")).otherwise(""))
    merged = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("one").alias("n"), F.any_value("text").alias("text"))
    merged = stored(merged, "conversation-rows")
    again = merged.where("n > 0").groupBy("conv_id", "role", "digest")
    # Null turns come first and count as the least; only what stands in several turns is joined.
    again = again.agg(F.count(F.lit(1)).alias("turns"), F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("first")).where("turns > 1")
    left, right = merged.alias("l"), again.alias("r")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.role") == F.col("r.role")) & (F.col("l.digest") == F.col("r.digest"))
    new = F.col("r.first").isNull() | F.col("r.first.turn").eqNullSafe(F.col("l.turn"))
    rows = left.join(right, same, "left").select("l.*", new.alias("new"))
    order = ["conv_id", "turn", "role", "digest"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")


class Stretch:
    """Consecutive rows of one conversation: counts, the rows of its lattice and the lines that may stay."""

    def __init__(self) -> None:
        self.steps: list[Step] = []
        self.roles: list[str | None] = []
        self.texts: list[str | None] = []
        self.chars = self.turns = 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.first = self.final = None

    def add(self, turn: int | None, role: str, text: str, n: int, new: bool) -> None:
        """Take `n` equal rows of a turn, of which the first is `new` if none equals it before."""
        if n == 0:
            return
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.counts["illegal"] += self.final + initial not in LEGAL
        self.counts["illegal"] += (n - 1) * (initial + initial not in LEGAL)
        self.final = initial
        shown = text.strip(SPACES)
        if not shown:
            self.counts["blank"] += n
            self._step(Step(None, copies=n), None, None)
            return
        if new:
            cut = shown[-1] not in ".!?"
            self.counts["truncated"] += cut
            self._step(Step(initial, cut), role, text)
        if n > new:
            self.counts["duplicate"] += n - new
            self._step(Step(None, copies=n - new), None, None)

    def _step(self, step: Step, role: str | None, text: str | None) -> None:
        self.steps.append(step)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text or "")

    def full(self) -> bool:
        return len(self.steps) >= STRETCH_ROWS or self.chars >= STRETCH_CHARS


def lines_of(letters: str, state: int, steps: tuple[Step, ...], roles: list, texts: list) -> Iterator[bytes]:
    """`role:text` of each row that a stretch has after its edits, beginning in `state`."""
    at = iter(range(len(steps)))
    left = 0
    for letter in letters:
        if letter == "I":
            role, text = ROLE[wanted(state)], ""
        elif letter == "D":
            # One step may stand for several rows to delete.
            if left == 0:
                step = steps[next(at)]
                left = step.copies if step.initial is None else 1
            left -= 1
            continue
        else:
            row = next(at)
            role, text = roles[row] if letter == "K" else ROLE[wanted(state)], texts[row]
        state = after(state, role[:1])
        yield f"{role}:{text}".encode()


def after(state: int, initial: str) -> int:
    """State that a row which stays leads to."""
    return {"s": 1, "u": 2, "a": 3}[initial]


def repaired_by(pieces: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for number, piece in enumerate(pieces):
        digest.update(b"\n" + piece if number else piece)
    return digest.hexdigest()


def _schema(fields: list) -> tuple[pa.Schema, str]:
    """Arrow schema of (name, type) fields, and Spark's."""

    def kind(t: pa.DataType) -> str:
        return f"array<{kind(t.value_type)}>" if pa.types.is_list(t) else KINDS[t]

    return pa.schema(fields), ", ".join(f"{name} {kind(t)}" for name, t in fields)


PLACE = [("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32())]
SUMMARY = [(name, pa.int64()) for name in ("low", "high", "turns", *COUNTS)] + [("first", pa.string()), ("final", pa.string())]
STEPS = [("initials", pa.list_(pa.string())), ("cuts", pa.list_(pa.bool_())), ("copies", pa.list_(pa.int64()))]
LINES = [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
BEHIND = [("ends", pa.list_(pa.int64())), ("last", pa.bool_())]
TRACED = [("letters", pa.list_(pa.string())), ("states", pa.list_(pa.int32())), ("cost", pa.int64())]
#: Costs travel as integers; this stands for FREE.
NONE = -1


def _batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most 1,000 rows or some MB of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(t or "") for t in row.get("texts") or ())
        if len(held) >= 1000 or size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            yield from batch.slice(start, 512).to_pylist()


def _encoded(costs) -> list[int]:
    return [NONE if cost == FREE else int(cost) for cost in costs]


def _decoded(costs) -> tuple[float, ...]:
    return tuple(FREE if cost == NONE else cost for cost in costs)


def _steps(row: dict) -> tuple[Step, ...]:
    return tuple(Step(*step) for step in zip(row["initials"], row["cuts"], row["copies"], strict=True))


def _lattices():
    """Solved whole conversations by their steps, the last ones used; most conversations look like others."""
    return per_process(("conversation-lattices", KEPT_LATTICES), lambda: lru_cache(KEPT_LATTICES)(_solved))


def _solved(steps: tuple[Step, ...]) -> tuple[int, str]:
    lattice = Lattice(steps, ENDING, True)
    return int(lattice.distance(0)), lattice.trace(0)[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair conversations that lie whole in one stretch; hand on the stretches of all others."""
    part, solved = TaskContext.get().partitionId(), _lattices()
    schema, _ = _schema(STRETCHES)

    def open_row(conv_id: int | None, number: int, s: Stretch) -> dict:
        steps = tuple(s.steps)
        matrix = crossing(steps)
        return {
            "conv_id": conv_id, "part": part, "number": number, "low": s.low, "high": s.high, "turns": s.turns, **s.counts, "first": s.first,
            "final": s.final, "initials": [x.initial for x in steps], "cuts": [x.cut for x in steps], "copies": [x.copies for x in steps],
            "roles": s.roles, "texts": s.texts, "matrix": _encoded(chain(*matrix)),
        }

    def whole_row(conv_id: int | None, s: Stretch) -> dict:
        steps = tuple(s.steps)
        cost, audit = solved(steps)
        gaps = 0 if s.low is None else s.high - s.low + 1 - s.turns
        sha = repaired_by(lines_of(audit, 0, steps, s.roles, s.texts))
        return {"conv_id": conv_id, "gaps": gaps, **s.counts, "cost": cost, "audit": audit, "repaired_sha256": sha}

    def results() -> Iterator[dict]:
        held, current, number, first = None, None, 0, True
        for batch in batches:
            for conv_id, turn, role, text, n, new in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "new")), strict=True):
                if held is None or conv_id != current:
                    if held is not None:
                        yield open_row(current, number, held) if first or number else whole_row(current, held)
                        first = False
                    held, current, number = Stretch(), conv_id, 0
                elif held.full():
                    yield open_row(current, number, held)
                    held, number = Stretch(), number + 1
                held.add(turn, role, text, n, new)
        if held is not None:  # the conversation may go on in the next partition
            yield open_row(current, number, held)

    yield from _batched(results(), schema)


STRETCHES = [*PLACE, *SUMMARY, *STEPS, *LINES, ("matrix", pa.list_(pa.int64())), *((n, t) for n, t in RESULT if n not in COUNTS)]


def _look_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each conversation's last stretch backwards: what going on behind each stretch costs."""
    schema, _ = _schema([*PLACE, *BEHIND])

    def results() -> Iterator[dict]:
        current, ends = (), ENDING
        for row in _rows(batches):
            last = current != (row["conv_id"],)
            if last:
                current, ends = (row["conv_id"],), ENDING
            yield {**{c: row[c] for c, _ in PLACE}, "ends": _encoded(ends), "last": last}
            flat = _decoded(row["matrix"])
            if last:  # behind the last row rows may be inserted: from u an answer, from 0 and s nothing or a pair
                ends = tuple(Lattice((), ENDING, True).price[:STATES])
            ends = ahead(tuple(flat[i : i + STATES] for i in range(0, len(flat), STATES)), ends)

    yield from _batched(results(), schema)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest edits of a stretch from each state that it may begin in, and the state each ends in."""
    schema, _ = _schema([*PLACE, *SUMMARY, *STEPS, *LINES, *TRACED])

    def results() -> Iterator[dict]:
        for row in _rows(batches):
            lattice = Lattice(_steps(row), _decoded(row.pop("ends")), row.pop("last"))
            ways = [lattice.trace(s) if lattice.distance(s) < FREE else (None, None) for s in range(STATES)]
            yield {**row, "letters": [w[0] for w in ways], "states": [w[1] for w in ways], "cost": lattice.distance(0)}

    yield from _batched(results(), schema)


class Walk:
    """The repair of one conversation, put together from its stretches in order; only its audit grows."""

    def __init__(self, first: dict) -> None:
        self.conv_id, self.cost = first["conv_id"], int(first["cost"])
        self.counts = dict.fromkeys(COUNTS, 0)
        self.digest, self.letters, self.state, self.lines = hashlib.sha256(), [], 0, 0
        self.low = self.high = self.final = None
        self.turns = 0

    def add(self, row: dict) -> None:
        for name in COUNTS:
            self.counts[name] += row[name]
        if row["first"] is not None:
            self.counts["illegal"] += self.final is not None and self.final + row["first"] not in LEGAL
            self.final = row["final"]
        if row["low"] is not None:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        way = row["letters"][self.state]
        self.letters.append(way)
        for line in lines_of(way, self.state, _steps(row), row["roles"], row["texts"]):
            self.digest.update(b"\n" + line if self.lines else line)
            self.lines += 1
        self.state = row["states"][self.state]

    def result(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        found = {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": self.cost}
        return found | {"audit": "".join(self.letters), "repaired_sha256": self.digest.hexdigest()}


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk through the stretches of each conversation in order."""
    schema, _ = _schema([("conv_id", pa.int64()), *RESULT])

    def results() -> Iterator[dict]:
        walk = None
        for row in _rows(batches):
            if walk is None or walk.conv_id != row["conv_id"]:
                if walk is not None:
                    yield walk.result()
                walk = Walk(row)
            walk.add(row)
        if walk is not None:
            yield walk.result()

    yield from _batched(results(), schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair and the digest of the repaired rows.

    `rows` has (conv_id, turn, role, text); rows with a true `gone` only keep their conversation in the
    result. Rows stand by turn (nulls first), then role, then md5 of the text. Null roles and texts are one
    space, a null conv_id is a conversation like any other, other columns are ignored, an empty table
    gives an empty table. Blank rows and rows equal in role and text to an earlier one must go.

    Rows are dealt by ranges that also cut conversations. A conversation within one range and stretch is
    repaired where it lies, the audit being the shortest path that an auction finds in its lattice. Of
    the others each stretch of at most 4,096 rows gives its costs between the four states; these are
    added up from the end (one small row per stretch), every stretch is traced from the four states by
    itself, and a last walk in order puts texts and letters into digest and audit, which a digest
    over the whole conversation needs. No task holds more than a stretch, save for the audit.
    """
    cut = stored(_ranked(rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))).mapInArrow(_cut, _schema(STRETCHES)[1]), "stretches")
    place = [name for name, _ in PLACE]
    whole = cut.where("part IS NULL").select("conv_id", *(name for name, _ in RESULT))
    parts = cut.where("part IS NOT NULL")
    back = parts.select(*place, "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
    back = back.mapInArrow(_look_back, _schema([*PLACE, *BEHIND])[1])
    columns = [name for name, _ in [*PLACE, *SUMMARY, *STEPS, *LINES]]
    # (part, number) may belong to one stretch of each conversation of a partition, so the conversation is compared too.
    same = [F.col("l.part") == F.col("r.part"), F.col("l.number") == F.col("r.number"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))]
    known = parts.alias("l").join(back.alias("r"), same).select(*(f"l.{c}" for c in columns), "r.ends", "r.last")
    traced = known.mapInArrow(_trace, _schema([*PLACE, *SUMMARY, *STEPS, *LINES, *TRACED])[1])
    in_order = traced.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return whole.unionByName(in_order.mapInArrow(_join, _schema([("conv_id", pa.int64()), *RESULT])[1]))

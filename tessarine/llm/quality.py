"""Quality classifier from weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm.common import pieces, stored

BUCKETS = 1 << 12
SAMPLE = 16_384
STRETCH = 5000
REJECT = 0.5
BAD, GOOD, SILENT = 0, 1, 2

#: Shape of a byte: capital, small letter (all bytes beyond ASCII too), digit, or itself.
SHAPES = bytes(
    ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in range(256)
)
RUNS = re.compile(rb"([Xx9])\1+")
PLAIN = b".,;:'\"-?()"


@dataclass
class Traits:
    """What the labellers look at."""

    words: int
    letters: int
    capitals: int
    symbols: int
    marks: int
    bare: int
    distinct: int
    closed: int
    tails: int
    stutters: int
    lines: int
    distinct_lines: int
    varied: int


def _varied(own: list[bytes]) -> int:
    """Distinct words of each of the equal stretches of at most STRETCH words that make up a text, summed."""
    parts = -(-len(own) // STRETCH)
    return sum(len(set(own[k * len(own) // parts : (k + 1) * len(own) // parts])) for k in range(parts))


def shapes(text: str) -> tuple[Counter, Traits]:
    """Counts of word shapes (runs of letters or digits as one sign), and the traits of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    own = raw.split()
    signs = raw.translate(SHAPES)
    capitals, small, digits = signs.count(b"X"), signs.count(b"x"), signs.count(b"9")
    spaces = sum(raw.count(bytes([c])) for c in b" \t\n\r\x0b\x0c")
    plain = sum(raw.count(bytes([c])) for c in PLAIN)
    found = Counter(RUNS.sub(rb"\1", signs).split())
    bare = sum(n for s, n in found.items() if not (b"x" in s or b"X" in s or b"9" in s))
    closed = sum(n for s, n in found.items() if s[-1:] in b".!?" and s[:-1].isalnum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    marks = raw.count(b"!")
    tails = sum(n for s, n in found.items() if not (s[-1:].isalnum() or s[-1] in PLAIN or s[-1:] == b"!"))
    stutters = sum(map(eq, own, own[1:]))
    symbols = len(raw) - capitals - small - digits - spaces - plain - marks
    return found, Traits(len(own), capitals + small, capitals, symbols, marks, bare, len(set(own)), closed, tails, stutters, len(lines), len(set(lines)), _varied(own))


def _between(value: float, good: float, bad: float) -> int:
    """Vote on a share that is bad when high."""
    return BAD if value > bad else GOOD if value < good else SILENT


#: Labellers by name: each votes good or bad, or is silent where its trait tells nothing.
LABELLERS = {
    "capitals": lambda t: SILENT if t.letters < 20 else _between(t.capitals / t.letters, 0.2, 0.5),
    "symbols": lambda t: SILENT if t.words < 5 else _between(t.symbols / t.words, 0.1, 0.3),
    "exclamation": lambda t: SILENT if t.words < 5 else _between(t.marks / t.words, 0.05, 0.3),
    "bare": lambda t: SILENT if t.words < 5 else _between(t.bare / t.words, 0.05, 0.2),
    "variety": lambda t: SILENT if t.words < 50 else _between(1 - t.varied / t.words, 0.65, 0.85),
    "sentences": lambda t: SILENT if t.words < 20 else GOOD if 0.02 <= t.closed / t.words <= 0.4 else BAD if t.closed / t.words < 0.005 else SILENT,
    "lines": lambda t: SILENT if t.lines < 4 else _between(1 - t.distinct_lines / t.lines, 0.3, 0.6),
    "tails": lambda t: SILENT if t.words < 5 else _between(t.tails / t.words, 0.1, 0.3),
    "stutter": lambda t: SILENT if t.words < 5 else _between(t.stutters / t.words, 0.1, 0.3),
}


def features(found: Counter, t: Traits) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shapes of a text with the square roots of their shares, and hashed levels of its traits."""
    total, seen = sum(found.values()), Counter()
    for shape, n in found.items():
        seen[zlib.crc32(shape[:12]) % BUCKETS] += n
        seen[zlib.crc32(b"end" + shape[-2:]) % BUCKETS] += n
    out = {k: math.sqrt(n / total) for k, n in seen.items()}
    if t.words:
        shares = {"distinct": t.distinct / t.words, "stutter": t.stutters / t.words, "closed": t.closed / t.words}
        shares |= {"lines": t.distinct_lines / t.lines, "size": min(math.log10(t.words) / 5, 1)}
        for name, share in shares.items():
            out[zlib.crc32(f"{name} {round(10 * share)}".encode()) % BUCKETS] = 1.0
    return np.fromiter(out, dtype=np.int32, count=len(out)), np.fromiter(out.values(), dtype=np.float32, count=len(out))


@dataclass
class LabelModel:
    """Share of good documents, and the chances of each spoken vote of each labeller given bad and given good."""

    good: float
    votes: np.ndarray  # labeller, truth, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of good for rows of votes; silence says nothing."""
        silent = np.zeros((*self.votes.shape[:2], 1))
        logs = np.concatenate([np.log(self.votes), silent], axis=2)
        total = np.log([1 - self.good, self.good]) + sum(logs[k][:, patterns[:, k]].T for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Chance that a labeller that speaks is right, bad and good documents counting alike."""
        return (self.votes[:, 0, BAD] + self.votes[:, 1, GOOD]) / 2


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    A labeller knows one kind of fault, so the first belief is that any bad vote tells a bad
    document. A pseudo-count of one for each vote keeps chances above 0.
    """
    belief, model = np.where((patterns == BAD).any(axis=1), 0.1, 0.95), None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - belief), counts * belief])
        votes = [[[weight[z][patterns[:, k] == v].sum() + 1 for v in (BAD, GOOD)] for z in (0, 1)] for k in range(patterns.shape[1])]
        votes = np.array(votes)
        model = LabelModel(float((weight[1].sum() + 1) / (weight.sum() + 2)), votes / votes.sum(axis=2, keepdims=True))
        belief = model.posterior(patterns)
    return model


def read_traits(docs: DataFrame) -> DataFrame:
    """(doc_id, votes, at, value) of every document: one vote per labeller, and the hashed features."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            votes, at, value = [], [], []
            for text in batch.column("text").to_pylist():
                found, traits = shapes(text or "")
                votes.append([vote(traits) for vote in LABELLERS.values()])
                own = features(found, traits)
                at.append(own[0])
                value.append(own[1])
            kinds = (pa.int32(), pa.int32(), pa.float32())
            lists = [pa.array(x, pa.list_(kind)) for x, kind in zip((votes, at, value), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "votes", "at", "value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, votes array<int>, at array<int>, value array<float>")


def fit_scorer(at: list, value: list, belief: np.ndarray, rounds: int = 300, rate: float = 0.5) -> np.ndarray:
    """Weights (the bias last) of a logistic scorer for soft labels; both classes weigh the same."""
    rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
    columns, values = (np.concatenate(x) if len(x) else np.empty(0) for x in (at, value))
    columns, weights, taken = columns.astype(np.intp), np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    share = min(max(float(belief.mean()), 1e-3), 1 - 1e-3) if len(belief) else 0.5
    balance = (belief / share + (1 - belief) / (1 - share)) / 2 / max(len(belief), 1)
    for _ in range(rounds if len(at) else 0):
        scores = np.bincount(rows, weights=weights[columns] * values, minlength=len(at)) + weights[-1]
        error = (belief - 1 / (1 + np.exp(-scores))) * balance
        step = np.bincount(columns, weights=error[rows] * values, minlength=BUCKETS + 1)
        step[-1] = error.sum()
        taken += step**2
        weights += rate * step / np.sqrt(taken)
    return weights


def fit(traits: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray]:
    """Label model from the vote patterns of all documents, and scorer from a bounded sample of them.

    The driver receives one row per pattern (three votes for each labeller bound their number) and the
    features, not the texts, of about `sample` documents drawn by hash of their features.
    """
    found = traits.groupBy("votes").count().toArrow()
    patterns = np.array(found.column("votes").to_pylist(), dtype=np.intp).reshape(-1, len(LABELLERS))
    counts = found.column("count").to_numpy()
    order = np.lexsort(patterns.T)
    labels = label_model(patterns[order], counts[order])
    total = max(int(counts.sum()), 1)
    drawn = F.pmod(F.xxhash64("doc_id", "at", "value"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total))
    rows = traits.where(drawn).select("votes", "at", "value").toArrow()
    votes = np.array(rows.column("votes").to_pylist(), dtype=np.intp).reshape(-1, len(LABELLERS))
    return labels, fit_scorer(rows.column("at").to_pylist(), rows.column("value").to_pylist(), labels.posterior(votes))


def quality_scores(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, keep, label_score, votes) of every document.

    `votes` are the labellers' (0 bad, 1 good, 2 silent), `label_score` is the label model's chance of
    good, `score` the scorer's, and `keep` whether that reaches REJECT. Features are hashed word
    shapes and trait levels, so no word of a text counts as such. A null text is an empty one, on which
    all are silent; repeated rows stay; an empty table gives an empty table; other columns are ignored.
    """
    traits = stored(read_traits(docs), "quality-traits")
    labels, weights = fit(traits, sample)
    shared = docs.sparkSession.sparkContext.broadcast((labels, weights))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, weights = shared.value
        for batch in batches:
            votes = np.array(batch.column("votes").to_pylist(), dtype=np.intp).reshape(-1, len(LABELLERS))
            scores = [_score(a.values.to_numpy(), v.values.to_numpy(), weights) for a, v in zip(batch.column("at"), batch.column("value"), strict=True)]
            arrays = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(labels.posterior(votes)), batch.column("votes")]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "label_score", "votes"])

    scored = traits.mapInArrow(task, "doc_id long, score double, label_score double, votes array<int>")
    return scored.select("doc_id", "score", (F.col("score") >= REJECT).alias("keep"), "label_score", "votes")


def _score(at: np.ndarray, value: np.ndarray, weights: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(weights[at] @ value) + weights[-1]))))


def drop_low_quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that `quality_scores` keeps, in the columns of `docs`; rows are judged where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(stored(read_traits(docs), "quality-traits"), sample)[1])
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (features(*shapes(t.as_py() or "")) for t in batch.column(place))
            yield batch.filter(pa.array([_score(a, v, shared.value) >= REJECT for a, v in own], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)

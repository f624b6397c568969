"""Find and drop documents that hold benchmark items, by SimHash of item-sized windows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm.common import pieces, words

SHINGLE = 5
RADIUS = 20
SHORT = 6
BLOCKS = 8
BLOCK_BYTES = 32 << 20
FILTER_BITS = 20


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """One well-mixed 64-bit hash for every run of `size` words."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def hash_words(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def window_prints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash fingerprints of the windows of `size` shingles at `starts` (ascending)."""
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), 4096):
        some = starts[at : at + 4096]
        low, high = int(some[0]), int(some[-1]) + size
        if high - low > 8 * len(some) * size:  # far apart: each on its own
            rows = hashes[some[:, None] + np.arange(size)]
            bits = np.unpackbits(rows.view(np.uint8).reshape(len(some), size, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int32)
        else:
            bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            run = np.zeros((len(bits) + 1, 64), dtype=np.int32)
            np.cumsum(bits, axis=0, out=run[1:])
            bits = run[some - low + size] - run[some - low]
        out[at : at + len(some)] = np.packbits(bits * 2 > size, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def similarity(one: Counter, two: Counter) -> float:
    """Weighted Jaccard similarity of shingle counts."""
    shared = sum(min(n, two[s]) for s, n in one.items())
    total = one.total() + two.total() - shared
    return shared / total if total else 0.0


def shingles(tokens: list[bytes]) -> Counter:
    size = min(SHINGLE, len(tokens))
    return Counter(zip(*(tokens[k:] for k in range(size)), strict=False)) if size else Counter()


@dataclass
class Lengths:
    """The items of one length in words: their shingle hashes, fingerprints and a multi-index over blocks of bits."""

    size: int
    items: list[int]
    counts: list[Counter]
    hashes: np.ndarray
    prints: np.ndarray
    near: list[list[np.ndarray]] = field(default_factory=list)

    def index(self, radius: int) -> None:
        """For each block and each value of it, the items whose block differs in radius // BLOCKS bits at most.

        Two fingerprints within the radius differ by no more than that in one of the blocks.
        """
        width, most = 64 // BLOCKS, radius // BLOCKS
        values = np.arange(1 << width, dtype=np.uint64)
        for k in range(BLOCKS):
            own = (self.prints >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
            close = np.bitwise_count(values[:, None] ^ own[None, :]) <= most
            self.near.append([np.flatnonzero(row) for row in close])

    def candidates(self, prints: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
        """(window, item) pairs whose fingerprints differ by the radius at most."""
        width = 64 // BLOCKS
        for w, fp in enumerate(prints.tolist()):
            found = np.unique(np.concatenate([self.near[k][fp >> (k * width) & ((1 << width) - 1)] for k in range(BLOCKS)]))
            close = np.bitwise_count(self.prints[found] ^ np.uint64(fp)) <= radius
            for item in found[close].tolist():
                yield w, item


class Benchmark:
    """A bounded block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], radius: int):
        by_size: dict[int, list] = {}
        for item, text in items:
            tokens = words(text)
            if tokens:
                by_size.setdefault(len(tokens), []).append((item, tokens))
        self.radius, self.lengths, marks = radius, [], []
        for size, found in sorted(by_size.items()):
            own = [shingle_hashes(hash_words(t), min(SHINGLE, size)) for _, t in found]
            prints = np.array([window_prints(h, np.array([0]), len(h))[0] for h in own], dtype=np.uint64)
            part = Lengths(size, [i for i, _ in found], [shingles(t) for _, t in found], np.unique(np.concatenate(own)), prints)
            part.index(radius)
            self.lengths.append(part)
            marks.append(part.hashes)
        self.sizes = sorted({min(SHINGLE, part.size) for part in self.lengths})
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        if marks:
            self.filter[np.concatenate(marks) & np.uint64((1 << FILTER_BITS) - 1)] = True

    def matches(self, text: str | None, threshold: float) -> dict[int, tuple[float, int, int]]:
        """For each item found, the greatest similarity of a window and its first place: (similarity, start, end)."""
        tokens, out = words(text), {}
        word_hashes = hash_words(tokens)
        # No more shingles than this can an item have and be similar: those of the text are at most all shared.
        longest = max(len(tokens), math.floor((len(tokens) - SHINGLE + 1) / threshold + 1e-9) + SHINGLE - 1)
        for shingle in self.sizes:
            hashes = shingle_hashes(word_hashes, shingle)
            hits = np.flatnonzero(self.filter[hashes & np.uint64((1 << FILTER_BITS) - 1)])
            if not len(hits):
                continue
            seen = hashes[hits]
            for part in self.lengths:
                if min(SHINGLE, part.size) != shingle or part.size > longest:
                    continue
                at = np.minimum(np.searchsorted(part.hashes, seen), len(part.hashes) - 1)
                own = hits[part.hashes[at] == seen]
                if not len(own):
                    continue
                size = min(part.size, len(tokens))  # a text shorter than the item is its only window
                span = size - shingle + 1
                starts = (own[:, None] - np.arange(span)).ravel()
                starts = np.unique(starts[(starts >= 0) & (starts <= len(tokens) - size)])
                prints = window_prints(hashes, starts, span)
                if size < part.size:  # one window needs no index; short ones stray further
                    close = np.bitwise_count(part.prints ^ prints[0]) <= self.radius + SHORT if len(prints) else []
                    pairs = ((0, item) for item in np.flatnonzero(close).tolist())
                else:
                    pairs = part.candidates(prints, self.radius)
                for w, item in pairs:
                    start = int(starts[w])
                    found = similarity(shingles(tokens[start : start + size]), part.counts[item])
                    key = part.items[item]
                    if found >= threshold and (key not in out or found > out[key][0]):
                        out[key] = (found, start, start + size)
        return out


def benchmark_blocks(items: DataFrame, radius: int) -> Iterator[Benchmark]:
    """The items in blocks of about BLOCK_BYTES of text, one after the other."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        found = block.toArrow().to_pylist()
        yield Benchmark(sorted(((r["item_id"], r["text"]) for r in found), key=repr), radius)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """Matches (doc_id, item_id, similarity, start_word, end_word): each document's best window for each item.

    Words are compared with A-Z in lower case. Windows have the item's number of words and are
    compared by five-word shingles with their counts (a shorter item is one shingle); a document shorter than the
    item is one window. A window that shares no shingle with an item of its
    length has similarity 0, so only the others get a fingerprint; blocks of bits then give every item
    within `radius` of it, and exact weighted Jaccard similarity decides. Fingerprints of windows at
    0.8 differ in about 10 of 64 bits, so the radius of 20 is over three deviations beyond.

    The benchmark is read in blocks of bounded size and every block meets all documents; nothing is
    shuffled. Null or blank documents and items match nothing; items with equal ids count as
    one item; repeated rows stay; empty tables give no match; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in benchmark_blocks(items, radius):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                found = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for item, (value, start, end) in shared.value.matches(text, threshold).items():
                        found.append({"doc_id": doc_id, "item_id": item, "similarity": value, "start_word": start, "end_word": end})
                yield pa.RecordBatch.from_pylist(found, schema=MATCHES)

        part = rows.mapInArrow(task, "doc_id long, item_id long, similarity double, start_word long, end_word long")
        out = part if out is None else out.unionAll(part)
    return out


MATCHES = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]
)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The documents without a match, in the columns of `docs`; each block of items filters where rows are."""
    for block in benchmark_blocks(items, radius):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        place = docs.columns.index("text")

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not shared.value.matches(text.as_py(), threshold) for text in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
    return docs

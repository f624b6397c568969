"""SimHash near-duplicates by an exact, tiled comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine.llm.common import pieces, row_key, small_batches, stored, words
from tessarine.llm.components import components, forest
from tessarine.llm.decontaminate import hash_words, shingle_hashes

SEED = 42
TILE = 4096


def fingerprint(tokens: list[bytes], size: int = 3) -> int:
    """64-bit SimHash of a word sequence: bit set if set in over half the shingle hashes; 0 without words."""
    if not tokens:
        return 0
    n = min(size, len(tokens))
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(n)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    held = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(held, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, row, fp) of every document; fp is the fingerprint as a signed long, row the row's identity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = [fingerprint(words(t), size) for t in batch.column("text").to_pylist()]
            prints = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), prints], ["doc_id", "row", "fp"])

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("row"), text.alias("text")).mapInArrow(
        task, "doc_id long, row string, fp long"
    )


def _cell(fp: Column, blocks: int) -> Column:
    """Population counts of the fingerprint's equal blocks, five bits each, offset so that steps of 2 never borrow."""
    width = 64 // blocks
    mask = F.lit((1 << width) - 1)
    code = F.lit(0).cast("long")
    for k in range(blocks):
        count = F.bit_count(F.shiftrightunsigned(fp, k * width).bitwiseAND(mask)) + 2
        code = code + F.shiftleft(count.cast("long"), 5 * k)
    return code


def _steps(blocks: int, radius: int) -> list[int]:
    """Code differences of all cells within `radius`, each unordered pair of cells once, 0 included."""
    found = {(): 0}
    for k in range(blocks):
        found = {
            (*step, d): spent + abs(d)
            for step, spent in found.items()
            for d in range(-radius, radius + 1)
            if spent + abs(d) <= radius
        }
    zero = (0,) * blocks
    return [sum(d << (5 * k) for k, d in enumerate(step)) for step in sorted(found) if step >= zero]


def fingerprint_links(prints: DataFrame, radius: int = 2, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of `fp` within `radius` bits.

    Distinct fingerprints go into tiles by the population counts of their blocks. Two fingerprints
    within the radius have counts whose differences sum to the radius at most, so other tile pairs
    are skipped. A kept pair of tiles is compared whole with exclusive-or and bit counts, and
    only a spanning forest of its links leaves the task. More blocks (4, or 8 from 2^24 distinct
    fingerprints on) mean more and smaller tiles, never other links. Crowded cells are cut into
    tiles of about TILE fingerprints.
    """
    distinct = stored(prints.select("fp").where("fp is not null").distinct(), "fingerprints")
    if blocks is None:
        blocks = 4 if distinct.count() < 1 << 24 else 8
    cells = distinct.withColumn("cell", _cell(F.col("fp"), blocks))
    crowded = cells.groupBy("cell").count().where(F.col("count") > TILE)
    cut = F.pmod(F.xxhash64("fp"), F.ceil(F.coalesce("count", F.lit(1)) / TILE))
    tiles = stored(
        cells.join(crowded, "cell", "left")
        .withColumn("part", cut)
        .groupBy("cell", "part")
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    steps = F.array(*[F.lit(s).cast("long") for s in _steps(blocks, radius)])
    left = tiles.select("cell", "part", F.col("fps").alias("left"), F.explode(steps).alias("step"))
    left = left.withColumn("other", F.col("cell") + F.col("step"))
    right = tiles.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("fps").alias("right"))
    pairs = left.join(right, "other").where("step != 0 or part <= other_part")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                u, v = [], []
                for at in range(0, len(a), 256):
                    near = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius
                    i, j = np.nonzero(near)
                    if len(i):
                        one, two = forest(a[at + i], b[j])
                        u.append(one)
                        v.append(two)
                if u:
                    one, two = forest(np.concatenate(u), np.concatenate(v))
                    nodes.append(one)
                    roots.append(two)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], ["a", "b"])

    return pairs.select("left", "right").mapInArrow(task, "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """Every document's fingerprint and component: (doc_id, row, fp, root, fingerprint, component_id).

    Fingerprints of `size`-word shingles link at `radius` or fewer differing bits; `component_id` is
    the smallest doc_id reachable, itself included, `root` the component's smallest fingerprint.
    Null or blank texts have fingerprint 0 and link like any other; a null doc_id takes part and is
    smaller than nothing (a component of null ids has a null id); repeated rows stay repeated; an
    empty table gives an empty table; other columns are ignored whatever their names.
    """
    prints = stored(fingerprints(docs, size), "prints")
    roots = components(fingerprint_links(prints, radius))
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    lowest = lowest.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lowest = stored(lowest, "lowest")
    named = stored(lowest.groupBy("root").agg(F.min("lowest").alias("component_id")), "component-names")
    groups = stored(lowest.select("fp", "root").join(named, "root"), "groups")
    return prints.join(groups, "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def drop_near_copies(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """One document of each component: that of the smallest doc_id, then of the smallest row identity.

    Of rows equal in id and text one stays; documents without an id stay where no named one is in
    their component. Columns are those of `docs`.
    """
    groups = simhash_groups(docs, radius, size)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return _first_rows(docs, first)


def _first_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The documents whose row identity is a `first.row`, each once."""
    kept = first.select(F.col("first.row").alias("__row"))
    rows = docs.withColumn("__row", row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    turn = F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(0)))
    return rows.join(kept, "__row", "left_semi").withColumn("__turn", turn).where("__turn = 1").select(*docs.columns)

#: Five-word shingle sets at 0.8 differ in at most about 19 % of SimHash bits (small sets; 15 % large ones): 12 of 64
#: and 48 of 256. The radii are four deviations beyond; sets without a common shingle differ in half of the bits.
SHINGLE = 5
SIMILARITY = 0.8
WORDS = 4
FIRST_RADIUS = 24
WIDE_RADIUS = 76
LEAST_SET = 4
SIZE_STEPS = 4
BODY_WORDS = 1 << 20


def shingle_set(tokens: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; shorter texts are one shingle."""
    return np.unique(shingle_hashes(hash_words(tokens), min(SHINGLE, len(tokens)))) if tokens else np.empty(0, np.uint64)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 64 * WORDS bits of a set of hashes."""
    counts, odd = np.zeros(64 * WORDS, dtype=np.int64), np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    for at in range(0, len(hashes), 255):
        mixed = hashes[at : at + 255, None] * odd
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        mixed = np.ascontiguousarray(mixed ^ (mixed >> np.uint64(29)))
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(key, n, prints, first): a row for each distinct shingle set, `first` being its first (unnamed, doc_id, row)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(words(t)) for t in batch.column("text").to_pylist()]
            prints = [wide_print(s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row"), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                    pa.array([len(s) for s in sets], pa.int64()), *(pa.array([p[k] for p in prints], pa.int64()) for k in range(WORDS)),
                ],
                ["doc_id", "row", "key", "n", *(f"p{k}" for k in range(WORDS))],
            )

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("row"), text.alias("text"))
    own = [f"p{k}" for k in range(WORDS)]
    rows = rows.mapInArrow(task, f"doc_id long, row string, key string, n long, {', '.join(f'{p} long' for p in own)}")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    return rows.groupBy("key").agg(first, *(F.min(c).alias(c) for c in ("n", *own)))


def near(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of sets whose sizes allow SIMILARITY and whose fingerprints are within the radii."""
    i, j = np.nonzero(np.bitwise_count(a[0][:, None] ^ b[0][None, :]) <= FIRST_RADIUS)
    apart = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int32) for x, y in zip(a, b, strict=True))
    held = (apart <= WIDE_RADIUS) & (np.minimum(n[i], m[j]) >= SIMILARITY * np.maximum(n[i], m[j]) - 1e-9)
    return i[held], j[held]


def candidate_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between keys that span the components of all pairs that may be similar.

    Sets go into tiles by the logarithm of their size, SIZE_STEPS steps to a ratio of SIMILARITY: sets in cells
    further apart cannot be similar. Tile pairs are compared whole with exclusive-or and bit counts, and only
    a spanning forest leaves the task. Sets below LEAST_SET are similar to equal ones only.
    """
    own = [f"p{k}" for k in range(WORDS)]
    cell = F.floor(F.ln("n") / F.lit(-np.log(SIMILARITY)) * SIZE_STEPS).cast("long")
    cells = sets.where(F.col("n") >= LEAST_SET).select("key", "n", *own, cell.alias("cell"))
    crowded = cells.groupBy("cell").count().where(F.col("count") > TILE)
    cut = F.pmod(F.xxhash64("key"), F.ceil(F.coalesce("count", F.lit(1)) / TILE))
    tiles = cells.join(crowded, "cell", "left").withColumn("part", cut).groupBy("cell", "part")
    tiles = stored(tiles.agg(F.collect_list(F.struct("key", "n", *own)).alias("tile")), "set-tiles")
    steps = F.array(*[F.lit(s).cast("long") for s in range(SIZE_STEPS + 1)])
    left = tiles.select("cell", "part", F.col("tile").alias("left"), F.explode(steps).alias("step"))
    left = left.withColumn("other", F.col("cell") + F.col("step"))
    right = tiles.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("tile").alias("right"))
    pairs = left.join(right, "other").where("step != 0 or part <= other_part")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = x.values, y.values
                a, b = ([z.field(p).to_numpy().view(np.uint64) for p in own] for z in (x, y))
                n, m = x.field("n").to_numpy(), y.field("n").to_numpy()
                u, v = [], []
                for at in range(0, len(n), 64):
                    i, j = near([p[at : at + 64] for p in a], b, n[at : at + 64], m)
                    if len(i):
                        one, two = forest(at + i, len(n) + j)
                        u.append(one)
                        v.append(two)
                if u:
                    one, two = forest(np.concatenate(u), np.concatenate(v))
                    keys = pa.concat_arrays([x.field("key"), y.field("key")])
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(one)), keys.take(pa.array(two))], ["a", "b"])

    return pairs.select("left", "right").mapInArrow(task, "a string, b string")


def _verify(bodies: pa.Table) -> pa.Table:
    """Links (a, b) that span the components of all candidate pairs at SIMILARITY or more, compared exactly."""
    found = {k: shingle_set(words(t)) for k, t in zip(bodies.column("key").to_pylist(), bodies.column("text").to_pylist(), strict=True)}
    keys, sets = list(found), list(found.values())
    n, prints = np.array([len(s) for s in sets]), np.array([wide_print(s) for s in sets]).T
    label, u, v = np.arange(len(keys)), [], []
    for k in range(len(keys)):
        _, others = near([p[k : k + 1] for p in prints], [p[k + 1 :] for p in prints], n[k : k + 1], n[k + 1 :])
        for j in (others + k + 1).tolist():
            if label[j] != label[k]:
                shared = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                if shared >= SIMILARITY * (n[k] + n[j] - shared) - 1e-9:
                    label[label == label[j]] = label[k]
                    u.append(keys[k])
                    v.append(keys[j])
    return pa.table([pa.array(u, pa.string()), pa.array(v, pa.string())], ["a", "b"])


def similar_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between keys that span the components of all pairs with five-word Jaccard similarity >= SIMILARITY.

    Texts of a component of candidates meet in one task, which skips pairs that are already connected, so that a group of
    copies takes about one comparison each and no pairs are formed. Components of over BODY_WORDS shingles are cut
    into parts, and each pair of parts is a task.
    """
    members = components(candidate_links(sets)).withColumnRenamed("node", "key")
    members = stored(sets.select("key", "n", F.col("first.row").alias("row")).join(members, "key"), "set-members")
    parts = members.groupBy("root").agg(F.ceil(F.sum("n") / BODY_WORDS).alias("parts"))
    members = members.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    rows = docs.select(row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))
    bodies = rows.join(members, "row").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    bodies = bodies.select("root", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "key", "text")
    return bodies.groupBy("root", "low", "high").applyInArrow(_verify, "a string, b string")


def drop_similar(docs: DataFrame) -> DataFrame:
    """One document of each component of documents linked at five-word Jaccard similarity SIMILARITY or more.

    Candidates come from wide SimHash fingerprints, links from the exact sets (as 64-bit hashes). Which document stays,
    and the columns, are as in `drop_near_copies`; texts without words are equal. A pair of tiles is a row of
    over half a MB, so batches are kept small.
    """
    with small_batches(docs.sparkSession):
        sets = stored(shingle_sets(docs), "shingle-sets")
        roots = components(similar_links(docs, sets)).withColumnRenamed("node", "key")
    groups = sets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    return _first_rows(docs, groups.groupBy("root").agg(F.min("first").alias("first")))

"""Near-duplicate vectors: inverted lists with product-quantised residuals, and exact cosines at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm.common import stored
from tessarine.llm.components import components, forest

SAMPLE = 16_384
MOST_CELLS = 1024
CODES = 64
CODED = 8
TILE = 2048
LEEWAY = 1e-6


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of `points` by Lloyd's rounds from a seeded draw; an empty centre stays where it was."""
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), size=min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points by centres."""
    return np.maximum((points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * points @ centres.T, 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(points, centres).argmin(axis=1)


class Index:
    """Coarse centres and, for each slice of CODED dimensions, CODES centres of residuals."""

    def __init__(self, sample: np.ndarray, cells: int):
        centres = kmeans(sample, cells)
        off = centres - centres.mean(axis=0)
        axis = np.linalg.eigh(off.T @ off)[1][:, -1]
        self.centres = centres[np.argsort(off @ axis, kind="stable")]  # neighbours get near numbers
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.slices = [slice(at, min(at + CODED, sample.shape[1])) for at in range(0, sample.shape[1], CODED)]
        self.books = [kmeans(rest[:, s], CODES) for s in self.slices]

    def place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, residual codes and the codes' distance from the residual, of each vector."""
        cell = nearest(units, self.centres)
        rest = units - self.centres[cell]
        codes = np.stack([nearest(rest[:, s], b) for s, b in zip(self.slices, self.books, strict=True)], axis=1)
        left = [rest[:, s] - b[codes[:, k]] for k, (s, b) in enumerate(zip(self.slices, self.books, strict=True))]
        return cell, codes.astype(np.uint8), np.sqrt(sum((x**2).sum(1) for x in left))

    def probes(self, units: np.ndarray, cell: np.ndarray, radius: float) -> np.ndarray:
        """Vectors by cells: whether the cell can hold a vector within `radius`.

        Such a vector lies on its own cell's side of the plane between two centres, so a cell
        counts if the plane is no further than the radius.
        """
        squared = distances(units, self.centres)
        gap = np.sqrt(distances(self.centres, self.centres))[cell]
        own = squared[np.arange(len(units)), cell][:, None]
        return squared - own <= 2 * gap * radius + LEEWAY

    def shelves(self, probes: np.ndarray, shelves: np.ndarray) -> list[np.ndarray]:
        """The shelves that hold the probed cells, for vectors whose label has so many shelves."""
        cells = np.arange(len(self.centres))
        return [np.unique(cells[row] * n // len(cells)) for row, n in zip(probes, shelves, strict=True)]

    def table_distances(self, units: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of vectors to the coded members of a cell, by table look-up."""
        rest, total = units - self.centres[cell], np.zeros((len(units), len(codes)))
        for k, (s, b) in enumerate(zip(self.slices, self.books, strict=True)):
            total += distances(rest[:, s], b)[:, codes[:, k]]
        return np.sqrt(total)


def _units(raw: list[bytes], kind: str, width: int) -> np.ndarray:
    """Vectors of unit length in double precision, zero-filled to `width`."""
    out = np.zeros((len(raw), width))
    for i, x in enumerate(raw):
        v = np.frombuffer(x, dtype=kind)
        out[i, : len(v)] = v
    return out / np.linalg.norm(out, axis=1)[:, None]


def embedding_groups(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Direct links and component of every vector: (vec_id, n_links, component_id, kept).

    Vectors of one label and length link where their cosine in double precision reaches the
    threshold. Equal vectors become one representative with a count. The index is fitted on at most
    about SAMPLE representatives drawn by hash and places all of them; a representative looks into
    every cell that can hold a vector within the threshold's distance, and passes those members
    whose table distance, less their own coding error, is within it. Both bounds lose nothing, so
    recall is complete; exact cosines decide. A label's cells stand on shelves of about TILE members, neighbours
    together, so that a visitor goes to a shelf once for all its cells there. Members and visitors
    meet in tiles of about TILE; a tile returns one count per visitor and a spanning forest, never its pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without
    label, have no links and are their own component. Copies link with each other. A null vec_id
    takes part but names a component only where no id is there. Repeated rows stay; an empty
    table gives an empty table; other columns are ignored.
    """
    of_floats = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "<f4" if of_floats else "<f8"
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, raws, sizes = [], [], []
            for label, value in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                v = None
                if label is not None and value.is_valid and value.values.null_count == 0 and len(value.values):
                    v = value.values.to_numpy().astype(kind) + 0.0
                    length = np.linalg.norm(v.astype(np.float64))
                    v = v if np.isfinite(v).all() and np.isfinite(length) and length > 0 else None
                raws.append(None if v is None else v.astype(kind).tobytes())
                reps.append(None if v is None else xxhash.xxh3_128_hexdigest(f"{label}:{len(v)}:".encode() + raws[-1]))
                sizes.append(None if v is None else len(v))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(reps, pa.string()), pa.array(raws, pa.binary())],
                ["vec_id", "label", "dim", "rep", "raw"],
            )

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if of_floats else "array<double>").alias("embedding"))
    rows = stored(rows.mapInArrow(read, "vec_id long, label string, dim int, rep string, raw binary"), "vectors")
    reps = (
        rows.where("rep is not null")
        .groupBy("rep", "label", "dim", "raw")
        .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("lowest"))
    )
    reps = stored(reps, "representatives")
    total, width = reps.agg(F.count(F.lit(1)), F.max("dim")).first()
    if total:
        drawn = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / total))
        sample = reps.where(drawn).select("rep", "raw").toArrow().sort_by("rep").column("raw").to_pylist()
        sample = sample or [bytes(reps.select("raw").first().raw)]
        cells = max(1, min(MOST_CELLS, int(math.sqrt(total)), len(sample) // 16))
        index = Index(_units(sample, kind, width), cells)
        marks = stored(_links(reps, index, kind, width, threshold, radius), "vector-links")
    else:
        marks = reps.select("rep", F.lit(0).cast("long").alias("links"), F.col("rep").alias("root"))
    roots = components(marks.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = marks.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("rep", "n", "lowest").join(counts, "rep", "left").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left"
    )
    known = stored(known.withColumn("root", F.coalesce("root", "rep")), "representative-roots")
    names = stored(known.groupBy("root").agg(F.min("lowest").alias("component_id")), "vector-names")
    known = stored(
        known.join(names, "root").select("rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"),
        "vector-groups",
    )
    out = rows.select("vec_id", "rep").join(known, "rep", "left")
    out = out.withColumn("component_id", F.when(F.col("rep").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _links(reps: DataFrame, index: Index, kind: str, width: int, threshold: float, radius: float) -> DataFrame:
    """(rep, links, root): counts of linked vectors by visitor, and spanning links rep-root."""
    n_cells = len(index.centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                units = _units(part.column("raw").to_pylist(), kind, width)
                cell, codes, off = index.place(units)
                shelves = part.column("shelves").to_numpy()
                arrays = [part.column(c) for c in part.schema.names[:-1]]
                arrays += [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)]
                arrays += [pa.array((cell * shelves // n_cells).astype(np.int32))]
                arrays += [pa.array(index.shelves(index.probes(units, cell, radius), shelves), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[:-1], "cell", "codes", "off", "shelf", "visits"])

    sizes = reps.groupBy("label", "dim").agg(F.least(F.ceil(F.count(F.lit(1)) / TILE), F.lit(n_cells)).cast("int").alias("shelves"))
    placed = reps.join(sizes, ["label", "dim"]).select("rep", "label", "dim", "raw", "n", "shelves").mapInArrow(
        place, "rep string, label string, dim int, raw binary, n long, cell int, codes binary, off double, shelf int, visits array<int>"
    )
    placed = stored(placed, "placed-vectors")
    key = ["label", "dim", "shelf"]

    def tiles(rows: DataFrame, item: list[str], name: str) -> DataFrame:
        """Rows of one key packed into arrays of about TILE items."""
        crowded = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts")).where("parts > 1")
        part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))
        packed = rows.join(crowded, key, "left").withColumn("part", part).groupBy(*key, "part")
        return stored(packed.agg(F.collect_list(F.struct(*item)).alias(name)).drop("part"), name)

    members = tiles(placed, ["rep", "raw", "n", "cell", "codes", "off"], "members")
    visits = placed.select("rep", "label", "dim", "raw", "cell", F.explode("visits").alias("shelf"))
    visitors = tiles(visits, ["rep", "raw", "cell"], "visitors")
    met = visitors.join(members, key).select("visitors", "members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                visitors, members = batch.column("visitors")[i].values, batch.column("members")[i].values
                own, theirs = visitors.field("rep").to_pylist(), members.field("rep").to_pylist()
                x = _units(visitors.field("raw").to_pylist(), kind, width)
                y = _units(members.field("raw").to_pylist(), kind, width)
                codes = np.frombuffer(b"".join(members.field("codes").to_pylist()), dtype=np.uint8).reshape(len(y), -1)
                reach = radius + members.field("off").to_numpy() + LEEWAY
                copies, cells = members.field("n").to_numpy(), members.field("cell").to_numpy()
                probes = index.probes(x, visitors.field("cell").to_numpy(), radius)
                names = {r: k for k, r in enumerate(theirs)}
                same = np.array([names.get(r, -1) for r in own])
                number = np.where(same >= 0, same, len(y) + np.arange(len(x)))  # one number for a representative on both sides
                counts, u, v = np.zeros(len(x), dtype=np.int64), [], []
                for cell in np.unique(cells):
                    come, there = np.flatnonzero(probes[:, cell]), np.flatnonzero(cells == cell)
                    for at in range(0, len(come), 512):
                        some = come[at : at + 512]
                        near = index.table_distances(x[some], cell, codes[there]) <= reach[there]
                        a, b = np.nonzero(near)
                        for cut in range(0, len(a), 1 << 15):
                            p, q = some[a[cut : cut + (1 << 15)]], there[b[cut : cut + (1 << 15)]]
                            hit = (np.einsum("ij,ij->i", x[p], y[q]) >= threshold) & (same[p] != q)
                            np.add.at(counts, p[hit], copies[q[hit]])
                            if hit.any():
                                one, two = forest(number[p[hit]], q[hit])
                                u.append(one)
                                v.append(two)
                if not u:
                    continue
                node, root = forest(np.concatenate(u), np.concatenate(v))
                label = np.array(theirs + own, dtype=object)
                linked = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own[k] for k in linked] + list(label[node]), pa.string()),
                        pa.array(list(counts[linked]) + [0] * len(node), pa.int64()),
                        pa.array([None] * len(linked) + list(label[root]), pa.string()),
                    ],
                    ["rep", "links", "root"],
                )

    return met.mapInArrow(compare, "rep string, links long, root string")

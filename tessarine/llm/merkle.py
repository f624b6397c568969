"""Merkle manifest of a table: a tree per source, a tree over sources, and a version of both for each tampered leaf."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine.llm.common import stored

#: Fixed value: so many consecutive nodes have one parent.
FAN = 3
#: Leaves of an aligned block are FAN ** LEVELS; a block is one task's work.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Tree:
    """The nodes of one aligned block, level by level; versions share all nodes that they do not copy."""

    def __init__(self, leaves: Sequence[str], levels: int) -> None:
        self.rows = [list(leaves)]
        for _ in range(levels):
            below = self.rows[-1]
            self.rows.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def root(self) -> str:
        return self.rows[-1][0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """For each level from the leaf up: the siblings to the left, those to the right, each put together."""
        out = []
        for row in self.rows[:-1]:
            start = at - at % FAN
            out.append(("".join(row[start:at]), "".join(row[at + 1 : start + FAN])))
            at //= FAN
        return out


def copied(leaf: str, path: Sequence[tuple[str, str]]) -> list[str]:
    """The nodes of a new version whose only other leaf is `leaf`: its ancestors, the last one the root.

    All nodes off the path stay those of the tree that the path was taken from.
    """
    nodes = [leaf]
    for left, right in path:
        nodes.append(digest((left, nodes[-1], right)))
    return nodes


def levels_of(nodes: int) -> int:
    """How often `nodes` nodes are grouped until one remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """Digest of a row of `documents` with `text` as its text."""
    return F.sha2(F.concat(*(_field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Add `at`, the place from 0 of a node within its `tree` by `order`, and `total`, the nodes of the tree.

    Nodes are dealt by ranges of (tree, order), which cut large trees; rows equal in all of them are cut too. Each
    range counts its nodes and a tree has one such row for each of its ranges, so no tree is sorted in one task.
    """
    keys = ["tree", *order, "seq"]
    dealt = nodes.withColumn("seq", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("seq")
    dealt = stored(dealt.withColumn("row", F.monotonically_increasing_id()), "merkle-placed").withColumn("part", F.shiftright("row", 33))
    ranges = dealt.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part")) - F.col("n") - F.col("first")
    ranges = ranges.select("tree", "part", before.alias("shift"), F.sum("n").over(tree).alias("total"))
    same = [F.col("l.part") == F.col("r.part"), F.col("l.tree").eqNullSafe(F.col("r.tree"))]
    kept = [F.col(f"l.{c}") for c in dealt.columns if c not in ("row", "part")]
    return dealt.alias("l").join(ranges.alias("r"), same).select(*kept, (F.col("l.row") + F.col("r.shift")).alias("at"), "r.total")


def _block_levels(total: int, levels: int) -> int:
    return min(levels, levels_of(total))


def climbed(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Trees over placed nodes (tree, at, total, node): their roots (tree, root), and the path above each aligned block.

    The second table has (tree, block, path), a path being the pairs of left and right siblings from the
    block's root up to the tree's; a tree of one block has an empty path. Blocks hash their nodes in
    tasks of their own; their roots are the nodes of the next, FAN ** `levels` times smaller trees.
    """
    size = FAN**levels

    def roots(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        total = rows.column("total")[0].as_py()
        tree = Tree(rows.column("node").to_pylist(), _block_levels(total, levels))
        return pa.table({"tree": rows.column("tree")[:1], "at": pa.array([key[1].as_py()], pa.int64()), "total": [-(-total // size)], "node": [tree.root]})

    def paths(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        """Path of each node of a block through the block and on above it."""
        rows = rows.sort_by("at")
        tree = Tree(rows.column("node").to_pylist(), _block_levels(rows.column("total")[0].as_py(), levels))
        rest = [(p["left"], p["right"]) for p in above.column("path")[0].as_py()]
        out = [[{"left": a, "right": b} for a, b in [*tree.path(i), *rest]] for i in range(rows.num_rows)]
        return pa.table({"tree": rows.column("tree"), "block": rows.column("at"), "path": pa.array(out, PATH)})

    block = F.floor(F.col("at") / size).cast("long").alias("block")
    slim = nodes.select("tree", "at", "total", "node", block)
    upper = stored(slim.groupBy("tree", "block").applyInArrow(roots, "tree string, at long, total long, node string"), "merkle-blocks")
    if upper.where("total > 1").isEmpty():
        return upper.select("tree", F.col("node").alias("root")), upper.select("tree", F.col("at").alias("block"), F.array().cast(PATHS).alias("path"))
    tops, above = climbed(upper, levels)
    upper = upper.withColumn("block", F.floor(F.col("at") / size).cast("long"))
    held = upper.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return tops, stored(held.applyInArrow(paths, f"tree string, block long, path {PATHS}"), "merkle-paths")


PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
PATHS = "array<struct<left:string,right:string>>"
RESULT = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]


def manifest(docs: DataFrame, tampered: Column, altered: Column, levels: int = LEVELS) -> DataFrame:
    """One row per document: its leaf, its source's and the table's root, its proof and the root of its own version.

    Where `tampered` holds, `altered` stands for the text. Each such leaf makes a version of the tree that
    shares every untouched node and copies the ancestors only: within its aligned block of FAN ** `levels`
    leaves in the block's task, then along the path of the block's root through the upper blocks, the
    source's root and the sources' tree. `folded_root` is the root of that version (of the present one
    for other leaves, put together from the leaf all the same) and `verified` whether it is the table's.

    Leaves of a source ascend by doc_id (null first), rows of one doc_id by their digest. A null or unknown source has
    a tree of its own, nulls in other columns are `-` in the leaf, an empty text is `0:`, repeated rows are
    leaves of their own, an empty table gives an empty table, other columns are ignored.
    """
    size = FAN**levels
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("tree"),
        leaf_of(F.col("text")).alias("node"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf_of(altered)).alias("other"),
    )
    leaves = leaves.withColumn("other", F.when(F.col("other") != F.col("node"), F.col("other")))
    leaves = placed(leaves, "doc_id", "node").withColumn("block", F.floor(F.col("at") / size).cast("long"))
    subroots, within = climbed(leaves.select("tree", "at", "total", "node"), levels)
    subroots = stored(subroots, "merkle-subroots")
    one = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node"))
    one = stored(placed(one, "source"), "merkle-sources")
    top, across = climbed(one.select("tree", "at", "total", "node"), levels)
    sources = one.withColumn("block", F.floor(F.col("at") / size).cast("long")).groupBy("tree", "block").cogroup(across.groupBy("tree", "block"))

    def over_sources(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        tree = Tree(rows.column("node").to_pylist(), _block_levels(rows.column("total")[0].as_py(), levels))
        rest = [(p["left"], p["right"]) for p in above.column("path")[0].as_py()]
        out = [[{"left": a, "right": b} for a, b in [*tree.path(i), *rest]] for i in range(rows.num_rows)]
        return pa.table({"tree": rows.column("source"), "subroot": rows.column("node"), "over": pa.array(out, PATH)})

    sources = sources.applyInArrow(over_sources, f"tree string, subroot string, over {PATHS}")
    # One row per source and one root; both join by equality, and Spark picks the way by their written size.
    top = top.select("root", F.lit(1).alias("one"))
    sources = sources.withColumn("one", F.lit(1)).join(top, "one").drop("one")
    same = F.col("l.tree").eqNullSafe(F.col("r.tree"))
    above = within.alias("l").join(sources.alias("r"), same).select("l.tree", "l.block", F.concat("l.path", "r.over").alias("path"), "r.subroot", "r.root")

    def proofs(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        nodes, others = rows.column("node").to_pylist(), rows.column("other").to_pylist()
        tree = Tree(nodes, _block_levels(rows.column("total")[0].as_py(), levels))
        up = above.to_pylist()[0]
        rest = [(p["left"], p["right"]) for p in up["path"]]
        siblings, folded = [], []
        for at, (node, other) in enumerate(zip(nodes, others, strict=True)):
            path = [*tree.path(at), *rest]
            siblings.append(digest([part for pair in path for part in pair]))
            folded.append(copied(other or node, path)[-1])
        n = rows.num_rows
        columns = [nodes, [up["subroot"]] * n, [up["root"]] * n, siblings, folded]
        return pa.table({"doc_id": rows.column("doc_id"), **{c: pa.array(v, pa.string()) for c, v in zip(RESULT, columns, strict=True)}})

    held = leaves.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    found = held.applyInArrow(proofs, "doc_id long, " + ", ".join(f"{c} string" for c in RESULT))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def cut_newlines() -> tuple[Column, Column]:
    """The tampering of the registered query: where 2 divides crc32(doc_id as text), the text without its newlines."""
    return F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate(F.col("text").cast("string"), "\n", "")

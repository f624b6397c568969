"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node reachable.

    Each round joins every node to the smallest neighbour, follows that pointer once more and
    contracts the links; a star or a chain loses at least a constant share of its nodes. All state
    is tables: minima combine before their shuffle, and joins on a crowded node are plain
    equi-joins that adaptive execution splits. Null ends and self links are ignored; an empty
    table gives an empty table.
    """
    left, right = F.col(a), F.col(b)
    links = stored(
        links.where(left != right)
        .select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .distinct(),
        "links",
    )
    roots = None
    while roots is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("next")).withColumn("next", F.least("node", "next")),
            "components-down",
        )
        further = down.select(F.col("node").alias("next"), F.col("next").alias("end"))
        down = stored(
            down.join(further, "next").select("node", F.col("end").alias("next")),
            "components-down",
        )
        if roots is None:
            roots = down.select("node", F.col("next").alias("root"))
        else:
            roots = roots.join(down.withColumnRenamed("node", "root"), "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")
            )
        roots = stored(roots, "components-roots")
        for end in ("a", "b"):
            links = links.join(down.select(F.col("node").alias(end), "next"), end).drop(end).withColumnRenamed("next", end)
        links = stored(
            links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "links",
        )
    return roots


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star links (node, smallest node) of the graph with links u-v, nodes being numbers."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]

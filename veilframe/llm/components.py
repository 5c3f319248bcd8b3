"""Connected components of links too many for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.storage import Workspace

LINK = "node bigint, root bigint"
# Links a task holds at once: sixteen megabytes.
PIECE = 1 << 20


def find_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the links a-b but the roots: the least node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(piece: int):
    """Replace the links of a partition by as few as connect the same nodes, ``piece`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, root, size = [], [], 0
        for batch in batches:
            node.append(batch["node"].to_numpy())
            root.append(batch["root"].to_numpy())
            size += batch.num_rows
            if size > piece:
                forest = find_roots(np.concatenate(node), np.concatenate(root))
                # What shrank by half waits for more links.
                if len(forest[0]) > piece // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest], ["node", "root"])
                    node, root, size = [], [], 0
                else:
                    node, root, size = [forest[0]], [forest[1]], len(forest[0])
        if node:
            forest = find_roots(np.concatenate(node), np.concatenate(root))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest], ["node", "root"])

    return run


def _large_star(links: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least node of its neighbourhood."""
    both = links.unionAll(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
    return (
        both.join(least, "node")
        .where("root > node")
        .select(F.col("root").alias("node"), F.col("least").alias("root"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its lesser neighbours to the least of these."""
    least = links.groupBy("node").agg(F.min("root").alias("least"))
    pairs = links.join(least, "node")
    return pairs.select("node", F.col("least").alias("root")).unionAll(
        pairs.where("root != least").select(F.col("root").alias("node"), F.col("least").alias("root"))
    )


def connected_components(links: DataFrame, work: Workspace, piece: int = PIECE) -> DataFrame:
    """(node, root) for every node of the links (node, root: bigint) that is not the least
    of its component; ``root`` is the least node reachable.

    Links with a null end or from a node to itself link nothing. Union-find runs inside
    pieces of so many links, as few as hold them all, which leaves at most one link a node in
    each; links of one piece are done with that. Those of more go through alternating
    large-star and small-star steps, which shorten all paths until only stars are left, in a
    number of rounds that grows with the logarithm of the longest path. Links stay in tables;
    none are sent to the driver.
    """
    apart = links.where("node != root").select(
        F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")
    )

    def contracted(rows: DataFrame) -> tuple[DataFrame, bool]:
        found = work.store(rows.distinct().mapInArrow(_contract(piece), LINK).distinct())
        pieces = -(-found.count() // piece)
        if not pieces:
            return found, True
        fewer = work.store(found.coalesce(pieces).mapInArrow(_contract(piece), LINK))
        work.drop(found)
        return fewer, pieces == 1 or _all_stars(fewer)

    current, done = contracted(apart)
    while not done:
        following, done = contracted(_small_star(_large_star(current).distinct()))
        work.drop(current)
        current = following
    return current


def _all_stars(links: DataFrame) -> bool:
    """Every node has one root, and no root is itself a node with a root."""
    twice = links.groupBy("node").count().where("count > 1")
    chained = links.join(links.select(F.col("root").alias("other")), F.col("node") == F.col("other"), "left_semi")
    return twice.isEmpty() and chained.isEmpty()

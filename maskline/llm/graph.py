"""Connected components of a graph of any size: edges are contracted in pieces of bounded size, then come large-star and
small-star rounds, each written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.common import slices
from maskline.session import materialize

#: Edges that are contracted at once.
PIECE = 1 << 18


def _forest(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (higher end, smallest node) that connect the same nodes as the edges do."""
    nodes, place = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = place[: len(hi)], place[len(hi) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaf], nodes[root[leaf]]


def _contracted(edges: DataFrame, pieces: int) -> DataFrame:
    """Edges (hi, lo) read by at most `pieces` tasks, as the stars of each PIECE of them: the same components, and a node for
    every node."""

    def contract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            some = pa.Table.from_batches(held)
            found = _forest(some["hi"].to_numpy(), some["lo"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["hi", "lo"])

        for part in slices(parts, PIECE):
            held.append(part)
            if sum(map(len, held)) >= PIECE:
                yield stars()
                held = []
        if held:
            yield stars()

    return edges.coalesce(pieces).mapInArrow(contract, edges.schema)


def _stars(edges: DataFrame, by: str) -> DataFrame:
    """edges with `least`, the smallest neighbour of column `by`. The minimum is written, so that a node with very many
    neighbours meets it in a join that Spark can split."""
    least = materialize(edges.groupBy(by).agg(F.min("other").alias("least")))
    return edges.join(least.hint("merge"), by)


def _done(edges: DataFrame) -> bool:
    """Are they stars: every higher end once, and nowhere a lower end? Then each star is a component."""
    twice = edges.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select(F.col("hi").alias("lo"))
    return twice.unionByName(edges.select("lo").join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi")).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): the smallest id that can be reached from it, itself included.

    Loops and repeated edges do no harm; edges with a null end are ignored. Up to PIECE edges are one piece, and need no
    round. The number of rounds grows with the logarithm of the longest path; only the number of edges and whether a round was
    the last come to the driver.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    pieces = -(-now.count() // PIECE)
    if pieces:
        now = materialize(_contracted(now, pieces))
    while pieces > 1 and not _done(now):
        both = now.select(F.col("hi").alias("id"), F.col("lo").alias("other")).unionByName(
            now.select(F.col("lo").alias("id"), F.col("hi").alias("other"))
        )
        large = _stars(both, "id").where("other > id").select(F.col("other").alias("id"), F.least("id", "least").alias("other"))
        large = materialize(large.distinct())
        small = _stars(large, "id")
        linked = small.select(F.col("id").alias("hi"), F.col("least").alias("lo")).unionByName(
            small.where("other <> least").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        )
        now = materialize(linked.distinct())
    roots = now.select(F.col("lo").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)

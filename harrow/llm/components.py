"""Connected components of a table of links, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import arrays as A
from harrow.session import durable, ship

BROADCAST_ROWS = 1_000_000  # pairs of numbers that may be broadcast; beyond that a join shuffles
TASK_ROWS = 250_000  # links that a task contracts at once


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and for each the smallest node that these links connect it with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Stars (u, v) that connect what ``edges`` (u, v) connect, made by each task from its own links before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star() -> pa.RecordBatch:
            nodes, roots = smallest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            other = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(roots[other])], names=["u", "v"])

        held, size = [], 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in (0, 1)))
            size += len(batch)
            if size >= 2 * TASK_ROWS:
                yield star()
                held, size = [], 0
        if held:
            yield star()

    return edges.coalesce(tasks).mapInArrow(A.tidied(run), "u long, v long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node of its component.

    Tasks contract TASK_ROWS links each to stars of their own first. Where that takes several tasks, rounds follow, each
    of which moves every neighbour to the smallest node known nearby (large star, then small star), which needs a
    grouped minimum and a join; a node's neighbours are never listed in one place. Rounds end when the edges, by then
    one star a component, stay as they are: about the logarithm of the longest path.
    """
    ship(links.sparkSession)
    edges = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    tasks = -(-edges.count() // TASK_ROWS)
    if tasks:
        edges = durable(contracted(edges, tasks))
    state = _state(edges) if tasks > 1 else (0,)
    while state[0]:
        small_enough = state[0] <= BROADCAST_ROWS
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(F.broadcast(low) if small_enough else low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(F.broadcast(low) if small_enough else low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if (now := _state(edges)) == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Connected components of a graph given as an edge table, by distributed union-find.

Each task first settles the links it reads by union-find, which leaves it a
forest: at most one link down from a node, to the least node it can reach
there.  The forests are dealt by the upper end, of which no task sent more
than one link, and settled again, so hubs of any degree are no hot keys of
this shuffle.  Rounds then replace the lower end of every link by the node
its own link leads to and settle again, until no lower end has a link down
and no task has found links for others.  A round is one join and one shuffle more.  The join's right
side has one row a node; the rows of a root with very many nodes are split by
Spark's adaptive skew joins.  Paths halve in each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared

#: Links that a task holds before it shrinks them to a forest.
HELD = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of links (u, v) that can reach a smaller one, and the least one it can reach."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(nodes))
    while True:
        # each root takes the least root that a link shows it, then all point at their roots
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            below = root != np.arange(len(nodes))
            return nodes[below], nodes[root[below]]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as a forest."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = kept = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size >= HELD + 2 * kept:
            held = [_forest(*map(np.concatenate, zip(*held, strict=True)))]
            size = kept = len(held[0][0])
    if size:
        u, v = _forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v, moved), dealt by u, as a task's forest; open unless nothing moved and all its links are own.

    own: u came as an upper end, so no other task has an own link down from it.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    upper: list[np.ndarray] = []
    size = kept = 0
    moved = False
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        moved |= bool(batch.column(2).to_numpy(zero_copy_only=False).any())
        held.append((u, v))
        upper.append(u)
        size += len(batch)
        if size >= HELD + 2 * kept:
            held, upper = [_forest(*map(np.concatenate, zip(*held, strict=True)))], [np.unique(np.concatenate(upper))]
            size = kept = len(held[0][0])
    if size:
        u, v = _forest(*map(np.concatenate, zip(*held, strict=True)))
        own = np.isin(u, np.concatenate(upper))
        still = np.full(len(u), moved or not own.all())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, own, still)], names=["u", "v", "own", "open"])


def _settled(links: DataFrame) -> DataFrame:
    """links(u, v, moved), u > v, settled by the tasks that u deals them to."""
    return shared.materialise(links.repartition("u").mapInArrow(_settle, "u long, v long, own boolean, open boolean"), "links")


def _jumped(links: DataFrame) -> DataFrame:
    """Each link's lower end replaced by the node its own link leads to; moved: there is one, or the link is new to its task."""
    down = links.where("own").select(F.col("u").alias("v"), F.col("v").alias("w"))
    return links.select("u", "v", "own").join(down, "v", "left").select("u", F.coalesce("w", "v").alias("v"), (F.col("w").isNotNull() | ~F.col("own")).alias("moved"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> (node, component): the least node reachable from each node of an edge.

    Null ends and self-links are left out; repeated links count once.  Without
    links the result is empty.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = _settled(links.mapInArrow(_shrink, "u long, v long").withColumn("moved", F.lit(True)))
    for _ in range(most_rounds):
        if links.where("open").isEmpty():
            break
        links = _settled(_jumped(links))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component").distinct().select(F.col("component").alias("node"), "component"))

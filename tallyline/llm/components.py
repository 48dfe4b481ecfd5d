"""Connected components of links, by alternating star contractions.

Tasks first replace the links they hold, a bounded number at a time, by a forest with the
same components, so that dense groups shuffle as few links as they have nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallyline.llm.common import trimmed, written

#: Links in a written file, about, and links that a task contracts at a time.
LINKS_PER_FILE = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node that isn't the least itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a := a[apart := root[a] != root[b]]):
        b = b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((up := root[root]) != root).any():
            root = up
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contracted(pairs: DataFrame, chunk: int) -> DataFrame:
    """Links (u, v) with the same components, at most one per node and ``chunk`` of links."""
    if not all(isinstance(f.dataType, LongType) for f in pairs.schema):
        return pairs.distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def links() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate(c) for c in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= chunk:
                yield links()
                held, size = [], 0
        if held:
            yield links()

    return pairs.mapInArrow(trimmed(run), pairs.schema).distinct()


def _apart(least: DataFrame) -> DataFrame:
    """The same minima with a computed key, which hides that they are clustered by it.

    Both sides of the join then come straight from a shuffle, the condition for Spark
    to split a node with very many links over several tasks.
    """
    return least.select(F.array_max(F.array("u")).alias("u"), "m")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(_apart(least), "u")
    return joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(_apart(least), "u").where("v != m")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        least.select("u", F.col("m").alias("v"))
    )


def connected_components(links: DataFrame, rounds: int | None = None, chunk: int = LINKS_PER_FILE) -> DataFrame:
    """(node, component) for links (a, b): the smallest node that each node reaches.

    Nodes can be of any type with an order. Roots of components aren't listed; a node
    that isn't listed is its own component. Links may repeat, be in either direction or
    lead back to their node; null ends are ignored. Every round is written to the shared
    folder and takes joins and minima over the links only; the rounds grow with the
    logarithm of the nodes. With ``rounds``, that many at most: nodes of one result are
    then connected, but a component may have several. Links between whole numbers are
    contracted ``chunk`` at a time; what fits into one chunk needs no round.
    """
    pairs = links.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    pairs = written(_contracted(pairs, chunk), "links")

    def state(df):
        marks = F.xxhash64("u", "v").cast("decimal(38,0)")
        return tuple(df.agg(F.count("*"), F.sum(marks)).first())

    before = state(pairs)
    whole = isinstance(pairs.schema["u"].dataType, LongType)
    while before[0] and rounds != 0:
        # few rows in few files, for what reads them next
        few = max(1, -(-before[0] // chunk))
        if whole:
            pairs = _contracted(pairs.coalesce(few), 2 * chunk)
        if not whole or few > 1:
            pairs = _small_star(_large_star(pairs)).distinct()
        pairs = written(pairs.coalesce(few), "links")
        if whole and few == 1:
            break  # one forest of all links is the result
        now = state(pairs)
        if now == before:
            break
        before = now
        rounds = rounds - 1 if rounds else rounds
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))

"""Connected components of a table of links: forests by task, alternating large and small stars, a last task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Links of a forest up to which one task ends the work, and links that a task holds at a time.
ONE_TASK, HELD = 1 << 16, 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) of the same components, root the smallest node of each: one for every other node."""
    nodes, local = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    u, v = local[: len(a)], local[len(a) :]
    while True:
        x, y = parent[u], parent[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[below], nodes[parent[below]]


def _thinned(links: DataFrame) -> DataFrame:
    """Links (u, v), u above v, of the same components; a task leaves one for each node of HELD links at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, size = [], [], 0

        def close() -> pa.RecordBatch:
            u, v = forest(np.concatenate(a), np.concatenate(b))
            a.clear(), b.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            size += batch.num_rows
            if size >= HELD:
                yield close()
                size = 0
        if size:
            yield close()

    return links.mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Links are thinned to forests where they lie. While more than ONE_TASK remain, rounds of large and small stars go on:
    grouped minima and joins over links kept one way, cut off by a checkpoint; nothing is gathered by group, so a node
    with very many links is summed where its links lie. What is left then is one task's forest, at most ONE_TASK links.
    A link with a null end, or of a node to itself, is none. No rows in, no rows out. Raises where rounds do not suffice.
    """
    ready(links.sparkSession)
    a, b = (F.col(c).cast("long") for c in links.columns[:2])
    edges = _thinned(links.select(a.alias("u"), b.alias("v")).where("u != v")).checkpoint()
    state = None
    for _ in range(most_rounds + 1):
        count, now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if count <= ONE_TASK:
            edges = _thinned(edges.coalesce(1)).checkpoint()
            break
        if (count, now) == state:
            break
        state = count, now
        # large star: what is above a node goes to the least of the node and what is around it
        low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        large = edges.join(low, F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small star: what is below a node, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = moved.unionByName(least.withColumnRenamed("m", "v")).distinct().checkpoint()
    else:
        raise RuntimeError(f"links have not converged to components in {most_rounds} rounds")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)

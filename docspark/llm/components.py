"""Connected components: edges are contracted where they lie, then by star rounds on staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import HEAVY_SHARE, Folder, remove

#: Edges that a worker contracts at once (16 bytes each).
CHUNK = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of these edges that isn't the least of its component: hook to the lesser root, jump."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while ((up := root[root]) != root).any():
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def contract(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """u, v: the same components by fewer edges, each from a node to the least one of its chunk's component.

    Edges are taken in chunks of about ``chunk`` as they come; equal ``u`` side by side stay in one chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)

        def made(n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u[:n], v[:n])], ["u", "v"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            u, v = np.concatenate([u, new[0]]), np.concatenate([v, new[1]])
            if len(u) >= chunk and (cut := int(np.flatnonzero(u != u[-1])[-1] + 1 if (u != u[-1]).any() else 0)):
                yield made(cut)
                u, v = u[cut:], v[cut:]
        if len(u):
            yield made(len(u))

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def shortened(edges: DataFrame, n: int) -> DataFrame:
    """Large star: every edge u-v becomes u-m, m being the least node that v has an edge to (v itself if it has none lesser).

    Nodes that over 1/HEAVY_SHARE of the edges lead to are joined by broadcast (fewer than HEAVY_SHARE exist); the
    rest takes a shuffled join without hot keys.
    """
    parents = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    heavy = edges.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") * HEAVY_SHARE > F.lit(n)).select("v")
    known = parents.join(F.broadcast(heavy), "v", "left_semi")
    hot = edges.join(F.broadcast(heavy), "v", "left_semi").join(F.broadcast(known), "v", "left")
    cold = edges.join(F.broadcast(heavy), "v", "left_anti").join(parents, "v", "left")
    return hot.unionByName(cold).select("u", F.coalesce("m", "v").alias("v"))


def components(edges: DataFrame, chunk: int = CHUNK, folder: Folder | None = None) -> DataFrame:
    """node, root (the least node reachable) of every node of ``edges`` (u, v long); nulls and loops count for nothing.

    First every chunk of edges is contracted where it lies. While more than a chunk is left, star rounds go on: edges
    are shortened, dealt by their upper node and contracted, each round reading the table that the last one wrote in
    the shared folder. What fits a chunk is finished in one task. Only counts and checksums reach the driver.
    """
    spark = edges.sparkSession
    stage_at = (folder or Folder(spark)).stage_at
    now, at = stage_at(contract(edges.filter(F.col("u") != F.col("v")), chunk), "stars")
    state = None
    while True:
        was, state = state, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        n = state[0]
        if n <= chunk or state == was:
            break
        dealt = shortened(now, n).repartition("u").sortWithinPartitions("u")
        new, path = stage_at(contract(dealt, chunk).coalesce(1 + n // chunk * 4), "stars")
        remove(spark, at)
        now, at = new, path
    done = contract(now.coalesce(1), chunk + n) if n <= chunk else now
    done, _ = stage_at(done, "stars")
    remove(spark, at)
    return done.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(done.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of links, as joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from portlens.llm.common import release, stored

MAX_ROUNDS = 60
FEW_LINKS = 400_000  # up to here one task holds all links, some tens of MB


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the links (a, b) with the least node of their component."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([top(x) for x in parent], pa.int64())], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node that has a link (a, b).

    Rounds of two steps: every node hands its least neighbour to its larger
    neighbours, then to its smaller ones, until each node hangs on its component's
    least. Each step is a grouped minimum and a join on the node, so a node with
    very many links is no group in one task. Links that are counted and few are joined
    by one task instead, with the same result.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(edges)
    if before[0] <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, edges = edges, stored(small.where("a != b").distinct(), "links")
        release(last)
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

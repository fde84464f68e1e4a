"""Connected components of a link table, without meeting in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node) for every node that is not the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return [(node, root(node)) for node in list(parent) if root(node) != node]


def _contract(links: DataFrame) -> DataFrame:
    """Replace the links of each task by a forest with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, int]] = []
        for batch in batches:
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            kept = forest([*kept, *rows])
        columns = [pa.array([row[k] for row in kept], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them.

    ``larger``: the neighbours above the node, with the smallest taken over all;
    else those below it and the node itself.  The smallest neighbour per node is
    written first, so that the join has a plain exchange on both sides and Spark
    can split a node with very many links.
    """
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = down.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if larger else down
    low = near.groupBy("u").agg(F.min(F.least("u", "v")).alias("low"))
    low = written(low, "smallest")
    if larger:
        linked = near.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        linked = near.join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        linked = linked.unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return written(linked.filter("a > b").distinct(), "stars")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links(a, b)`` but the smallest of each.

    ``component`` is the smallest node reachable.  Large-star and small-star
    steps alternate until nothing changes, about log n times.  Links to itself
    and repeated links do no harm; an empty table gives no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(_contract(edges.filter("a > b")), "links")
    last = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")
        ).first()
        # Done when every node has one link and no node that is linked to is linked on.
        if state[0] == 0 or state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = state
        edges = _star(_star(edges, larger=True), larger=False)

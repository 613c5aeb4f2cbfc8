"""Connected components of a graph of links, by alternating star contractions in DataFrame operations.

Each round points every node's larger neighbours to the smallest node around it (large star) and then every
node's smaller neighbours to the smallest of them (small star); the graph is a forest of stars when a round
changes nothing. Links are first contracted inside each partition by union-find, which leaves a spanning forest.
Minima are pre-aggregated before the shuffle and stored, so that the joins against them have a shuffle of their own
on either side and adaptive execution can split a node with very many links. Each round is stored in the shared folder, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.llm._common import stored

#: Links that one task contracts at a time.
LINKS_AT_ONCE = 200_000


class Forest:
    """Union-find over arbitrary ids; the root of a set is its smallest id."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(forest: Forest) -> pa.RecordBatch:
        nodes = [*forest.up]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["a", "b"])

    forest, n = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        n += batch.num_rows
        if n >= LINKS_AT_ONCE:
            yield emit(forest)
            forest, n = Forest(), 0
    yield emit(forest)


def contracted(links: DataFrame) -> DataFrame:
    """A spanning forest of each partition's links, as (a, b) with b the smallest node of a's tree."""
    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_contract, "a long, b long").where("a <> b")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for every node with a link: the smallest id that it reaches. ``links`` has columns a and b; it is
    read twice, so it should be a stored table. Up to LINKS_AT_ONCE links one task contracts them wholly."""
    spark = links.sparkSession
    # more tasks than this only cost time: rows are two integers
    few = 1 if links.count() <= LINKS_AT_ONCE else 4 * spark.sparkContext.defaultParallelism
    edges = stored(contracted(links.coalesce(few)), "links")
    for _ in range(most_rounds):
        if few == 1:
            break
        several = edges.groupBy("a").agg((F.min("b") < F.max("b")).alias("s")).where("s")
        if several.isEmpty() and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break  # every node hangs on one root, and no root on another
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        below = stored(large.groupBy("a").agg(F.min("b").alias("m")), "below")
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(below, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b")
        edges = stored(contracted(small.distinct().coalesce(few)), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())

"""Connected components of an undirected graph given by edges, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir


#: Edges that one task may join by union-find; more are joined partition by partition first.
ONE_TASK = 500_000


def kept_table(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared scratch folder and read again."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _union_find(batches) -> Iterator:
    """Edges of one partition as a forest: (node, root) with root the smallest node."""
    import pyarrow as pa

    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    if not parts:
        return
    nodes, flat = np.unique(np.concatenate(parts), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in flat.reshape(-1, 2).tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.fromiter((root(x) for x in range(len(nodes))), np.int64, len(nodes))
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], names=["a", "b"])


def _smaller_star(edges: DataFrame) -> DataFrame:
    """Hangs a node's smaller neighbours and itself under the smallest; a > b throughout."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _larger_star(edges: DataFrame) -> DataFrame:
    """Hangs a node's larger neighbours under its smallest neighbour or itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.filter("v > u").join(least, "u")
    return hung.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; component is the smallest node reached.

    ``edges`` has two bigint columns. Up to ONE_TASK edges are joined by union-find at once.
    Of more, union-find shrinks every partition to a forest, then stars are contracted until
    nothing moves; each round writes its edges. A hub meets its neighbours in a join, which
    Spark can split, never in one list. Both ways give the same components.
    """
    first, second = edges.columns[:2]
    ordered = kept_table(edges.filter(F.col(first) != F.col(second)).select(
        F.greatest(first, second).alias("a"), F.least(first, second).alias("b")
    ), "edges")
    few = ordered.count() <= ONE_TASK
    found = (ordered.coalesce(1) if few else ordered).mapInArrow(_union_find, "a bigint, b bigint")
    if few:  # a forest of all edges: every node hangs under its smallest already
        return _named(kept_table(found, "forest"))
    forest = kept_table(found, "forest")
    mark = None
    while True:
        print_of = forest.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(print_of) == mark:
            break
        mark = tuple(print_of)
        forest = kept_table(_smaller_star(_larger_star(forest)), "forest")
    return _named(forest)


def _named(forest: DataFrame) -> DataFrame:
    return forest.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        forest.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

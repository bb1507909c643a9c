"""Connected components of an edge table, by contraction.

Each round points every node at its smallest neighbour, follows the pointers once, replaces nodes
by what they point at and drops edges inside a component. Edges at least halve their components
each round, and a hub of many edges is a partial aggregate and a join that Spark can split, never
a collected list. What a round makes is written, so the next is planned with its true size. Edges become few long before they are none, so every step is packed into the
partitions that its rows fill: else each round would leave a set of files for every shuffle partition.
The last few edges, no more than fill one such partition, are joined in its task without more rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PACKED, packed, written

#: Types whose values Python tells apart as Spark does.
_PLAIN = ("string", "binary", "bigint", "int")


def _join_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of a few edges, which are one partition."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.record_batch([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["node", "root"])


def connected_components(edges: DataFrame, last: int = PACKED) -> DataFrame:
    """edges(a, b) of any one orderable type -> (node, root): for each node that has an edge to
    another, one node of its component, the same for all of it. Empty edges give no rows. No more
    edges than ``last`` are joined at once."""
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "component-edges")
    (_, kind), (_, other) = edges.dtypes
    last = min(last, PACKED) if kind == other and kind in _PLAIN else 0
    found, rows = None, edges.count()
    while rows:
        edges = packed(edges, rows)
        if rows <= last:
            # the one partition of all these edges; no hop is left to make
            up = written(edges.mapInArrow(_join_last, f"node {kind}, root {kind}"), "component-up")
            if found is None:
                return packed(up, 2 * rows)
            return written(_follow(found, up, nodes), "component-found")
        both = edges.union(edges.select("b", "a"))
        # nodes are at most twice the edges
        up = written(packed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), 2 * rows), "component-up")
        for _ in range(2):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            up = written(packed(up.join(over, "root").select("node", F.col("next").alias("root")), 2 * rows), "component-up")
        a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        half = packed(edges.join(a, "a").select("b", "ra"), rows)
        edges = written(packed(half.join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), rows), "component-edges")
        if found is None:
            found, nodes = up, 2 * rows
        else:
            found = written(_follow(found, up, nodes), "component-found")
        rows = edges.count()
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def _follow(found: DataFrame, up: DataFrame, nodes: int) -> DataFrame:
    """found with the roots that up gives its roots."""
    later = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return packed(found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), nodes)

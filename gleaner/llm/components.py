"""Connected components by alternating stars (Kiveris et al., 2014), on tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import store
from gleaner.llm.arrow import column, map_arrow

#: Edges up to which one task joins them (3 MB of them): rounds of stars would cost the driver some ten plans each time.
FEW_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of the component) for every node of ``edges`` (a, b), longs; roots are listed too.

    Few edges are joined in one task. Of more, each round joins the larger neighbours of a node to its least neighbour,
    then the smaller ones. Degrees never meet in one row or task: the least neighbour is a pre-aggregated minimum. The
    result is a table in the shared folder.
    """
    now = store.written(_oriented(edges.select("a", "b")).distinct(), "edges")
    if now.count() <= FEW_EDGES:
        out = store.written(map_arrow(now.coalesce(1), _joined, "node long, root long"), "components")
        store.drop(now)
        return out
    state = None
    while state != (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) and state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = store.written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"])
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = store.written(_oriented(small).distinct(), "edges")
        store.drop(now), store.drop(large)
        now = small
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all edges by union-find; nodes are numbered in order, so the least number is the root."""
    ends = [np.concatenate([column(b, c).to_numpy() for b in held]) for held in [list(batches)] if held for c in ("a", "b")]
    nodes, number = np.unique(np.concatenate([*ends, np.empty(0, "int64")]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in number.reshape(2, -1).T.tolist():
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    for i, x in enumerate(up):  # what is above stands before
        up[i] = up[x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[np.array(up, "int64")])], ["node", "root"])

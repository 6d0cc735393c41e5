"""Exact nearest neighbours: tiled matrix products of queries and vectors, and a best per query from each tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.ship import ship

#: Queries that a block holds: each task takes one block after another, so blocks bound its memory.
BLOCK = 4096


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), "float64")
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(queries: DataFrame, vectors: DataFrame, uid: str, vector: str) -> DataFrame:
    """uid, nearest and cosine: for each query the vector of the highest cosine similarity, ties to the smaller uid.

    Queries are a set that the caller states. They are packed into blocks of BLOCK, numbered by a hash of their uid, and
    each tile of a block and a batch of vectors gives one candidate per query; these are reduced before they are shuffled.
    Rows without a vector take no part.
    """
    ship(queries.sparkSession)
    queries, vectors = (d.filter(F.col(vector).isNotNull()).select(F.col(uid).cast("long").alias("uid"), F.col(vector).cast("array<double>").alias("v")) for d in (queries, vectors))
    blocks = -(-queries.count() // BLOCK)
    best: DataFrame | None = None
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).toPandas()  # about BLOCK rows
        shared = queries.sparkSession.sparkContext.broadcast((part["uid"].to_numpy(), _matrix(part["v"]) if len(part) else np.empty((0, 0))))

        def tile(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            top, who = np.full(len(ids), -np.inf), np.zeros(len(ids), "int64")
            for p in parts:
                if not len(p) or not len(ids):
                    continue
                p = p.sort_values("uid")
                s = np.round(q @ _matrix(p["v"]).T, 9)
                at = s.argmax(axis=1)
                value, name = s[np.arange(len(ids)), at], p["uid"].to_numpy()[at]
                better = (value > top) | ((value == top) & (name < who))
                top, who = np.where(better, value, top), np.where(better, name, who)
            kept = np.isfinite(top)
            yield pd.DataFrame({"uid": ids[kept], "nearest": who[kept], "cosine": top[kept]})

        found = vectors.mapInPandas(tile, "uid long, nearest long, cosine double")
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = queries.sparkSession.createDataFrame([], "uid long, nearest long, cosine double")
    first = F.max_by(F.struct("nearest", "cosine"), F.struct("cosine", -F.col("nearest")))
    return best.groupBy("uid").agg(first.alias("b")).select(F.col("uid").alias(uid), "b.nearest", "b.cosine")

"""Exact top-k search by tiled matrix products.

Vectors are packed into shards and queries into blocks. A tile is one product of a block and a shard; its partial
selection leaves the k best of the shard for each query. The lists of a block are then merged in a tree, a bounded
number of lists at a time, until one is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import store
from gleaner.llm.arrow import column, map_arrow

#: Rows of a shard and of a block of queries; lists that one merge takes.
SHARD, BLOCK, FAN = 2048, 1024, 16
#: Bytes of packed queries that are broadcast at once; the shards are read again for each such group of blocks.
BROADCAST_BYTES = 64 << 20
SHARD_SCHEMA = "shard long, dim int, ids binary, data binary"
LIST_SCHEMA = "block long, shard long, dim int, queries binary, own binary, ids binary, scores binary"
LOW = np.iinfo("int64").min


def scaled(vectors: list, scale: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Which vectors take part, and by their length those vectors as floor(scale * x) in doubles."""
    dims = np.array([len(v) if v is not None else -1 for v in vectors])
    good, by = np.zeros(len(vectors), bool), {}
    for d in sorted(set(dims[dims > 0].tolist())):
        rows = np.flatnonzero(dims == d)
        raw = np.array([vectors[i] for i in rows], dtype="float64")  # a null component becomes nan
        fine = np.isfinite(raw).all(axis=1)
        good[rows[fine]] = True
        by[d] = np.floor(scale * raw[fine])
    return good, by


def packed(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, embedding) in shards of up to ``size`` rows, each in ascending order of vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made, task = 0, TaskContext.get().partitionId()

        def shard(dim: int, take: int) -> pa.RecordBatch:
            nonlocal made
            ids, data = (np.concatenate([x[k] for x in held[dim]]) for k in (0, 1))
            held[dim] = [(ids[take:], data[take:])]
            ids, data = ids[:take], data[:take]
            order, made = np.argsort(ids, kind="stable"), made + 1
            return pa.RecordBatch.from_pylist([{"shard": (task << 32) + made, "dim": dim, "ids": ids[order].tobytes(), "data": data[order].tobytes()}], pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            ids = column(batch, "vec_id").to_numpy(zero_copy_only=False)
            vectors = column(batch, "embedding").to_pylist()
            good, by = scaled(vectors, scale)
            dims = np.array([len(v) if v is not None else -1 for v in vectors])
            for d, data in by.items():
                held.setdefault(d, []).append((ids[good & (dims == d)].astype("int64"), data))
                while sum(len(x[0]) for x in held[d]) >= size:
                    yield shard(d, size)
        for d in held:
            if n := sum(len(x[0]) for x in held[d]):
                yield shard(d, n)

    return map_arrow(rows, run, SHARD_SCHEMA)


def product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; one outside the range of a long takes the nearest end of the range."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries @ vectors.T).astype("int64")
    if bound < 2**62:
        return queries.astype("int64") @ vectors.astype("int64").T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(queries) @ whole(vectors).T, LOW + 1, 2**63 - 1).astype("int64")


def lengths(vectors: np.ndarray) -> np.ndarray:
    """The product of each vector with itself, as :func:`product` gives it."""
    bound = np.abs(vectors).max(initial=0) ** 2 * max(1, vectors.shape[1])
    if bound < 2**53:
        return (vectors * vectors).sum(axis=1).astype("int64")
    return np.array([product(v[None], v[None])[0, 0] for v in vectors], "int64")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids, ties to the smaller id; LOW marks an empty place."""
    k = min(k, scores.shape[1])
    if k < scores.shape[1]:
        # Above the k-th score all stay; of those that equal it, the smallest ids do.
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        keep_ids, keep = np.empty((len(scores), k), "int64"), np.empty((len(scores), k), "int64")
        for r in range(len(scores)):
            over = np.flatnonzero(scores[r] > edge[r])
            level = np.flatnonzero(scores[r] == edge[r])
            level = level[np.argsort(ids[r, level], kind="stable")[: k - len(over)]]
            at = np.concatenate([over, level])
            keep_ids[r], keep[r] = ids[r, at], scores[r, at]
        ids, scores = keep_ids, keep
    order = np.lexsort((ids, ~scores), axis=1)  # ~ turns the order around without overflow
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows of ``vectors`` (vec_id, embedding) for each query.

    Queries are the rows for which ``is_query`` holds; all rows but the query's own are candidates. A component x counts
    as floor(scale * x), x as double; the score is the inner product; ties go to the smaller vec_id. Vectors that are null
    or empty, or that hold a null or non-finite component, and rows without vec_id take no part; only vectors of one
    length meet. Rows with a repeated vec_id are candidates of their own, for a query of that vec_id too, and a repeated
    query is answered as often as it occurs. Fewer candidates than ``k`` give fewer rows; other columns are ignored; an
    empty table gives an empty result.

    Lists hold one place more than is asked for, as the query's own row is among the candidates until the end: there one
    entry with its vec_id and its product with itself goes, or else the last.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.filter("vec_id is not null and embedding is not null")
    shards = store.written(packed(rows.select("vec_id", "embedding"), SHARD, scale), "topk-shards")
    asks = rows.filter("asks").select("vec_id", "embedding")
    asked = packed(asks.repartition(1 + asks.count() // BLOCK), BLOCK, scale).select(F.col("shard").alias("block"), "dim", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    asked = store.written(asked, "topk-queries")
    # Blocks in groups that can be broadcast: a row for each block is all that this window sees.
    bytes_ = (F.length("query_ids") + F.length("query_data")).cast("long")
    upto = F.sum("bytes").over(Window.orderBy("dim", "block").rowsBetween(Window.unboundedPreceding, -1))
    numbered = asked.select("block", "dim", bytes_.alias("bytes")).withColumn("group", F.floor(F.coalesce(upto, F.lit(0)) / BROADCAST_BYTES))
    groups = store.written(asked.join(F.broadcast(numbered.drop("bytes")), ["block", "dim"]), "topk-groups")
    order = sorted(r.group for r in groups.select("group").distinct().collect())

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                queries, ids = np.frombuffer(r["query_ids"], "int64"), np.frombuffer(r["ids"], "int64")
                asked_ = np.frombuffer(r["query_data"]).reshape(-1, r["dim"])
                scores = product(asked_, np.frombuffer(r["data"]).reshape(-1, r["dim"]))
                yield listed(r["block"], r["shard"], r["dim"], queries, lengths(asked_), *best(scores, np.broadcast_to(ids, scores.shape), k + 1))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, None
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                queries, own = (np.frombuffer(r[c], "int64") for c in ("queries", "own"))
                scores, ids = (np.frombuffer(r[c], "int64").reshape(len(queries), -1) for c in ("scores", "ids"))
                if at == (r["block"], r["shard"]):
                    kept = (*kept[:3], *best(np.hstack([kept[3], scores]), np.hstack([kept[4], ids]), k + 1))
                else:
                    if at is not None:
                        yield listed(*at, *kept)
                    at, kept = (r["block"], r["shard"]), (r["dim"], queries, own, scores, ids)
        if at is not None:
            yield listed(*at, *kept)

    path = store.new_path(shards.sparkSession, "topk-tiles")
    for group in order:
        tiles = shards.join(F.broadcast(groups.filter(F.col("group") == group)), "dim")
        tiles = map_arrow(tiles.select("block", "shard", "dim", "query_ids", "query_data", "ids", "data"), tile, LIST_SCHEMA)
        tiles.write.mode("append").option("compression", "zstd").parquet(path)
    if not order:
        return shards.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lists = shards.sparkSession.read.schema(LIST_SCHEMA).parquet(path)
    lists.gleaner_path = path
    parts = shards.count()
    while parts > 1:
        parts = math.ceil(parts / FAN)
        dealt = lists.withColumn("shard", F.pmod(F.xxhash64("shard", F.lit(parts)), F.lit(parts))).repartition("block", "shard").sortWithinPartitions("block", "shard")
        merged = store.written(map_arrow(dealt, merge, LIST_SCHEMA), "topk-lists")
        store.drop(lists)
        lists = merged

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                queries, own = (np.frombuffer(r[c], "int64") for c in ("queries", "own"))
                scores, ids = (np.frombuffer(r[c], "int64").reshape(len(queries), -1) for c in ("scores", "ids"))
                width = scores.shape[1] - 1
                same = (ids == queries[:, None]) & (scores == own[:, None])
                gone = np.where(same.any(axis=1), same.argmax(axis=1), width)  # the query's own row, or the last
                stay = np.arange(width + 1) != gone[:, None]
                ids, scores = ids[stay].reshape(-1, width), scores[stay].reshape(-1, width)
                real = (scores != LOW).ravel()
                cols = (np.repeat(queries, width), np.tile(np.arange(1, width + 1, dtype="int32"), len(queries)), ids.ravel(), scores.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(c[real]) for c in cols], ["query_id", "rank", "vec_id", "score"])

    return map_arrow(lists, rows_of, "query_id long, rank int, vec_id long, score long")


def listed(block: int, shard: int, dim: int, queries: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    row = {"block": block, "shard": shard, "dim": dim, "queries": queries.tobytes(), "own": own.tobytes(), "ids": np.ascontiguousarray(ids).tobytes(), "scores": np.ascontiguousarray(scores).tobytes()}
    types = [("block", pa.int64()), ("shard", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("queries", "own", "ids", "scores"))]
    return pa.RecordBatch.from_pylist([row], pa.schema(types))

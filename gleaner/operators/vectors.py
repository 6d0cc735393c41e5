"""Vectors as array columns: products, centroids, cluster geometry, axes, neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.resampling import draw

#: Groups of which all pairs are compared.
GROUPS = 2000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null for a vector of length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: F.try_divide(x, n))


def constant(v: Sequence[float]) -> Column:
    """A vector that the driver holds, as a literal."""
    return F.array(*[F.lit(float(x)) for x in v])


def sums(df: DataFrame, keys: Sequence[str], vector: Column) -> DataFrame:
    """keys, n and the vector sum of each group: one running vector per group and task. Rows without a vector do not count."""
    rows = df.filter(vector.isNotNull()).select(*keys, array_to_vector(vector.cast("array<double>")).alias("_v"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("_v"))).alias("sum"))


def centroids(df: DataFrame, keys: Sequence[str], vector: Column) -> DataFrame:
    """The mean vector and the number of rows of each group."""
    return sums(df, keys, vector).select(*keys, "n", F.transform("sum", lambda x: x / F.col("n")).alias("centroid"))


def spread(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean cosine distance of each group's rows from its centroid, and the group's share of all rows."""
    c = centroids(df, [key], F.col(vector))
    rows = df.select(key, F.col(vector).alias("_v")).join(F.broadcast(c) if c.count() <= 1000 else c, key)
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 - cosine(F.col("_v"), F.col("centroid"))), 6).alias("spread"))
    return out


def centroid_similarity(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The cosine of every pair of group centroids (a < b); over GROUPS groups raise an error, as their pairs are the result."""
    c = centroids(df, [key], F.col(vector)).filter(F.col(key).isNotNull())
    if c.count() > GROUPS:
        raise ValueError(f"over {GROUPS} groups: their pairs are too many")
    a, b = c.select(F.col(key).alias("a"), F.col("centroid").alias("_a")), c.select(F.col(key).alias("b"), F.col("centroid").alias("_b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("_a"), F.col("_b")), 6).alias("cosine"))


def mean_pairwise_cosine(df: DataFrame, key: str, vector: str, least: int = 2) -> DataFrame:
    """The mean cosine over all pairs of a group without forming pairs: of unit vectors, (|sum|^2 - n) / (n (n - 1))."""
    s = sums(df.withColumn("_u", unit(F.col(vector))), [key], F.col("_u")).select(key, "n", dot(F.col("sum"), F.col("sum")).alias("q"))
    return s.filter(F.col("n") >= least).select(key, "n", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


def nearest_to(df: DataFrame, uid: str, vector: str, anchor: Column, k: int) -> DataFrame:
    """The ``k`` rows with the highest cosine to an anchor; ties to the smaller uid."""
    return df.select(uid, cosine(F.col(vector), anchor).alias("cosine")).orderBy(F.desc_nulls_last("cosine"), uid).limit(k)


def projection(vector: Column, axis: Sequence[float]) -> Column:
    return dot(vector, constant(axis))


def difference_axis(differences: np.ndarray) -> np.ndarray:
    """The first singular direction of a few difference vectors, not centred, pointing their way."""
    _, _, vt = np.linalg.svd(np.asarray(differences, float), full_matrices=False)
    axis = vt[0]
    return axis if float(np.asarray(differences, float).sum(axis=0) @ axis) >= 0 else -axis


def differential_association(vector: Column, a: Sequence[float], b: Sequence[float]) -> Column:
    """How much nearer a vector is to one centroid than to another."""
    return cosine(vector, constant(a)) - cosine(vector, constant(b))


def assignment(cost: np.ndarray) -> list[int]:
    """The column of each row in the cheapest one-to-one assignment of a small matrix with rows <= columns.

    Shortest augmenting paths with potentials (the Hungarian method).
    """
    cost = np.asarray(cost, float)
    n, m = cost.shape
    row_gain, col_gain, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j, best, back, done = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j]:
            done[j] = True
            slack = cost[owner[j] - 1] - row_gain[owner[j]] - col_gain[1:]
            free = ~done[1:]
            closer = free & (slack < best[1:])
            best[1:][closer], back[1:][closer] = slack[closer], j
            nxt = 1 + int(np.argmin(np.where(free, best[1:], np.inf)))
            step = best[nxt]
            row_gain[owner[done]] += step
            col_gain[done] -= step
            best[~done] -= step
            j = nxt
        while j:
            owner[j], j = owner[back[j]], back[j]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def leave_one_out(pairs: Sequence[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, float, float]]:
    """For each pair (a, b, difference): the cosine of the axis without it and the axis of all, and the part of the pair's
    own difference along the axis that it had no say in."""
    whole = difference_axis(np.array([d for *_, d in pairs]))
    out = []
    for i, (a, b, d) in enumerate(pairs):
        rest = np.array([x for j, (*_, x) in enumerate(pairs) if j != i])
        axis = difference_axis(rest) if len(rest) else whole
        axis = axis if axis @ whole >= 0 else -axis
        out.append((a, b, round(float(axis @ whole), 9), round(float(d @ axis / max(np.linalg.norm(d), 1e-300)), 9)))
    return out


def drift_test(df: DataFrame, uid: str, key: str, later: Column, vector: str, reps: int, seed: int = 0) -> DataFrame:
    """Per group the distance between the centroids of two eras, and the share of ``reps`` relabelings of the group's rows,
    each drawn with the group's share of later rows as its chance, with one at least as large (both plus one)."""
    rows = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(uid).alias("u"), F.col(key).alias("k"), later.alias("l"), F.col(vector).alias("v"))
    rows = rows.join(rows.groupBy("k").agg(F.avg(F.col("l").cast("int")).alias("chance")), "k")
    reps_ = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))  # replicate 0 is what was seen
    drawn = F.when(F.col("rep") == 0, F.col("l")).otherwise(draw(F.col("u"), F.col("rep"), F.lit(seed)) < F.col("chance"))
    both = centroids(reps_.withColumn("l", drawn), ["k", "rep", "l"], F.col("v")).groupBy("k", "rep").agg(F.max(F.when(F.col("l"), F.col("centroid"))).alias("a"), F.max(F.when(~F.col("l"), F.col("centroid"))).alias("b"))
    gaps = both.select("k", "rep", norm(F.zip_with("a", "b", lambda x, y: x - y)).alias("d"))
    seen = gaps.filter("rep = 0").select("k", F.col("d").alias("drift"))
    out = gaps.filter("rep > 0").join(seen, "k").groupBy("k", "drift")
    return out.agg(F.count("d").alias("reps"), F.round((F.count_if(F.col("d") >= F.col("drift") - 1e-12) + 1) / (F.count("d") + 1), 6).alias("p")).select(F.col("k").alias(key), F.round("drift", 6).alias("drift"), "reps", "p")

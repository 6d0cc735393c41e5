"""Bootstrap and permutation by hashes: replicates are a column, so they run side by side and come out the same anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cumulative Poisson(1) probabilities: how often a row is drawn in a bootstrap replicate.
_POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def draw(*key: Column) -> Column:
    """A number from 0 to 1 that follows from the key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)


def poisson_weight(u: Column) -> Column:
    out = F.when(u < _POISSON[0], 0)
    for k, p in enumerate(_POISSON[1:], 1):
        out = out.when(u < p, k)
    return out.otherwise(len(_POISSON))


def bootstrap_difference(df: DataFrame, uid: str, group: Column, value: Column, reps: int, seed: int = 0) -> DataFrame:
    """The difference of means (group minus others), and its 95 % interval over ``reps`` replicates.

    A replicate weighs each row by a Poisson draw; sums are taken on the map side, so a row is read once and what is
    shuffled are ``reps`` rows per task.
    """
    rows = df.filter(value.isNotNull()).select(F.col(uid).alias("u"), group.alias("g"), value.cast("double").alias("x"))
    one = rows.agg((F.avg(F.when(F.col("g"), F.col("x"))) - F.avg(F.when(~F.col("g"), F.col("x")))).alias("difference"))
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", poisson_weight(draw(F.col("u"), F.col("rep"), F.lit(seed))))
    part = lambda c: (F.sum(F.when(c, F.col("w") * F.col("x"))), F.sum(F.when(c, F.col("w"))))
    (a, n), (b, m) = part(F.col("g")), part(~F.col("g"))
    reps_ = drawn.groupBy("rep").agg((F.try_divide(a, n) - F.try_divide(b, m)).alias("d"))
    span = reps_.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.count("d").alias("reps"))
    return one.crossJoin(F.broadcast(span)).select(*[F.round(c, 6).alias(c) for c in ("difference", "low", "high")], "reps")


def permutation_test(df: DataFrame, uid: str, group: Column, value: Column, reps: int, seed: int = 0, cluster: str | None = None) -> DataFrame:
    """The difference of means and the share of ``reps`` relabelings with one at least as far from 0 (both plus one).

    A relabeling gives each row the group's label by a draw, with the group's share of the rows as its chance; with
    ``cluster`` the share of the row's own cluster, so that what clusters differ in stays. Sums are taken on the map side:
    rows are neither sorted nor moved.
    """
    held = [F.col(cluster).alias("c")] if cluster else [F.lit(0).alias("c")]
    rows = df.filter(value.isNotNull()).select(F.col(uid).alias("u"), *held, group.alias("g"), value.cast("double").alias("x"))
    chances = rows.groupBy("c").agg(F.avg(F.col("g").cast("int")).alias("chance"))
    rows = rows.join(chances if cluster else F.broadcast(chances), "c")  # one row without clusters
    one = rows.agg((F.avg(F.when(F.col("g"), F.col("x"))) - F.avg(F.when(~F.col("g"), F.col("x")))).alias("difference"))
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("l", draw(F.col("u"), F.col("rep"), F.lit(seed)) < F.col("chance"))
    gaps = drawn.groupBy("rep").agg((F.avg(F.when(F.col("l"), F.col("x"))) - F.avg(F.when(~F.col("l"), F.col("x")))).alias("d"))
    out = gaps.crossJoin(F.broadcast(one)).withColumn("far", F.abs("d") >= F.abs("difference") - 1e-12)  # one row
    return out.groupBy(F.round("difference", 6).alias("difference")).agg(F.count("d").alias("reps"), F.round((F.count_if("far") + 1) / (F.count("d") + 1), 6).alias("p"))


def stratified_bootstrap(df: DataFrame, uid: str, stratum: str, value: Column, reps: int, seed: int = 0) -> DataFrame:
    """The mean, each stratum weighing as its share of the rows, and its 95 % interval over ``reps`` replicates in which
    every stratum is drawn by itself."""
    rows = df.filter(value.isNotNull() & F.col(stratum).isNotNull()).select(F.col(uid).alias("u"), F.col(stratum).alias("s"), value.cast("double").alias("x"))
    sizes = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", poisson_weight(draw(F.col("u"), F.col("rep"), F.lit(seed))))
    cells = drawn.groupBy("rep", "s").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("m")).join(sizes, "s").filter("m is not null")
    means = cells.groupBy("rep").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("d"))
    span = means.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.count("d").alias("reps"))
    return rows.agg(F.avg("x").alias("mean")).crossJoin(F.broadcast(span)).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "reps")  # one row each


def did_interval(df: DataFrame, uid: str, treated: Column, later: Column, value: Column, reps: int, seed: int = 0) -> DataFrame:
    """The difference in differences of means, and its 95 % interval over ``reps`` replicates."""
    rows = df.filter(value.isNotNull()).select(F.col(uid).alias("u"), treated.alias("t"), later.alias("l"), value.cast("double").alias("x"))

    def did(mean) -> Column:
        t, l = F.col("t"), F.col("l")  # noqa: E741
        return (mean(t & l) - mean(t & ~l)) - (mean(~t & l) - mean(~t & ~l))

    one = rows.agg(did(lambda c: F.avg(F.when(c, F.col("x")))).alias("did"))
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", poisson_weight(draw(F.col("u"), F.col("rep"), F.lit(seed))))
    weighed = lambda c: F.try_divide(F.sum(F.when(c, F.col("w") * F.col("x"))), F.sum(F.when(c, F.col("w"))))
    span = drawn.groupBy("rep").agg(did(weighed).alias("d")).agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.count("d").alias("reps"))
    return one.crossJoin(F.broadcast(span)).select(*[F.round(c, 6).alias(c) for c in ("did", "low", "high")], "reps")  # one row each


def jackknife(df: DataFrame, cluster: str, value: Column) -> DataFrame:
    """The mean, its standard error by leaving out one cluster at a time, and the clusters: from a row for each cluster."""
    parts = df.filter(value.isNotNull() & F.col(cluster).isNotNull()).groupBy(cluster).agg(F.sum(value.cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = parts.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("k"))
    left = parts.crossJoin(F.broadcast(whole)).withColumn("m", F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")))  # one row
    out = left.agg(F.max(F.col("all_s") / F.col("all_n")).alias("mean"), F.var_pop("m").alias("v"), F.max("k").alias("clusters"))
    return out.select(F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.col("v") * (F.col("clusters") - 1)), 6).alias("se"), "clusters")

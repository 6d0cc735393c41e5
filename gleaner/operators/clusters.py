"""Agreement of clusterings, co-occurrence of features, matrices of technologies, emergence, communities."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _choose2(c: Column) -> Column:
    return c.cast("double") * (c - 1) / 2


def clustering_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index and the normalised mutual information (arithmetic mean) of two labelings."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("x"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("y"))
    total = cells.agg(F.sum("n").alias("t"))
    joint = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("t")
    one = joint.agg(F.sum(_choose2(F.col("n"))).alias("same"), F.sum(p * F.ln(F.col("n").cast("double") * F.col("t") / (F.col("x") * F.col("y")))).alias("mi"), F.max("t").alias("t"))
    two = rows.crossJoin(F.broadcast(total)).agg(F.sum(_choose2(F.col("x"))).alias("sx"), (-F.sum(F.col("x") / F.col("t") * F.ln(F.col("x") / F.col("t")))).alias("hx"))
    three = cols.crossJoin(F.broadcast(total)).agg(F.sum(_choose2(F.col("y"))).alias("sy"), (-F.sum(F.col("y") / F.col("t") * F.ln(F.col("y") / F.col("t")))).alias("hy"))
    out = one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))
    chance = F.col("sx") * F.col("sy") / _choose2(F.col("t"))
    ari = F.try_divide(F.col("same") - chance, (F.col("sx") + F.col("sy")) / 2 - chance)
    return out.select(F.col("t").alias("n"), F.round(ari, 6).alias("ari"), F.round(F.try_divide(F.col("mi"), (F.col("hx") + F.col("hy")) / 2), 6).alias("nmi"))


def feature_matrix(df: DataFrame, uid: str, text: Column, patterns: Mapping[str, str], width: int = 50) -> DataFrame:
    """A boolean column per pattern over the text; columns are added in groups, to keep generated methods small."""
    out = df.withColumn("_t", text)
    names = list(patterns)
    for i in range(0, len(names), width):
        out = out.withColumns({n: F.coalesce(F.col("_t").rlike(patterns[n]), F.lit(False)) for n in names[i : i + width]})
    return out.select(uid, *names)


def unescaped(c: Column) -> Column:
    """Text without backslashes before marks, so that names such as c++ or .net can be matched."""
    return F.regexp_replace(c, r"\\([+#.\-*_&])", "$1")


def cooccurrence(df: DataFrame, uid: str, features: Column) -> DataFrame:
    """The phi coefficient of every pair of features that occur together; ``features``: an array per row.

    Pairs are formed within a row, whose features are a few of a fixed vocabulary.
    """
    rows = df.select(F.col(uid).alias("uid"), F.array_sort(F.array_distinct(features)).alias("f"))
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    one = rows.select(F.explode("f").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    pairs = rows.select("f", F.posexplode("f").alias("i", "a")).select("a", F.explode(F.expr("slice(f, i + 2, size(f))")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    out = pairs.join(one.select(F.col("x").alias("a"), F.col("n").alias("n_a")), "a").join(one.select(F.col("x").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(F.broadcast(total))
    t, x, y = (F.col(c).cast("double") for c in ("t", "n_a", "n_b"))
    phi = F.try_divide(t * F.col("n_both") - x * y, F.sqrt(x * y * (t - x) * (t - y)))
    npmi = F.try_divide(F.ln(t * F.col("n_both") / (x * y)), -F.ln(F.col("n_both") / t))
    return out.select("a", "b", "n_both", F.round(phi, 6).alias("phi"), F.round(npmi, 6).alias("npmi"))


def communities(edges: Sequence[tuple[str, str, float]]) -> dict[str, int]:
    """Communities of a small weighted graph: nodes move to the neighbouring community of the highest modularity gain,
    in order of name, until none moves; communities are numbered by their first node."""
    near: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    degree = {v: sum(ws.values()) for v, ws in near.items()}
    m2 = sum(degree.values())
    home = {v: v for v in near}
    total = dict(degree)
    moved = True
    while moved:
        moved = False
        for v in sorted(near):
            links: dict[str, float] = defaultdict(float)
            for u, w in near[v].items():
                links[home[u]] += w
            old = home[v]
            total[old] -= degree[v]
            gain = {c: links[c] - total[c] * degree[v] / m2 for c in {*links, old}}
            best = max(sorted(gain), key=lambda c: (gain[c] > gain[old] + 1e-12, gain[c]))
            home[v] = best if gain[best] > gain[old] + 1e-12 else old
            total[home[v]] += degree[v]
            moved |= home[v] != old
    names = sorted(set(home.values()), key=lambda c: min(v for v in home if home[v] == c))
    return {v: names.index(c) for v, c in home.items()}


def alert_metrics(daily: DataFrame, day: str, site: str, n: str, kept: str) -> DataFrame:
    """Flags per site and day: rows against the mean of the seven days before, share dropped by dedupe, no rows."""
    before = Window.partitionBy(site).orderBy(day).rowsBetween(-7, -1)
    out = daily.withColumn("mean7", F.avg(n).over(before)).withColumn("dropped", 1 - F.try_divide(F.col(kept).cast("double"), F.col(n)))
    flags = F.array_compact(F.array(F.when(F.col(n) < 0.5 * F.col("mean7"), "low_volume"), F.when(F.col("dropped") > 0.9, "mostly_duplicates"), F.when(F.col(n) == 0, "no_rows")))
    return out.select(day, site, n, F.round("mean7", 6).alias("mean7"), F.round("dropped", 6).alias("dropped"), F.array_join(flags, "|").alias("flags"))


def cache_hit_rates(candidates: DataFrame, cache: DataFrame, key: str, group: str) -> DataFrame:
    """Distinct keys per group and how many of them the cache holds."""
    keys = candidates.select(group, key).distinct().join(cache.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return keys.groupBy(group).agg(F.count(F.lit(1)).alias("keys"), F.count("_hit").alias("cached"), F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("hit_rate"))


def quantile_bins(df: DataFrame, value: str, q: int, name: str = "bin") -> DataFrame:
    """Bins between the exact quantiles of a column; equal values share a bin. The edges are one row."""
    edges = df.agg(F.array_sort(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / q) for i in range(q + 1)])))).alias("_e"))
    rows = df.crossJoin(F.broadcast(edges))
    at = F.greatest(F.size(F.filter("_e", lambda e: e < F.col(value))) - 1, F.lit(0))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), at)).drop("_e")


def entropy_bits(counts: Sequence[int]) -> float:
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c) if total else 0.0

"""Deduplication of postings: exact keys, near-duplicate titles, openings at several places, funnel counts."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Sequence
from heapq import merge

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.ship import ship
from gleaner.functions.similarity import near_titles
from gleaner.operators.relational import first_per_key

def drop_repeated(df: DataFrame, keys: Sequence[str], order: Sequence[Column], need: Column | None = None) -> DataFrame:
    """Of rows with equal keys the first in the given order; rows for which ``need`` does not hold all stay.

    One pass: rows that stay anyway are dealt out by a hash of their order, so they make no large group.
    """
    if need is None:
        return first_per_key(df, keys, order)
    need = F.coalesce(need, F.lit(False))
    rows = df.withColumn("_alone", F.when(~need, F.xxhash64(*[F.struct(o) for o in order])))
    rank = F.row_number().over(Window.partitionBy(*keys, "_alone").orderBy(*order))
    return rows.withColumn("_rank", rank).filter((F.col("_rank") == 1) | F.col("_alone").isNotNull()).drop("_alone", "_rank")


def near_groups(titles: Sequence[str]) -> dict[str, list[str]]:
    """For each of the distinct titles those that are near it, itself included.

    Near titles have at least 3/8 of their letters, in order, in common; so titles are compared only where their lengths
    and the letters that they share, in any order, allow it.
    """
    order = sorted({t for t in titles if t}, key=len)
    letters, lengths = {t: Counter(t) for t in order}, [len(t) for t in order]
    near = {t: [t] for t in order}
    for i, t in enumerate(order):
        for u in order[i + 1 : bisect_right(lengths, len(t) * 5 / 3)]:
            if 8 * sum((letters[t] & letters[u]).values()) >= 3 * (len(t) + len(u)) and near_titles(t, u):
                near[t].append(u), near[u].append(t)
    return near


def near_duplicates(df: DataFrame, keys: Sequence[str], uid: str, order: str, title: str, rank: Sequence[str]) -> DataFrame:
    """The uids that near-duplicate titles within a group of equal ``keys`` drop.

    In ascending ``order``, each row meets those behind it; of two near titles the one with the higher ``rank`` columns
    stays, of equals the earlier. Distinct titles of a group are what is compared, so a group of a thousand rows with
    three titles costs three comparisons; groups of any size are done whole.
    """
    ship(df.sparkSession)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.select(*keys, F.col(uid).alias("uid"), F.col(order).alias("seq"), F.col(title).alias("title"), F.struct(*rank).alias("_rank"))
    rows = rows.withColumn("_n", size).filter(F.col("_n") >= 2).select(*keys, "uid", "seq", "title", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_rank")).alias("rank"))

    def drops(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["seq", "uid"])
        uids, titles, ranks = rows["uid"].tolist(), rows["title"].tolist(), rows["rank"].tolist()
        near, places, gone = near_groups(titles), defaultdict(list), [False] * len(uids)
        for i, t in enumerate(titles):
            places[t].append(i)
        for i, t in enumerate(titles):
            if gone[i] or t not in near:
                continue
            for j in merge(*(places[u][bisect_right(places[u], i) :] for u in near[t])):
                if gone[j]:
                    continue
                if ranks[j] > ranks[i]:
                    gone[i] = True
                    break
                gone[j] = True
        return pd.DataFrame({"uid": [u for u, g in zip(uids, gone, strict=True) if g]}, dtype=rows["uid"].dtype)

    kind = df.schema[uid].dataType.simpleString()
    return rows.groupBy(*keys).applyInPandas(drops, f"uid {kind}")


def collapse_places(df: DataFrame, keys: Sequence[str], place: str, uid: str, label: str = "multi-location", clear: Sequence[str] = ()) -> DataFrame:
    """Of groups of equal ``keys`` with two places or more the row with the smallest uid, its place set to ``label`` and
    the ``clear`` columns to null; other groups stay as they are."""
    groups = df.groupBy(*keys).agg(F.count_distinct(place).alias("_places"), F.min(uid).alias("_first"))
    rows = df.join(groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_places", "_first"), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    many = F.col("_places") >= 2
    rows = rows.filter(~many | (F.col(uid) == F.col("_first")))
    return rows.select(*[F.when(many, F.lit(label)).otherwise(F.col(c)).alias(c) if c == place else F.when(~many, F.col(c)).alias(c) if c in clear else F.col(c) for c in df.columns])


def canonical_and_observations(df: DataFrame, uid: str, seen: str, tie: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The earliest row of each uid, and (uid, day seen) pairs, each once."""
    return first_per_key(df, [uid], [F.col(seen).asc_nulls_last(), *[F.col(t) for t in tie]]), df.select(uid, seen).distinct()


def funnel(df: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Per key the rows at the start and after each step; a flag holds if the row passed that step and all before."""
    out, passed = [F.count(F.lit(1)).alias("raw")], F.lit(True)
    for f in flags:
        passed = passed & F.col(f)
        out.append(F.count_if(passed).alias(f"after_{f}"))
    return df.groupBy(key).agg(*out)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``table`` with ``changes`` written over it: per key the row with the highest version, of equals the changed one."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return first_per_key(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def two_levels(df: DataFrame, snapshot: Sequence[str], posting: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """The first row of each ``snapshot`` key, in the given order, and in ``name`` whether it is the first of its ``posting`` key.

    The second rank runs over what the first has left, and the keys of the second are among those of the first: both take
    one shuffle by ``posting``.
    """
    kept = first_per_key(df.repartition(*posting), snapshot, order)
    return kept.withColumn(name, F.row_number().over(Window.partitionBy(*posting).orderBy(*order)) == 1)

"""Relational building blocks: rates, shares, ranks, caps, samples, panels.

All are plain DataFrame plans: partial aggregation before each shuffle, one shuffle per grouping, windows only over
groups that the caller names. Nothing here collects or broadcasts by itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(numerator: Column, digits: int = 6) -> Column:
    """The share of rows for which ``numerator`` holds, null over no rows."""
    return F.round(F.try_divide(F.sum(F.when(numerator, 1).otherwise(0)).cast("double"), F.count(F.lit(1))), digits)


def conditional_rates(df: DataFrame, keys: Sequence[str], predicates: Mapping[str, Column]) -> DataFrame:
    """Per group: n, and for each named predicate its count and rate, in one pass."""
    measures = [F.count(F.lit(1)).alias("n")]
    for name, p in predicates.items():
        measures += [F.sum(F.when(p, 1).otherwise(0)).cast("long").alias(f"{name}_n"), rate(p).alias(f"{name}_rate")]
    return df.groupBy(*keys).agg(*measures)


def slices(df: DataFrame, variants: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    """One row per named row filter, its measures taken over the rows that pass: the input is read once.

    ``measures`` are counted predicates; each becomes a count over the slice.
    """
    total = df.agg(*[F.sum(F.when(v & m, 1).otherwise(0)).cast("long").alias(f"{a}\x1f{b}") for a, v in variants.items() for b, m in measures.items()])
    rows = [F.struct(F.lit(a).alias("slice"), *[F.coalesce(F.col(f"`{a}\x1f{b}`"), F.lit(0)).alias(b) for b in measures]) for a in variants]
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def hashed_order(*key: str | Column, seed: str = "") -> Column:
    """A pseudorandom but fixed order: md5 of the key and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key], F.lit(seed)))


def capped(df: DataFrame, keys: Sequence[str], uid: str, most: int, seed: str = "") -> DataFrame:
    """At most ``most`` rows of each group, chosen by a hash of ``uid``."""
    return first_per_key(df, keys, [hashed_order(uid, seed=seed), F.col(uid)], most)


def hash_sample(df: DataFrame, uid: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows by hash order: the same rows whatever the partitioning."""
    return df.orderBy(hashed_order(uid, seed=seed), F.col(uid)).limit(n)


def stratified_sample(df: DataFrame, strata: Sequence[str], uid: str, per_stratum: int, seed: str = "") -> DataFrame:
    return capped(df, strata, uid, per_stratum, seed)


def shares(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Counts per key and their share of all rows, or of the rows of the ``within`` part of the key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts per key in a column for each of the given values, zeros included."""
    measures = [F.sum(F.when(F.col(column) == v, 1).otherwise(0)).cast("long").alias(f"n_{v}") for v in values]
    return df.groupBy(key).agg(*measures)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in values], name, value)


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], column: str, default: Column, name: str) -> DataFrame:
    """A dictionary lookup with a default: a left join and a coalesce."""
    found = table.select(*on, F.col(column).alias("_found")).dropDuplicates(list(on))
    return df.join(found, list(on), "left").withColumn(name, F.coalesce("_found", default)).drop("_found")


def membership(df: DataFrame, table: DataFrame, on: str, name: str) -> DataFrame:
    """Whether the key is in ``table``, as a column: a join with its distinct keys."""
    keys = table.select(F.col(on)).filter(F.col(on).isNotNull()).distinct().withColumn("_in", F.lit(True))
    return df.join(keys, on, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def lifespan(df: DataFrame, uid: str, ts: str) -> DataFrame:
    """First and last day, days between, and number of observations of each uid."""
    day = F.to_date(ts)
    out = df.groupBy(uid).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n_obs"), F.count_distinct(day).alias("n_days"))
    return out.withColumn("span_days", F.datediff("last_day", "first_day").cast("long"))


def rolling_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, name: str, least: int | None = None) -> DataFrame:
    """The mean of the last ``width`` rows, null where fewer than ``least`` (all, by default) are there."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(1 - width, 0)
    enough = F.count(value).over(w) >= (width if least is None else least)
    return df.withColumn(name, F.when(enough, F.round(F.avg(value).over(w), 6)))


def within_panel(df: DataFrame, unit: str, era: Column, value: Column, least: int) -> DataFrame:
    """Units with at least ``least`` rows in both eras (``era`` true: the later one): means and their difference."""
    out = df.groupBy(unit).agg(
        F.count(F.when(~era, 1)).alias("n_before"), F.count(F.when(era, 1)).alias("n_after"), F.avg(F.when(~era, value)).alias("mean_before"), F.avg(F.when(era, value)).alias("mean_after")
    )
    out = out.filter((F.col("n_before") >= least) & (F.col("n_after") >= least))
    return out.withColumn("delta", F.round(F.col("mean_after") - F.col("mean_before"), 6)).withColumn("mean_before", F.round("mean_before", 6)).withColumn("mean_after", F.round("mean_after", 6))


def null_rates(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Share of nulls per group and column."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"{c}_null_rate") for c in columns])


def facet(df: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values of a column with their counts."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)


def where(filters: Sequence[tuple[str, str, object]], search: str = "", search_columns: Sequence[str] = ()) -> Column:
    """A predicate from (column, operation, value) filters and a text that any of some columns must contain.

    Operations: eq, in (null in the list matches null), ge, le, between, contains, is_null, not_null.
    """
    out = F.lit(True)
    for column, op, value in filters:
        c = F.col(column)
        if op == "eq":
            test = c == value
        elif op == "in":
            test = c.isin([v for v in value if v is not None])
            test = test | c.isNull() if None in value else test
        elif op == "ge":
            test = c >= value
        elif op == "le":
            test = c <= value
        elif op == "between":
            test = c.between(*value)
        elif op == "contains":
            test = F.contains(F.lower(c), F.lit(str(value).lower()))
        elif op in ("is_null", "not_null"):
            test = c.isNull() if op == "is_null" else c.isNotNull()
        else:
            raise ValueError(f"unknown operation {op!r}")
        out = out & test
    if search and search_columns:
        hit = F.lit(False)
        for column in search_columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(column).cast("string")), F.lit(search.lower())), F.lit(False))
        out = out & hit
    return out

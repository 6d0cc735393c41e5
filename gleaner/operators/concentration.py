"""Concentration of counts over units: Herfindahl index, Gini coefficient, top-k shares, Lorenz curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _group(keys: Sequence[str]) -> list:
    return list(keys) or [F.lit(0)]


def concentration(df: DataFrame, unit: str, keys: Sequence[str] = (), tops: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Per group: units, rows, HHI (0 to 1), Gini and the shares of the largest units. Null units are left out."""
    counts = df.filter(F.col(unit).isNotNull()).groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(*_group(keys)).orderBy("c", unit)
    down = Window.partitionBy(*_group(keys)).orderBy(F.desc("c"), unit)
    ranked = counts.withColumn("i", F.row_number().over(up)).withColumn("r", F.row_number().over(down))
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("c").alias("rows"),
        F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"),
        F.sum(F.col("i").cast("double") * F.col("c")).alias("ranked"),
        *[F.sum(F.when(F.col("r") <= k, F.col("c")).otherwise(0)).alias(f"top{k}") for k in tops],
    )
    n, total = F.col("units"), F.col("rows")
    return out.select(
        *keys,
        "units",
        "rows",
        F.round(F.col("squares") / (total * total), 6).alias("hhi"),
        F.round(2 * F.col("ranked") / (n * total) - (n + 1) / n, 6).alias("gini"),
        *[F.round(F.col(f"top{k}") / total, 6).alias(f"top{k}_share") for k in tops],
    )


def lorenz(df: DataFrame, unit: str) -> DataFrame:
    """The cumulative share of rows by units in ascending order of size: one row per distinct size."""
    counts = df.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("units"), F.sum("c").alias("rows"))
    run = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct size
    whole = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sizes.select(
        F.col("c").alias("size"),
        F.round(F.sum("units").over(run) / F.sum("units").over(whole), 6).alias("unit_share"),
        F.round(F.sum("rows").over(run) / F.sum("rows").over(whole), 6).alias("row_share"),
    )

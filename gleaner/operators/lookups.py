"""Lookup tables that are built from the data themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import occupation as oc
from gleaner.functions import text as tx


def modal_values(df: DataFrame, key: str, value: str, high: float = 0.95, medium: float = 0.75, least: int = 2, least_high: int = 3) -> DataFrame:
    """key, its most frequent value (ties to the smaller) and how sure it is: high or medium by the value's share; other
    keys, and those with under ``least`` rows, have none."""
    counts = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    best = counts.withColumn("n", F.sum("c").over(Window.partitionBy("key"))).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c"), "value")))
    share = F.col("c") / F.col("n")
    level = F.when((share >= high) & (F.col("n") >= least_high), "high").when(share >= medium, "medium")
    return best.filter(F.col("r") == 1).filter(F.col("n") >= least).select("key", "value", level.alias("confidence")).filter("confidence is not null")


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with one value only, and that value."""
    out = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("value"))
    return out.filter("_n = 1").drop("_n")


def curated_labels(df: DataFrame, title: str, label: str, allowed: Sequence[str]) -> DataFrame:
    """key and label of a curated table: titles as technical keys, each key with one label.

    A column that is missing, or a label that is not allowed, raises an error; keys with several labels and empty keys go.
    """
    missing = {title, label} - set(df.columns)
    if missing:
        raise ValueError(f"the curated table lacks {sorted(missing)}")
    rows = df.select(tx.technical_title_key(F.col(title)).alias("key"), F.trim(F.col(label).cast("string")).alias("label"))
    wrong = rows.filter(F.col("label").isNull() | ~F.col("label").isin(*allowed)).select("label").distinct().limit(10).collect()
    if wrong:
        raise ValueError(f"labels that are not allowed: {sorted(str(r.label) for r in wrong)}")
    found = rows.filter("key <> ''").groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    return found.filter("label = other").select("key", "label")


def occupations(df: DataFrame, title: str, curated: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """``df`` with is_swe, is_swe_adjacent, is_control, confidence, tier, level and level_source of its titles.

    Each distinct title is judged once. ``curated``: key, label; ``similarity``: key, similarity, of keys to known titles.
    """
    raw = F.lower(F.trim(F.col(title)))
    titles = df.filter(raw != "").select(raw.alias("_raw")).distinct().withColumn("key", tx.technical_title_key(F.col("_raw")))
    titles = titles.join(curated.select("key", F.col("label").alias("_label")), "key", "left")
    titles = titles.withColumn("similarity", F.lit(None).cast("double")) if similarity is None else titles.join(similarity, "key", "left")
    titles = titles.withColumn("o", oc.occupation(F.col("key"), F.col("_raw"), F.col("_label"), F.col("similarity")))
    flags = oc.exclusive(F.col("o.is_swe"), F.col("o.is_swe_adjacent"), F.col("_raw").rlike(oc.CONTROL))
    titles = titles.withColumn("f", flags)
    titles = titles.withColumn("l", oc.title_level(F.col("_raw"), oc.family(F.col("f.is_swe"), F.col("f.is_swe_adjacent"), F.col("_raw").rlike(oc.CONTROL))))
    told = titles.select("_raw", "f.is_swe", "f.is_swe_adjacent", "f.is_control", "o.confidence", "o.tier", "l.level", F.col("l.source").alias("level_source"))
    return df.withColumn("_title", raw).join(told, F.col("_title") == F.col("_raw"), "left").drop("_title", "_raw")


def with_fallback(df: DataFrame, table: DataFrame, keys: Sequence[str], fewer: Sequence[str], value: str, name: str = "how") -> DataFrame:
    """``df`` with ``value`` looked up by ``keys``; where that finds nothing by ``fewer`` of them, if they have one value only.

    ``name`` says how: exact, fallback or none.
    """
    exact = table.groupBy(*keys).agg(F.min(value).alias("_exact"))
    alone = table.groupBy(*fewer).agg(F.min(value).alias("_alone"), F.count_distinct(value).alias("_n")).filter("_n = 1").drop("_n")
    out = df.join(exact, list(keys), "left").join(alone, list(fewer), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alone").isNotNull(), "fallback").otherwise("none")
    return out.select(*df.columns, F.coalesce("_exact", "_alone").alias(value), how.alias(name))


def metro_reference(cities: DataFrame, titles: DataFrame, geocoded: DataFrame, counties: DataFrame, wider: DataFrame) -> DataFrame:
    """city, state, metro and confidence for each of ``cities`` (city, state).

    By the title of a metro (medium; ``titles``: city, state, metro), else by the county that a geocoder found (high;
    ``geocoded``: city, state, county; ``counties``: county, metro), else by a wider title (medium; ``wider``); else low.
    A table with several metros for a key takes the smallest.
    """
    keys = ["city", "state"]
    one = lambda t, name: t.groupBy(*keys).agg(F.min("metro").alias(name))
    by_county = geocoded.join(counties.groupBy("county").agg(F.min("metro").alias("metro")), "county")
    out = cities.join(one(titles, "_t"), keys, "left").join(one(by_county, "_c"), keys, "left").join(one(wider, "_w"), keys, "left")
    level = F.when(F.col("_t").isNotNull(), "medium").when(F.col("_c").isNotNull(), "high").when(F.col("_w").isNotNull(), "medium").otherwise("low")
    return out.select(*keys, F.coalesce("_t", "_c", "_w").alias("metro"), level.alias("confidence"))

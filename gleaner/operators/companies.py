"""One name for each company: groups of names that are equal when made comparable, aliases, and fuzzy matches.

Names are counted first, so the work follows the number of distinct names, not of rows. Fuzzy matches are looked for only
among names with one beginning; a comparison costs something only where lengths and letters let it reach the threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import company as co
from gleaner.functions.ship import ship
from gleaner.functions.similarity import company_score, company_threshold, ratio

_GENERIC, _PUBLIC, _PROTECTED = frozenset(co.GENERIC), frozenset(co.PUBLIC_BODIES), frozenset(co.PROTECTED)
_LITTLE = frozenset({"&", "of", "the", "in", "at", "for"})


def is_plural(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=len)
    return long in (short, short + "s", short + "es")


def may_be_one(a: str, b: str) -> bool:
    """Whether two names that are alike as strings can name one company, by the words that they share and do not."""
    x, y = set(a.split()), set(b.split())
    if len(x) == 1 or len(y) == 1:
        return x == y
    both, mine, yours = x & y, x - y, y - x
    public = bool(both & _PUBLIC)
    one_each = len(mine) == len(yours) == 1
    (p,), (q,) = (mine, yours) if one_each else (("",), ("",))
    telling = (mine or yours) - _GENERIC - _LITTLE
    no = (
        len(both) <= 1 and min(len(x), len(y)) <= 2,
        bool(both) and not both - _GENERIC,
    )
    if any(no):
        return False
    if not mine and not yours or one_each and is_plural(p, q):
        return True
    never = (
        bool(both and mine and yours) and public and any(c.isdigit() for w in mine | yours for c in w),
        bool(both and mine and yours) and public and all(len(w) <= 12 for w in mine | yours),
        one_each and len(both) >= 3 and min(len(p), len(q)) >= 3 and ratio(p, q) < 75,
        one_each and 1 <= len(both) <= 2 and min(len(p), len(q)) >= 4 and ratio(p, q) < 85,
        public and bool(mine) != bool(yours) and any(len(w) >= 3 for w in telling),
    )
    return not any(never)


def _may_reach(a: str, b: str, letters: dict[str, Counter], least: float) -> bool:
    """Whether the score of two names can reach ``least``: their common letters bound two of its three parts."""
    bound = 200.0 * min(len(a), len(b)) / (len(a) + len(b))
    if 40 + 0.6 * bound < least:
        return False
    common = sum((letters[a] & letters[b]).values())
    return 40 + 0.6 * min(100.0, 200.0 * (common + a.count(" ") + b.count(" ")) / (len(a) + len(b))) >= least


def matched(names: list[str]) -> dict[str, str]:
    """Which of the names, the most frequent first, another one before it stands for.

    Each name joins the most similar one that stands for itself, if it is similar enough and the words allow it.
    """
    stands: list[str] = []
    target: dict[str, str] = {}
    letters = {n: Counter(n.replace(" ", "")) for n in names}
    for name in names:
        least = company_threshold(name)
        if name not in _PROTECTED:
            near = [(company_score(name, s), -i, s) for i, s in enumerate(stands) if s not in _PROTECTED and _may_reach(name, s, letters, least)]
            score, _, best = max(near, default=(0.0, 0, ""))
            if score >= least and may_be_one(name, best):
                target[name] = best
                continue
        stands.append(name)
    return target


def company_lookup(df: DataFrame, name: str) -> DataFrame:
    """For each distinct name: name, canonical and method (passthrough, exact_normalized, alias or fuzzy).

    Names that are equal when made comparable take the most frequent spelling, ties to the smaller one; a known alias
    takes its company's name; and within a block of names with one beginning, a name takes that of a more frequent one
    that is nearly equal. Null and blank names are left out.
    """
    spark = df.sparkSession
    ship(spark)
    counts = df.filter(F.trim(F.col(name)) != "").groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    made = co.comparable(F.col("name"))
    counts = counts.withColumn("key", F.when(made == "", F.lower(F.trim("name"))).otherwise(made))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "name")
    counts = counts.withColumn("label", F.first("name").over(order)).withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("key")) > 1)
    known = spark.createDataFrame([(v, c) for c, variants in co.ALIASES.items() for v in (c, *variants)], "variant string, company string")
    known = known.select(co.comparable(F.col("variant")).alias("key"), "company", co.comparable(F.col("company")).alias("target")).dropDuplicates(["key"])
    rows = counts.join(F.broadcast(known), "key", "left")  # a table of fixed values
    alias = F.col("target").isNotNull() & (F.col("target") != F.col("key"))
    rows = rows.withColumn("alias", F.coalesce(alias, F.lit(False))).withColumn("key", F.when(alias, F.col("target")).otherwise(F.col("key")))
    keys = rows.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.max(F.when(F.col("alias"), F.col("company"))).alias("company"),
        F.max(F.when(~F.col("alias"), F.col("label"))).alias("label"),
    )
    keys = keys.select("key", "n", F.coalesce("company", "label").alias("label"))

    def within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.sort_values(["n", "key"], ascending=[False, True])
            target = matched(part["key"].tolist())
            labels = dict(zip(part["key"], part["label"], strict=True))
            yield pd.DataFrame({"key": list(target), "canonical": [labels[t] for t in target.values()]}, dtype="object")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return next(within(iter([part])))

    fuzzy = keys.withColumn("block", co.block(F.col("key"))).groupBy("block").applyInPandas(one, "key string, canonical string")
    out = rows.join(keys.select("key", F.col("label").alias("own")), "key").join(fuzzy, "key", "left")
    method = (
        F.when(F.col("canonical").isNotNull(), "fuzzy").when(F.col("alias"), "alias").when(F.col("several") & (F.col("name") != F.col("label")), "exact_normalized").otherwise("passthrough")
    )
    return out.select("name", F.coalesce("canonical", "own").alias("canonical"), method.alias("method"))

"""Selection frames: balanced quotas, budgets, sticky top-ups, cache partitions and coverage states.

Only cell counts come to the driver: a row per (group, source, day). Rows are chosen by a rank within their cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def water_fill(capacity: Mapping[str, int], total: int, level: Mapping[str, int] | None = None) -> dict[str, int]:
    """Units given one at a time to the lowest of the names that have room, ties to the smaller name.

    ``level``: what names hold already. The closed form finds the highest full level; the rest goes in order of name.
    """
    held = {k: (level or {}).get(k, 0) for k in capacity}
    given = dict.fromkeys(capacity, 0)
    left = min(total, sum(capacity.values()))
    if left <= 0:
        return given
    top = {k: held[k] + c for k, c in capacity.items()}

    def used(height: int) -> int:
        return sum(max(0, min(height, top[k]) - held[k]) for k in capacity)

    low, high = min(held.values()), max(top.values())
    while low < high:  # the greatest height that the units reach everywhere
        mid = (low + high + 1) // 2
        low, high = (mid, high) if used(mid) <= left else (low, mid - 1)
    for k in capacity:
        given[k] = max(0, min(low, top[k]) - held[k])
    left -= sum(given.values())
    for k in sorted(capacity):
        if left and held[k] + given[k] == max(low, held[k]) and held[k] <= low and given[k] < capacity[k]:
            given[k] += 1
            left -= 1
    return given


def split_budget(budget: int, capacity: Mapping[str, int], shares: Mapping[str, float]) -> dict[str, int]:
    """floor(budget * share / shares of names with room), capped; what is left goes round one by one in order of name."""
    open_ = {k for k, c in capacity.items() if c > 0}
    total = sum(shares.get(k, 0.0) for k in open_)
    out = {k: min(capacity[k], int(budget * shares.get(k, 0.0) / total)) if k in open_ and total > 0 else 0 for k in capacity}
    left = min(budget, sum(capacity.values())) - sum(out.values())
    while left > 0:
        for k in sorted(open_):
            if left and out[k] < capacity[k]:
                out[k] += 1
                left -= 1
    return out


def stable_score(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def python_score(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def quotas(cells: Sequence[tuple[str, str, int]], target: int) -> dict[tuple[str, str], int]:
    """A target over (group, bin) cells with given capacities: evenly over the groups, then evenly over a group's bins;
    what a group cannot hold goes to the others."""
    room: dict[str, int] = {}
    for group, _, n in cells:
        room[group] = room.get(group, 0) + n
    per_group = water_fill(room, target)
    out: dict[tuple[str, str], int] = {}
    for group, most in per_group.items():
        for name, n in water_fill({b: n for g, b, n in cells if g == group}, most).items():
            out[group, name] = n
    return out


def select_balanced(df: DataFrame, uid: str, group: str, bin_: str, target: int) -> DataFrame:
    """``target`` rows, balanced over groups and over the bins of each; in a cell those with the lowest hash of uid.

    A larger target selects a superset.
    """
    keyed = df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit(""))).withColumn("_b", F.coalesce(F.col(bin_).cast("string"), F.lit("")))
    cells = [(r["_g"], r["_b"], r["count"]) for r in keyed.groupBy("_g", "_b").count().collect()]
    chosen = [(g, b, n) for (g, b), n in quotas(cells, target).items() if n]
    table = df.sparkSession.createDataFrame(chosen, "_g string, _b string, _quota long")
    rank = F.row_number().over(Window.partitionBy("_g", "_b").orderBy(stable_score(F.col(uid)), uid))
    return keyed.withColumn("_rank", rank).join(table, ["_g", "_b"]).filter("_rank <= _quota").select(*df.columns)


def top_up(candidates: DataFrame, kept: DataFrame, uid: str, group: str, bin_: str, target: int) -> DataFrame:
    """A sticky frame: the rows of ``kept`` (uid, ord) that are still there, in their order, and new ones up to the target.

    The frame never shrinks by itself: a target below its size changes nothing.
    """
    stay = candidates.join(kept.select(uid, "ord"), uid)
    n = stay.count()
    if target <= n:
        return stay
    fresh = select_balanced(candidates.join(kept.select(uid), uid, "left_anti"), uid, group, bin_, target - n)
    high = kept.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("m")).first()["m"]
    number = F.row_number().over(Window.orderBy(stable_score(F.col(uid)), uid))  # the rows of one top-up
    return stay.unionByName(fresh.withColumn("ord", (number + F.lit(high)).cast("long")))


def cache_partition(df: DataFrame, key: str, frame: DataFrame, cache: DataFrame) -> DataFrame:
    """Each key's part: core_cached (in frame and cache), supplemental_cached, fresh (in the frame only) or outside."""
    keys = df.select(key).distinct()
    for name, other in (("_frame", frame), ("_cached", cache)):
        keys = keys.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    part = F.when(F.col("_frame") & F.col("_cached"), "core_cached").when(F.col("_cached"), "supplemental_cached").when(F.col("_frame"), "fresh").otherwise("outside")
    return keys.select(key, part.alias("part"))


def coverage(selected: Column, short: Column, deferred: Column, labeled: Column) -> Column:
    """The state of a row: of the rules that hold, the last one counts."""
    out = F.lit("pending")
    for state, rule in (("not_selected", ~selected), ("skipped_short", selected & short), ("deferred", selected & deferred), ("labeled", labeled)):
        out = F.when(F.coalesce(rule, F.lit(False)), state).otherwise(out)
    return out


def overridden(rule: Column, label: Column, state: Column) -> Column:
    """The label where the row is labeled and has one; else what the rule said."""
    return F.when((state == "labeled") & label.isNotNull(), label).otherwise(rule)

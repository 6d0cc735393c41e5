"""Functions and operators on rows written out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from gleaner.functions import posting as ps
from gleaner.functions import similarity as sim
from gleaner.functions import text as tx
from gleaner.operators import dedupe as dd
from gleaner.operators import frames as fr
from gleaner.operators import relational as rel
from gleaner.operators import vectors as vc


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_clean_text(spark):
    got = column(spark, ["﻿ a\\nb\r\n\r\n\r\nc \\- d ", "", "   ", None], tx.clean_text)
    assert got == ["a\nb\n\nc - d", None, None, None]


def test_titles(spark):
    assert column(spark, ["Senior Software Engineer III - Remote", "Jr Data  Analyst 2", None], tx.title_key) == ["software engineer", "data analyst", ""]
    assert column(spark, ["Sr C# Developer (II)", ".NET Engineer with active secret security clearance required"], tx.technical_title_key) == ["csharp developer", "dotnet engineer"]
    assert column(spark, ["Acme Holdings Inc.", "The Co-op, LLC", "Inc", None], tx.company_key) == ["acme", "the co op", "", ""]
    assert column(spark, ["Boston, MA, US"], tx.location_key) == ["boston ma"]


def test_sizes_and_truth(spark):
    assert column(spark, ["1,001-5,000 employees", "10,001+", "50", "many", None], tx.company_size) == [3000.5, 10001.0, 50.0, None, None]
    assert column(spark, [" YES", "no", None, "1"], tx.truth) == [True, False, False, True]
    assert column(spark, ["Entry level", "Not Applicable", None], tx.seniority) == ["entry", None, None]


def test_hashes(spark):
    a, b, c, d = column(spark, ["A  b\n", " a B", "", None], tx.hash_key)
    assert a == b and len(a) == 32 and c == d == ""


def test_places(spark):
    got = [tuple(r) for r in column(spark, ["Seattle, WA", "Austin, Texas", "New Jersey, United States", "Remote", None], ps.place)]
    assert got == [("Seattle", "WA", "US", False), ("Austin", "TX", "US", False), (None, "NJ", "US", False), (None, None, None, True), (None, None, None, False)]


def test_risk_and_dates(spark):
    rows = spark.createDataFrame([("entry", 3.0), ("entry", 5.0), ("mid-senior", 7.0), ("entry", None)], "s string, y double")
    assert [r[0] for r in rows.select(ps.ghost_risk(F.col("s"), F.col("y"), F.lit(False))).collect()] == ["medium", "high", "low", "low"]
    rows = spark.createDataFrame([("2026-03-20", "2019-12-31"), ("not-a-date", None), ("2026-03-20", "2030-01-01")], "a string, b string")
    got = [r[0] for r in rows.select(ps.date_flags(scrape_date=F.col("a"), date_posted=F.col("b"))).collect()]
    assert got == ["date_posted_out_of_range", "scrape_date_invalid", "ok"]
    assert column(spark, [None, "", "short text", "x" * 60], ps.quality) == ["empty", "empty", "too_short", "ok"]


@pytest.mark.parametrize(("a", "b", "near"), [("data engineer", "senior data engineer", True), ("mechanical engineer", "electrical engineer", False), ("junior developer", "senior developer", False)])
def test_near_titles(a, b, near):
    assert sim.near_titles(a, b) is near


def brute_lcs(a: str, b: str) -> int:
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(some.text("abc ", max_size=12), some.text("abc ", max_size=12))
def test_common_subsequence(a, b):
    assert sim.common_subsequence(a, b) == brute_lcs(a, b)


def test_jaro_winkler():
    assert round(sim.jaro_winkler("martha", "marhta"), 2) == 96.11
    assert round(sim.jaro_winkler("dwayne", "duane"), 2) == 84.0


def slow_fill(room, total, level):
    given, level = dict.fromkeys(room, 0), dict(level)
    for _ in range(min(total, sum(room.values()))):
        k = min((k for k in room if given[k] < room[k]), key=lambda k: (level[k] + given[k], k))
        given[k] += 1
    return given


@settings(max_examples=300, deadline=None)
@given(some.dictionaries(some.sampled_from("abcdef"), some.tuples(some.integers(0, 9), some.integers(0, 6)), min_size=1), some.integers(0, 40))
def test_water_fill(cells, total):
    room, level = {k: c for k, (c, _) in cells.items()}, {k: v for k, (_, v) in cells.items()}
    assert fr.water_fill(room, total, level) == slow_fill(room, total, level)


def test_budget():
    assert fr.split_budget(100, {"a": 10000, "b": 10000}, {"a": 0.7, "b": 0.3}) == {"a": 70, "b": 30}
    assert fr.split_budget(10000, {"a": 800, "b": 20000}, {"a": 0.7, "b": 0.3}) == {"a": 800, "b": 9200}
    assert fr.split_budget(50000, {"a": 100, "b": 300}, {"a": 0.7, "b": 0.3}) == {"a": 100, "b": 300}


def test_balanced_frames_grow(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("uid"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 7).cast("string").alias("b"))
    small = {r.uid for r in fr.select_balanced(rows, "uid", "g", "b", 30).collect()}
    large = {r.uid for r in fr.select_balanced(rows, "uid", "g", "b", 75).collect()}
    assert len(small) == 30 and len(large) == 75 and small <= large
    kept = fr.select_balanced(rows, "uid", "g", "b", 30).withColumn("ord", F.monotonically_increasing_id())
    more = fr.top_up(rows, kept.select("uid", "ord"), "uid", "g", "b", 50).collect()
    assert len(more) == 50 and small <= {r.uid for r in more}
    assert fr.top_up(rows, kept.select("uid", "ord"), "uid", "g", "b", 10).count() == 30


def test_near_duplicates(spark):
    rows = [(1, "k", "data engineer", 0, 10), (2, "k", "senior data engineer", 1, 10), (3, "k", "nurse", 0, 5), (4, "j", "data engineer", 0, 1), (5, "k", "data engineer", 0, 10)]
    df = spark.createDataFrame(rows, "uid long, k string, t string, complete int, n int")
    # 1 gives way to 2, which is more complete; 5 is then near 2 as well.
    assert {r.uid for r in dd.near_duplicates(df, ["k"], "uid", "uid", "t", ["complete", "n"]).collect()} == {1, 5}
    assert dd.near_duplicates(df.limit(0), ["k"], "uid", "uid", "t", ["complete", "n"]).count() == 0


def test_collapse_places(spark):
    df = spark.createDataFrame([("b", "k", "x", "m"), ("a", "k", "y", "m"), ("c", "j", "z", "m"), ("d", None, "z", "m")], "uid string, k string, place string, metro string")
    got = {tuple(r) for r in dd.collapse_places(df, ["k"], "place", "uid", clear=["metro"]).collect()}
    assert got == {("a", "k", "multi-location", None), ("c", "j", "z", "m"), ("d", None, "z", "m")}


def test_where_and_slices(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "Foo bar"), (3, "b", "baz")], "i int, g string, t string")
    assert df.filter(rel.where([("g", "in", ["a", None])])).count() == 2
    assert df.filter(rel.where([], "FOO", ["t", "g"])).count() == 1
    with pytest.raises(ValueError):
        rel.where([("g", "like", "a")])
    assert rel.slices(df.limit(0), {"all": F.lit(True)}, {"n": F.lit(True)}).collect()[0].n == 0


@settings(max_examples=60, deadline=None)
@given(some.integers(1, 5).flatmap(lambda n: some.lists(some.lists(some.integers(0, 20), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment(cost):
    from itertools import permutations

    c = np.array(cost, float)
    best = min(sum(c[i, p[i]] for i in range(len(c))) for p in permutations(range(len(c))))
    got = vc.assignment(c)
    assert sorted(got) == list(range(len(c))) and sum(c[i, j] for i, j in enumerate(got)) == best

"""Resampling, neighbours, companies, employers and queries without SQL, against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import company as co
from gleaner.functions import occupation as oc
from gleaner.functions.units import sections
from gleaner.operators import companies, dedupe, lookups, neighbours, topics
from gleaner.operators import resampling as rs
from gleaner.operators import statistics as st
from gleaner.operators import vectors as vc
from gleaner.plans import catalog
from gleaner.plans.units import with_units
from gleaner.sources import files

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def values(spark):
    rnd = random.Random(5)
    rows = [(i, "abc"[i % 3], i % 2 == 0, rnd.gauss(10 + 5 * (i % 3), 2) + (1.5 if i % 2 == 0 else 0)) for i in range(900)]
    return rows, spark.createDataFrame([*rows, (9000, "a", True, None)], "id long, c string, g boolean, x double")


def test_intervals(spark, values):
    rows, df = values
    a, b = ([x for *_, g, x in rows if g == want] for want in (True, False))
    gap, se = np.mean(a) - np.mean(b), math.sqrt(np.var(a) / len(a) + np.var(b) / len(b))
    r = rs.bootstrap_difference(df, "id", F.col("g"), F.col("x"), 400).first()
    assert abs(r.difference - gap) < 1e-5 and abs((r.high - r.low) / (2 * 1.96 * se) - 1) < 0.15 and r.low < gap < r.high
    # Strata take their share of the spread away.
    within = math.sqrt(sum(np.var([x for _, c, _, x in rows if c == k]) * 300 for k in "abc")) / 900
    r = rs.stratified_bootstrap(df, "id", "c", F.col("x"), 400).first()
    assert abs(r["mean"] - np.mean([x for *_, x in rows])) < 1e-5 and abs((r.high - r.low) / (2 * 1.96 * within) - 1) < 0.15
    cell = lambda t, l: [x for i, _, g, x in rows if g == t and (i % 3 == 0) == l]  # noqa: E731, E741
    did = (np.mean(cell(True, True)) - np.mean(cell(True, False))) - (np.mean(cell(False, True)) - np.mean(cell(False, False)))
    se = math.sqrt(sum(np.var(cell(t, l)) / len(cell(t, l)) for t in (True, False) for l in (True, False)))  # noqa: E741
    r = rs.did_interval(df, "id", F.col("g"), F.col("id") % 3 == 0, F.col("x"), 400).first()
    assert abs(r.did - did) < 1e-5 and abs((r.high - r.low) / (2 * 1.96 * se) - 1) < 0.15


def test_permutations(spark, values):
    rows, df = values
    r = rs.permutation_test(df, "id", F.col("g"), F.col("x"), 300).first()
    assert r.reps == 300 and r.p < 0.02
    none = df.withColumn("x", F.col("x") - F.when(F.col("g"), 1.5).otherwise(0.0))
    assert rs.permutation_test(none, "id", F.col("g"), F.col("x"), 300).first().p > 0.05
    # A group that is only where its cluster is high differs overall, but not within clusters.
    skewed = none.withColumn("g", F.when(F.col("c") == "c", F.col("id") % 10 < 8).otherwise(F.col("id") % 10 < 2))
    assert rs.permutation_test(skewed, "id", F.col("g"), F.col("x"), 200).first().p < 0.02
    assert rs.permutation_test(skewed, "id", F.col("g"), F.col("x"), 200, cluster="c").first().p > 0.05


def test_kendall(spark):
    rnd = random.Random(2)
    rows = [(x, rnd.choice([x, x + 1, 3, None])) for x in (rnd.randint(0, 6) for _ in range(120))]
    known = [r for r in rows if r[1] is not None]
    s = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(known, 2):
        s += np.sign((a - c) * (b - d))
        tx, ty = tx + (a != c), ty + (b != d)
    got = st.kendall(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()
    assert got.n == len(known) and abs(got.tau - s / math.sqrt(tx * ty)) < 1e-6
    with pytest.raises(ValueError):
        st.kendall(spark.range(30).withColumn("y", F.col("id")), "id", "y", most=20)


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(80, 5)).round(1)
    m[7] = m[3]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(500, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    for block in (4096, 7):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = {r.vec_id: (r.nearest, r.cosine) for r in neighbours.nearest(df.filter("vec_id >= 40"), df.filter("vec_id < 40 or vec_id = 500"), "vec_id", "embedding").collect()}
        assert {q: n for q, (n, _) in got.items()} == {q: int(cos[q, :40].argmax()) for q in range(40, 80)}
        assert all(abs(c - cos[q, n]) < 1e-8 for q, (n, c) in got.items())
    assert neighbours.nearest(df.limit(0), df, "vec_id", "embedding").collect() == []


def test_axis_stability(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    c = {k: np.mean(np.array(g.embedding.tolist(), float), axis=0) for k, g in rows.groupby("label")}
    pairs = list(zip(sorted(c)[::2], sorted(c)[1::2], strict=False))
    d = np.array([c[a] - c[b] for a, b in pairs])
    lead = lambda x: np.linalg.eigh(x.T @ x)[1][:, -1]
    for r in QUERIES["axis_stability"](spark, sf).collect():
        i = pairs.index((r.a, r.b))
        rest = lead(np.delete(d, i, axis=0))
        assert abs(abs(rest @ lead(d)) - r.cosine) < 1e-6 and abs(abs(d[i] @ rest) / np.linalg.norm(d[i]) - abs(r.held_out)) < 1e-6
    assert len(vc.leave_one_out([(0, 1, d[0])])) == 1


def test_fuzzy_companies(spark):
    names = ["Northern Lights Bakery"] * 5 + ["Northern Lights Bakerys", "Northern Light Bakery", "The Northern Lights Bakery", "northern lights bakery, inc."] + ["Northwind Traders"] * 2
    names += ["First National Bank of Ohio", "First National Bank of Iowa", "Apple Bank", "Apple", "Apple Inc", "AWS", "Amazon", " ", None, "City of Springfield 1", "City of Springfield 2"]
    got = {r.name: (r.canonical, r.method) for r in companies.company_lookup(spark.createDataFrame([(n,) for n in names], "c string"), "c").collect()}
    assert got["Northern Lights Bakerys"] == ("Northern Lights Bakery", "fuzzy") and got["Northern Light Bakery"] == ("Northern Lights Bakery", "fuzzy")
    assert got["northern lights bakery, inc."] == ("Northern Lights Bakery", "exact_normalized") and got["Northern Lights Bakery"][1] == "passthrough"
    assert got["Northwind Traders"] == ("Northwind Traders", "passthrough") and got["Apple Bank"] == ("Apple Bank", "passthrough")
    assert got["AWS"] == ("Amazon", "alias") and got["Amazon"][0] == "Amazon" and got["Apple"][0] == got["Apple Inc"][0]
    assert got["First National Bank of Ohio"][0] != got["First National Bank of Iowa"][0] and got["City of Springfield 1"][0] != got["City of Springfield 2"][0]
    assert " " not in got and None not in got


def test_pruned_matches_equal_all_comparisons():
    rnd = random.Random(9)
    stems = ["harbor view dental", "harbour view dental", "harbor views dental", "harbor view dentals", "harbor park", "harbors park", "harbor", "harb"]
    names = list(dict.fromkeys(" ".join(w[: rnd.choice((9, 9, 9, len(w) - 1))] for w in rnd.choice(stems).split()) for _ in range(60)))
    slow, stands = {}, []
    for name in names:
        scores = [(companies.company_score(name, s), -i, s) for i, s in enumerate(stands)]
        score, _, best = max(scores, default=(0.0, 0, ""))
        if score >= companies.company_threshold(name) and companies.may_be_one(name, best):
            slow[name] = best
        else:
            stands.append(name)
    assert companies.matched(names) == slow and slow


def test_employers(spark):
    long = " It is a fine place to work, with a garden and a view of the sea."
    cases = [
        ("Our client, Harbor Pumps, is growing." + long, "Dice", "Harbor Pumps"),
        ("Our client is seeking a new team. We act on behalf of Blue River Inc. today." + long, "Dice", "Blue River Inc"),
        ("We are partnered with Dice, and it works. The role is with Tall Ships Ltd in Kiel." + long, "Dice", "Tall Ships Ltd"),
        ("We partnered with Harbor Pumps to find people." + long, "HARBOR PUMPS", None),
        ("No name is told here." + long, "Dice", None),
        ("Our client, Harbor Pumps, is growing.", "Dice", None),
        (None, "Dice", None),
    ]
    rows = spark.createDataFrame([(i, d, c) for i, (d, c, _) in enumerate(cases)], "i int, d string, c string")
    got = {r.i: r.e for r in rows.select("i", co.real_employer(F.col("d"), F.col("c")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]


#: Titles with family, level and source that they must give (the outcomes are fixed).
TITLES = [
    ("Senior Gardener", "other", "mid-senior", "title_keyword"), ("Chief of Staff", "swe", "director", "title_keyword"), ("Co-op Student", "swe", "entry", "title_keyword"),
    ("QA Manager", "adjacent", "mid-senior", "title_manager"), ("QA Manager", "swe", "unknown", "unknown"), ("Store Manager", "other", "unknown", "unknown"),
    ("Accounting Supervisor", "control", "mid-senior", "title_manager"), ("Network Lead", "adjacent", "mid-senior", "title_manager"), ("Lead Full Stack Engineer", "swe", "mid-senior", "title_keyword"),
    ("Lead Back-end Coder", "swe", "mid-senior", "title_keyword"), ("Leading Edge Tester", "adjacent", "unknown", "unknown"), ("Fresh Grad Engineer", "swe", "entry", "title_keyword"),
    ("Entry-level Clerk", "other", "entry", "title_keyword"), ("Engineer II", "swe", "unknown", "unknown"), ("Intern, Office of the Director", "other", "entry", "title_keyword"),
    ("", "swe", "unknown", "unknown"), (None, "swe", "unknown", "unknown"),
]


def test_title_levels(spark):
    rows = spark.createDataFrame([(i, t, f) for i, (t, f, *_) in enumerate(TITLES)], "i int, t string, f string")
    got = {r.i: tuple(r.l) for r in rows.select("i", oc.title_level(F.col("t"), F.col("f")).alias("l")).collect()}
    assert [got[i] for i in range(len(TITLES))] == [(level, source) for _, _, level, source in TITLES]


def test_curated_labels(spark):
    table = spark.createDataFrame([("Senior Baker", "NOT_SWE"), ("baker", "NOT_SWE"), ("Coder", "SWE"), ("coder II", "SWE_ADJACENT"), (" ", "SWE")], "title string, label string")
    allowed = ("SWE", "SWE_ADJACENT", "NOT_SWE")
    assert {tuple(r) for r in lookups.curated_labels(table, "title", "label", allowed).collect()} == {("baker", "NOT_SWE")}
    with pytest.raises(ValueError):
        lookups.curated_labels(table.withColumnRenamed("label", "x"), "title", "label", allowed)
    with pytest.raises(ValueError):
        lookups.curated_labels(table, "title", "label", ("SWE",))


def test_similar_titles(spark):
    rows = spark.createDataFrame([("Widget Engineer",), ("Widget Tech",), ("Gardener",), ("Widget Engineer",), (None,)], "title string")
    near = spark.createDataFrame([("widget engineer", 0.9), ("widget tech", 0.75), ("gardener", 0.99)], "key string, similarity double")
    curated = spark.createDataFrame([], "key string, label string")
    got = sorted((r.title or "", r.is_swe, r.is_swe_adjacent, r.tier) for r in lookups.occupations(rows, "title", curated, near).collect())
    assert got == [
        ("", None, None, None),
        ("Gardener", False, False, "unresolved"),
        ("Widget Engineer", True, False, "embedding_high"),
        ("Widget Engineer", True, False, "embedding_high"),
        ("Widget Tech", False, True, "embedding_adjacent"),
    ]


def test_drop_repeated(spark):
    rows = [(i, i % 4, i % 3 == 0) for i in range(60)] + [(100, None, None), (101, None, True), (102, None, True)]
    got = dedupe.drop_repeated(spark.createDataFrame(rows, "id int, k int, need boolean"), ["k"], [F.col("id")], F.col("need"))
    first = {}
    want = [r for r in rows if not r[2] or first.setdefault(r[1], r[0]) == r[0]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_clusters_and_components(spark, sf, tmp_path):
    shares = QUERIES["text_clusters"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert shares.n.sum() == docs.count() and shares.prediction.between(0, 3).all()
    auc = QUERIES["boundary_auc"](spark, sf).toPandas()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").filter("label in (0, 1)").count()
    assert auc.n.sum() == n and auc.auc.between(0, 1).all()
    apart = [(i, [float(i % 2) * 3 + math.sin(i), math.cos(i)], i % 2) for i in range(90)]
    spark.createDataFrame(apart, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["boundary_auc"](spark, str(tmp_path)).toPandas().auc.between(0.95, 1).all()
    m = np.array(spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas().embedding.tolist(), float)
    got = QUERIES["embedding_components"](spark, sf).orderBy("vec_id").toPandas()
    _, _, vt = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    for k, c in enumerate("xy"):
        assert abs(abs(np.corrcoef(m @ vt[k], got[c])[0, 1]) - 1) < 1e-6
    assert QUERIES["cluster_quality"](spark, sf).toPandas().silhouette.between(-1, 1).all()


def test_unit_queries(spark, sf):
    from gleaner.functions.units import units

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["text_units"](spark, sf).collect()}
    kept = {r.doc_id: r for r in QUERIES["reconstructed_texts"](spark, sf).collect()}
    for d, t in docs.items():
        u = units(t)
        if u:
            assert (got[d].n, got[d].longest) == (len(u), max(len(x["text"]) for x in u))
            bare = lambda x: re.sub(r"\s", "", x)
            assert abs(sum(len(bare(x["text"])) for x in u) - len(bare(t))) <= 4 * len(u)  # marks of bullets and labels
        assert kept[d].units == len(u) and kept[d].kept_chars == len("\n".join(x["text"] for x in u[1:]))


def test_near_duplicate_titles(spark, sf):
    from gleaner.functions.similarity import near_titles

    part = spark.read.parquet(f"{sf}/part.parquet").orderBy("p_partkey").toPandas()
    groups, want = {}, set()
    for r in part.itertuples():
        groups.setdefault((r.p_brand, r.p_type), []).append((r.p_partkey, re.sub(" +", " ", re.sub("[^a-z0-9+#/& ]+", " ", r.p_name.lower())).strip(), (r.p_size % 3, r.p_retailprice)))
    for rows in groups.values():
        gone = set()
        for i, (a, t, x) in enumerate(rows):
            for b, u, y in rows[i + 1 :]:
                if a in gone:
                    break
                if b not in gone and near_titles(t, u):
                    gone.add(a if y > x else b)
        want |= gone
    assert {r.uid for r in QUERIES["near_duplicate_titles"](spark, sf).collect()} == want


def test_topics(spark):
    rnd = random.Random(1)
    vocab = {c: [f"{c}{i}" for i in range(12)] for c in "abc"}
    rows = [(i, "abc"[i % 3], [rnd.choice(vocab["abc"[i % 3]]) for _ in range(30)]) for i in range(150)]
    docs = spark.createDataFrame(rows, "id int, c string, w array<string>")
    found = topics.factors(docs, "id", F.col("w"), 3, 6).collect()
    by = {k: {r.term[0] for r in found if r.topic == k} for k in range(3)}
    assert all(len(x) == 1 for x in by.values()) and set().union(*by.values()) == set("abc")
    got = topics.mixtures(docs, "w", 3, 30).toPandas()
    assert len(got) == 150 and got.groupby("c").topic.agg(lambda t: t.value_counts().iloc[0]).sum() >= 120


def test_sections(spark):
    text = "Intro words.\nRequirements:\n- one\n- two\nBENEFITS\nPay is good, and so on.\nFrobnication:\nx y."
    rows = with_units(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t").select("id", sections("units").alias("s"))
    got = {r.id: [(x.section, x.text) for x in r.s] for r in rows.collect()}
    want = [("intro", "Intro words."), ("requirements", "Requirements: | - one"), ("requirements", "- two"), ("benefits", "BENEFITS | Pay is good, and so on."), ("benefits", "Frobnication: | x y.")]
    assert got[1] == want and got[2] == []


def test_drift(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (rng.normal(size=3) + (3 if i % 2 and i % 4 > 1 else 0)).tolist()) for i in range(400)]
    got = {r.g: r for r in vc.drift_test(spark.createDataFrame(rows, "id long, g int, v array<double>"), "id", "g", F.col("id") % 4 > 1, "v", 60).collect()}
    assert got[1].p < 0.02 and got[0].p > 0.02 and got[1].drift > 4 > 1 > got[0].drift and got[0].reps == 60


def test_english_flags_at_letters_beyond_ascii(spark, tmp_path):
    texts = [
        ("the esími es", "false"),  # es twice: í ends a word
        ("of the leçon, éle, leê", "false"),  # le three times
        ("und the tzßzu", "false"),  # zu after ß
        ("the la_ la1 xla le", "true"),  # no word ends at _, digits and letters of ASCII
        ("la the e\u0301la", "false"),  # la after a mark
        ("éthe la", "true"),  # the after é
        ("ofé the la le", "true"),
        ("x İS y", "true"),  # İ is i in lower case
        ("x İTHE y", "false"),
        ("x i\u0307the y", "true"),  # but a mark of its own stays
        ("THE 的的的的的的的的", "false"),
        ("", "unknown"),
        (None, "unknown"),
    ]
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.english for r in QUERIES["english_flags"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [want for _, want in texts]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.sql(catalog.oracle_sql()["english_flags"]).fetchall()) == got


def test_reports(spark, tmp_path):
    text = files.report({"rows": 12345, "share": 0.5, "note": None}, "Quality")
    files.write_text(spark, f"{tmp_path}/report.txt", text)
    assert (tmp_path / "report.txt").read_text() == "Quality\n=======\nrows   12,345\nshare  0.5\nnote   None\n"

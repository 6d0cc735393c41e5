"""Queries over whole corpora against brute force: long documents count as short ones do."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from gleaner.plans import catalog, spaces

QUERIES = catalog.queries()
LONG = " ".join(["omega delta"] * 400 + ["sigma"] * 30)
DOCS = [(1, "alpha beta alpha gamma", "en"), (2, "beta gamma delta", "de"), (3, LONG, "en"), (4, "alpha delta", "en"), (5, LONG.replace("sigma", "kappa"), "de"), (6, None, "en"), (7, "1 2 3", "de")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpora"))
    rows = [(d, t, g, len(t or "")) for d, t, g in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_tfidf_terms(spark, folder):
    tf = {d: Counter(re.findall("[a-z]{2,}", (t or "").lower())) for d, t, _ in DOCS}
    df = Counter(t for c in tf.values() for t in c)
    want = set()
    for d, c in tf.items():
        weighed = sorted((-n * math.log((len(DOCS) + 1) / (df[t] + 1)), t) for t, n in c.items())
        want |= {(d, t, round(-x, 6)) for x, t in weighed[:3]}
    got = {(r.doc_id, r.term, r.weight) for r in QUERIES["tfidf_terms"](spark, folder).collect()}
    assert {x[:2] for x in got} == {x[:2] for x in want} and {3, 5} <= {x[0] for x in got}
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_term_counts(spark, folder):
    a, b = (Counter(t for _, x, g in DOCS if (g == "en") == en for t in re.findall("[a-z]{3,}", (x or "").lower())) for en in (True, False))
    got = QUERIES["distinguishing_terms"](spark, folder).collect()
    assert {(r.term, r.a, r.b) for r in got} == {(t, a[t], b[t]) for t in a | b if a[t] + b[t] >= 50} and got
    one = QUERIES["term_divergence"](spark, folder).collect()[0]
    assert (one.only_a, one.only_b) == (len(a.keys() - b.keys()), len(b.keys() - a.keys()))
    p, q = ({t: c[t] / sum(c.values()) for t in a | b} for c in (a, b))
    part = lambda x: sum(x[t] * math.log2(2 * x[t] / (p[t] + q[t])) for t in x if x[t])
    assert abs(one.jsd - (part(p) + part(q)) / 2) < 2e-6


def test_top_bigrams(spark, folder):
    want = Counter()
    for _, text, lang in DOCS:
        words = re.findall("[a-z]+", (text or "").lower()) if lang == "en" else []
        want.update(f"{x} {y}" for x, y in zip(words, words[1:], strict=False))
    got = [(r.gram, r.n) for r in QUERIES["top_bigrams"](spark, folder).collect()]
    assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:50] and got[0][1] >= 399


def test_aligned_clusters_of_all_labels(spark, tmp_path, monkeypatch):
    labels = [*range(20), 1000]
    rows = [(i * 2 + era, label, [float(k == i) + 0.01 * era for k in range(len(labels))]) for i, label in enumerate(labels) for era in (0, 1)]
    spark.createDataFrame([*rows, (99, None, [1.0] * len(labels))], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["aligned_clusters"](spark, str(tmp_path)).collect()
    assert sorted((r.label, r.matched) for r in got) == [(x, x) for x in labels]
    monkeypatch.setattr(spaces, "LABELS", 20)
    with pytest.raises(ValueError):
        QUERIES["aligned_clusters"](spark, str(tmp_path))

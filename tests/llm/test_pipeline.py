"""The pipeline's stages against brute force, each on what the one before has kept."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import bpe, mixing, store, toxicity


def words(rnd, n, start="w"):
    return [f"{start}{rnd.randint(0, 3000)}" for _ in range(n)]


def made(rnd):
    """(doc_id, text, source) and labels: clean, toxic, copied and nearly copied documents."""
    rows, labels = [], []
    for i in range(200):
        text = ". ".join(" ".join(words(rnd, 8)) for _ in range(rnd.randint(3, 12)))
        if i % 4 == 0:
            text += ". " + " ".join(["scum", "clown", *words(rnd, 3)])
        rows.append((i, text, f"s{i % 3}"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(300 + i, rows[i][1], "s0") for i in range(1, 40, 2)]
    rows += [(400 + i, rows[i][1] + " tail", "s1") for i in range(1, 40, 2)]
    return rows + [(500, None, "s0"), (501, "", None), (502, " ", None)], labels


def test_stages(spark, tmp_path):
    rows, labels = made(random.Random(4))
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = store.written(out, "test-pipeline")
            kept[name] = [r.doc_id for r in docs.collect()]
    toxic = {d for d, t in labels if t}
    assert not toxic & set(kept["toxicity"]) and len(kept["toxicity"]) == len(rows) - len(toxic)
    texts = {d: t or "" for d, t, _ in rows}
    last = {}
    for d in sorted(kept["toxicity"]):
        last[texts[d]] = d
    assert sorted(kept["exact dedup"]) == sorted(last.values())
    near = {d for d in kept["exact dedup"] if d >= 400 and d < 500}
    assert near and not near & set(kept["n-gram Jaccard join"]) and set(kept["n-gram Jaccard join"]) == set(kept["exact dedup"]) - near
    assert set(kept["mixing sources to target weights"]) <= set(kept["n-gram Jaccard join"])
    ours = bpe.load_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(ours.keys, ours.ids, strict=True)), special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(kept["mixing sources to target weights"])
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(theirs.encode_ordinary(texts[r.doc_id]))


def test_mixed_words(spark, tmp_path):
    """Words of each source against its target: a hot source, and long documents, of which every ratio needs some."""
    rnd = random.Random(7)
    rows = [(i, " ".join(words(rnd, rnd.choice([20, 90, 400, 3000 if i % 5 == 0 else 60]))), "hot") for i in range(600)]
    rows += [(1000 + i, " ".join(words(rnd, rnd.choice([30, 300, 900]))), "mid") for i in range(120)]
    rows += [(2000 + i, " ".join(words(rnd, rnd.choice([10, 50]))), None) for i in range(80)] + [(3000, " ", "hot"), (3001, None, "mid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, source = {d: len((t or "").split()) for d, t, _ in rows}, {d: s for d, _, s in rows}
    target = {r.source: r.target for r in mixing.mix(docs).sources.collect()}
    assert 0.05 < target["hot"] / sum(size[d] for d in size if source[d] == "hot") < 0.98
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()]
    for s in target:
        longest = max(size[d] for d in size if source[d] == s)
        assert abs(sum(size[d] for d in got if source[d] == s) - target[s]) <= 2 * longest
        long = [d for d in size if source[d] == s and size[d] > longest / 2]
        assert abs(sum(size[d] for d in got if d in long) / sum(size[d] for d in long) - target[s] / sum(size[d] for d in size if source[d] == s)) < 0.35
    assert max(got.count(d) for d in set(got)) <= 3 and not {3000, 3001} & set(got)
    assert sorted(got) == sorted(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs.repartition(3), str(tmp_path)).collect())


ODD = "doc_id long, text string, source string, gone_id long, text_sha256 string, times int, score double, component_key long, rows long"


def odd(rows):
    return [(*r, 7, "x", 7, 0.5, 7, 7) for r in rows]


def long(start):
    return " ".join(f"{start}{i}" for i in range(60))


def test_copies_are_told_apart_by_text(spark, tmp_path):
    """One doc_id for several texts, rows that repeat each other, null ids and texts, and columns with clashing names."""
    a, b, c = long("a"), long("b"), long("c")
    rows = [(5, a, "s"), (5, b, "s"), (3, b, "s"), (8, c, "t"), (8, c, "t"), (None, c, "t"), (None, "lone words here", None), (1, None, "s"), (2, "", "s"), (4, None, None), (4, None, None)]
    docs = spark.createDataFrame(odd(rows), ODD)
    out = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert out.columns == docs.columns
    # Of equal texts (null and empty are equal) the row with the largest doc_id.
    assert [x for x in got if x[1]] == sorted([(5, a), (5, b), (8, c), (None, "lone words here")], key=str) and [d for d, t in got if not t] == [4]
    near = [(5, a, "s"), (5, b, "s"), (3, b + " tail", "s"), (8, c, "t"), (8, c, "t"), (None, c + " tail", "t"), (None, "lone words here", None), (1, None, "s"), (2, "", "s"), (4, None, None)]
    docs = spark.createDataFrame(odd(near), ODD)
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert out.columns == docs.columns
    assert got == sorted([(5, a), (3, b + " tail"), (8, c), (None, "lone words here"), (1, None), (2, ""), (4, None)], key=str)


def test_mixing_of_odd_rows(spark, tmp_path):
    rows = [(i % 40 or None, " ".join(f"w{k}" for k in range(20 + i % 7)), f"s{i % 2}" if i % 5 else None) for i in range(200)] + [(900, None, "s0"), (901, " ", None)]
    docs = spark.createDataFrame(odd(rows), ODD)
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    mixed = mixing.mix(docs).sources.collect()
    words_ = lambda s: sum(len(r.text.split()) for r in out if r.source == s)
    for r in mixed:
        share = max(sum(len((t or "").split()) for d, t, x in rows if x == r.source and d == k) for k in {d for d, *_ in rows})
        assert abs(words_(r.source) - r.target) <= 2 * share
    assert not {900, 901} & {r.doc_id for r in out}


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == []
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_scores_stand_in_their_column(spark):
    docs = spark.createDataFrame(odd([(1, "scum and clown", "s"), (1, "scum and clown", "s"), (None, None, None), (2, "kind words", None)]), ODD)
    labels = [(i, int(i % 2)) for i in range(60)]
    known = spark.createDataFrame([(i, "scum clown here" if t else f"kind words {i}") for i, t in labels], "doc_id long, text string")
    model = toxicity.train(known, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.with_scores(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score"]
    got = out.collect()
    assert [r.score >= 0.5 for r in sorted(got, key=lambda r: (r.text or ""))] == [False, False, True, True]
    assert toxicity.with_scores(docs.limit(0), model).collect() == []

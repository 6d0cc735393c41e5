"""Every operator against brute force on small tables with nulls, blanks, long texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bpe, chat, components, jaccard_join, language_id, licenses, mixing, store, token_store, topk, toxicity, words
from gleaner.llm.exact_dedup import exact_dedup
from gleaner.llm.queries import bpe_digests

# Columns that clash with names the operators use inside.
DOCS = "doc_id long, text string, source string, lang string, size long, n int, id long, kept boolean, score double, rn int"


def table(spark, rows):
    """rows: (doc_id, text, source, lang)"""
    return spark.createDataFrame([(*r, 7, 7, 7, True, 0.5, 1) for r in rows], DOCS)


def corpus(seed=5, n=60):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "é", "x1", "ünder", "(zeta)", "eta,", "theta"]
    rows = []
    for i in range(n):
        base = [rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(0, 60))]
        rows.append((i, " ".join(base), f"s{i % 4}" if i % 9 else None, "en"))
        if i % 5 == 0 and base:
            near = list(base)
            near[rnd.randrange(len(near))] = "changed"
            rows.append((1000 + i, "\n".join(near), "s1", "en"))
            rows.append((2000 + i, " ".join(base), "s2", None))
    rows += [(3000, None, None, None), (3001, "", "s0", None), (3002, "  \t\n", "s0", "en"), (3003, "long " * 30000, "s3", "en"), (3004, "one", "s0", "en"), (3005, "ONE", "s0", "en")]
    return rows


EMPTY: list = []


def test_exact_dedup(spark):
    rows = [*corpus(), (4000, "same", "a", None), (4000, "same", "a", None), (None, "same", "a", None), (None, "lone", "a", None), (None, "lone", "a", None)]
    for keep, hot in (("max", 512), ("min", 512), ("max", 1)):
        got = exact_dedup(table(spark, rows), keep=keep, hot_rows=hot).collect()
        groups = defaultdict(list)
        for d, t, *_ in rows:
            groups[t or ""].append(d)
        want = Counter()
        for t, ids in groups.items():
            known = [d for d in ids if d is not None]
            first = (max if keep == "max" else min)(known) if known else None
            for d in ids:
                want[d, first, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(table(spark, EMPTY)).collect() == []
    upper = exact_dedup(table(spark, [(1, "A", None, None), (2, "a", None, None)]), normalised=F.lower("text")).collect()
    assert {r.keep_id for r in upper} == {1}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(rows, part=80, whole=100):
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and whole * len(a & b) >= part * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    return Counter((sets[i][0], len(sets[i][1]), min((sets[k][0] for k in g if sets[k][0] is not None), default=None)) for g in groups.values() for i in g)


def chained(rnd, n, change):
    """Documents that each differ a little from the one before, so links form chains."""
    words, rows = [f"w{rnd.randint(0, 400)}" for _ in range(90)], []
    for i in range(n):
        rows.append((i, " ".join(words), None, None))
        for _ in range(change):
            words[rnd.randrange(90)] = f"v{rnd.randint(0, 10**6)}"
    return rows


def test_jaccard_join(spark):
    rnd = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(50))
    shared = [(5000 + i, passage + " " + " ".join(f"q{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 14))), None, None) for i in range(40)]
    for rows in (corpus() + [(7, "again a b c d e", None, None), (7, "again a b c d e", None, None), (None, "again a b c d e", None, None)], chained(rnd, 60, 1), chained(rnd, 60, 2), shared):
        got = jaccard_join.jaccard_components(table(spark, rows)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked(rows)
    got = jaccard_join.jaccard_components(table(spark, chained(rnd, 40, 6)), part=50).collect()
    assert len({r.component_id for r in got}) < 40
    assert jaccard_join.jaccard_components(table(spark, EMPTY)).collect() == []


@pytest.mark.parametrize("pivots", [0, 3, 200])
def test_jaccard_join_with_few_pivots(spark, monkeypatch, pivots):
    """A group of near copies holds most rows: some link with its pivot, some only with each other, some with nothing."""
    rnd = random.Random(11)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    base, rows = [f"b{i}" for i in range(100)], chained(rnd, 30, 2)
    for i in range(150):
        words = list(base)
        for _ in range(rnd.choice((0, 1, 2, 2, 3, 5, 8))):
            words[rnd.randrange(100)] = f"e{rnd.randint(0, 30)}"
        rows.append((100 + i, " ".join(words[: rnd.choice((100, 100, 96, 70))]), None, None))
    got = jaccard_join.jaccard_components(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked(rows)


def test_cells_hold_every_link():
    rnd = random.Random(4)
    base = [[rnd.randrange(10**9) for _ in range(60)] for _ in range(4)]
    sets = []
    for _ in range(160):
        x = set(rnd.choice(base)[: rnd.randint(30, 60)]) | {rnd.randrange(10**9) for _ in range(rnd.choice((0, 1, 5, 30)))}
        sets.append(np.array(sorted(x), "uint64"))
    for part in (50, 80, 100):
        pivots = jaccard_join.Pivots.build(sets[:6], list(range(6)))
        cells = [{c: (d, home, hit) for c, d, home, hit in pivots.cells(x, part, 100)} for x in sets]
        homes = [next((c for c, (_, home, _) in held.items() if home), None) for held in cells]
        assert any(h is None for h in homes) and any(h is not None for h in homes)
        for i, x in enumerate(sets):
            for c, (d, _, hit) in cells[i].items():
                common, union = len(set(x.tolist()) & set(sets[c].tolist())), len(set(x.tolist()) | set(sets[c].tolist()))
                assert abs(d - (1 - common / union)) < 1e-12 and hit == (100 * common >= part * union)
            for j in range(i):
                common, union = len(np.intersect1d(x, sets[j])), len(np.union1d(x, sets[j]))
                if 100 * common >= part * union:
                    assert (homes[i] is None and homes[j] is None) or homes[i] in cells[j] or homes[j] in cells[i]


def test_bitmaps_bound_differences():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        pool = rnd.integers(0, 2**63, 400, dtype="uint64")
        a, b = (np.unique(rnd.choice(pool, rnd.integers(1, 300))) for _ in "ab")
        bound = jaccard_join.least_difference(jaccard_join.parity_bits(a), jaccard_join.parity_bits(b))
        assert bound <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 300 + i) for i in range(40)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    real = {v for a, b in edges if a != b for v in (a, b)}
    assert {(r.node, r.root) for r in got} == {(v, find(v)) for v in real}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("few", [0, 150, 10**6])
def test_components_joined_in_one_task_or_by_stars(spark, monkeypatch, few):
    rnd = random.Random(2)
    monkeypatch.setattr(components, "FEW_EDGES", few)
    line = list(range(-(2**63), -(2**63) + 60)) + [2**63 - 1 - i for i in range(60)]
    rnd.shuffle(line)
    edges = [*zip(line, line[1:], strict=False), *((1000 + i, 2000) for i in range(30)), (2000, 1000), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted([(v, min(line)) for v in line] + [(1000 + i, 1000) for i in range(30)] + [(2000, 1000)])


def test_components_of_few_edges_take_few_jobs(spark):
    """Each job's plans and broadcasts fill the driver; stars took dozens for a chain."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("few-edges", "components")
    try:
        assert components.components(edges).filter("root <> 0").count() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 12


def test_driver_gives_memory_back(spark):
    before = store.written(spark.range(5), "given-back")
    assert store.give_back(spark) in (True, False)
    assert before.count() == 5


def brute_top(rows, k):
    fine = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(fine):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(fine) if m != n and len(w) == len(v))[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return Counter(want)


def test_top_k(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=8).round(1)]) for i in range(300)]
    rows += [(301, None), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (305, []), (None, [0.5] * 8), (320, [0.5] * 3), (341, [0.25] * 3), (7, [0.5] * 8), (20, [2.0] * 8), (20, [0.5] * 8), (40, rows[40][1]), (340, [1e30] * 8)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    low = [r for r in rows if r[0] != 340]
    for size in (64 << 20, 1000):
        monkeypatch.setattr(topk, "BROADCAST_BYTES", size)
        monkeypatch.setattr(topk, "SHARD", 16)
        monkeypatch.setattr(topk, "BLOCK", 4)
        got = topk.top_k(df.filter("vec_id is null or vec_id <> 340"), F.col("vec_id") % 20 == 0, 5).collect()
        assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(low, 5)
    assert topk.top_k(df, F.col("vec_id") % 20 == 0, 5).count()  # saturates
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_store(spark, tokenizer):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    rows = [*corpus(), (-5, "first <|endoftext|> x", None, None), (4001, "same text", None, None), (4001, "same text", None, None), (4002, "long " * 30000 + "tail", None, None)]
    files = token_store.write(table(spark, rows), content, store.new_path(spark, "test-tokens"))
    want, at, stream = Counter(), 0, []
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[d, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
        stream += ids.tolist()
    got = token_store.read_checksums(files).collect()
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    part = {}
    for r in token_store.read_ids(files, 100, 20_000).collect():
        part.update(zip(range(r["first"], r["first"] + len(r.ids)), r.ids, strict=True))
    assert [part[i] for i in range(100, 20_000)] == stream[100:20_000]
    assert files.table("manifest").agg(F.sum("tokens")).first()[0] == at
    chunks = files.table("rows").filter("data is not null")
    assert chunks.count() == chunks.select("hash").distinct().count() < token_store.references(files).count()
    none = token_store.write(table(spark, EMPTY), content, store.new_path(spark, "test-tokens"))
    assert token_store.read_checksums(none).collect() == []


def test_rows_without_doc_id(spark, tokenizer):
    """Rows without doc_id are rows as others are: they come first in the store, and are scanned and identified."""
    docs = table(spark, [(None, "mit license", None, None), (7, "x y", "s", "en"), (None, None, None, None), (7, "x y", "s", "en"), (None, "mit license", None, None)])
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        files = token_store.write(docs, f.read(), store.new_path(spark, "test-tokens"))
    got = sorted(token_store.read_checksums(files).collect(), key=lambda r: r.start)
    sizes = {t: len(tokenizer.encode(t).ids) + 1 for t in ("mit license", "x y", "")}
    assert [r.doc_id for r in got] == [None, None, None, 7, 7] and sorted(r.n_tokens for r in got[:3]) == sorted([sizes["mit license"]] * 2 + [sizes[""]])
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(5)]
    found = Counter((r.doc_id, r.n_base) for r in licenses.license_digest(licenses.scan_licenses(docs)).collect())
    assert found == {(None, 1): 2, (None, 0): 1, (7, 0): 2}
    model = language_id.train(docs)
    assert Counter((r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect())[None, "und"] >= 1
    assert language_id.identify(docs, model).count() == 5


def test_lost_recipes(spark):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    files = token_store.write(table(spark, corpus()), content, store.new_path(spark, "test-tokens"))
    recipes = files.table("recipes")
    first, second = recipes.orderBy("start").limit(1), recipes.orderBy("start").limit(2)
    swapped = recipes.join(second.select("start"), "start", "left_anti").select(*recipes.columns)
    (a, b) = second.collect()
    swapped = swapped.unionByName(spark.createDataFrame([{**a.asDict(), "root": b.root, "hashes": b.hashes, "lengths": b.lengths, "n_tokens": b.n_tokens}, b.asDict()], recipes.schema))
    for changed in (recipes.join(first.select("start"), "start", "left_anti"), recipes.unionByName(first), swapped, recipes.limit(0)):
        other = token_store.TokenStore(spark, store.new_path(spark, "test-tokens"))
        for name in ("rows", "manifest"):
            files.table(name).write.parquet(f"{other.path}/{name}")
        changed.select(*recipes.columns).write.parquet(f"{other.path}/recipes")
        with pytest.raises(ValueError, match="manifest"):
            token_store.read_checksums(other).collect()


def test_chunks():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 50000, 20000).astype("uint32")
    ends = token_store.chunk_ends(len(ids), token_store.chunk_places(ids).tolist())
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    longer = np.concatenate([ids[777:778], ids])
    moved = token_store.chunk_ends(len(longer), token_store.chunk_places(longer).tolist())
    # Places that were found in a longer stream give the chunks of its parts.
    after = (token_store.chunk_places(np.concatenate([ids[:300], ids])) - 300).tolist()
    assert token_store.chunk_ends(len(ids), [p for p in after if p > 0]) == ends
    assert len({e - 1 for e in moved} & set(ends)) > len(ends) // 2
    parts = [rnd.bytes(n) for n in (5, 0, 17, 4096)]
    crc = token_store.shifted_crc(np.array([zlib.crc32(p) for p in parts]), np.array([len(b"".join(parts[i + 1 :])) for i in range(4)]))
    assert int(np.bitwise_xor.reduce(crc)) == zlib.crc32(b"".join(parts))
    with pytest.raises(ValueError):
        licenses.Automaton.compile("a [[b")


def test_license_scan(spark):
    rnd = random.Random(3)
    words = ["mit", "MIT", "license", "License,", "gnu", "general", "public", "apache", "cc", "by", "cc-by", "é", "x2", "_", "\n"]
    rows = [(i, rnd.choice([" ", "-"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 14))), None, None) for i in range(400)] + corpus()
    got = {r.doc_id: r for r in licenses.license_digest(licenses.scan_licenses(table(spark, rows))).collect()}
    for d, t, *_ in dict((r[0], r) for r in rows).values():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        r = got[d]
        base = sorted({label for _, label in hits})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(base))
        assert set(base) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan_licenses(table(spark, EMPTY)).collect() == []


def test_license_templates():
    scanner = licenses.Scanner({}, {"t": "may copy [[and {{3}} sell]] this {{2}} for free"})
    accepted = ["May copy this for free", "x may copy and lend or give sell this old book for free y", "may copy this one for free"]
    refused = ["may copy this very old good book for free", "may copy and sell for free", "may not copy this for free"]
    assert [len(scanner.scan(t)[3]) for t in accepted] == [1, 1, 1] and [len(scanner.scan(t)[3]) for t in refused] == [0, 0, 0]
    with pytest.raises(ValueError):
        licenses.Scanner({}, {"t": "{{3}} word"})


def as_pattern(template):
    """The template as a regular expression over words with a space before each."""
    out, region = "", re.compile(r"(\[\[|\]\]|\{\{\d+\}\})")
    for part in region.split(template):
        if part.startswith("{{"):
            out += r"(?: \S+){0,%s}" % part[2:-2]
        elif part in ("[[", "]]"):
            out += {"[[": "(?:", "]]": ")?"}[part]
        else:
            out += "".join(" " + re.escape(w) for w in part.split())
    return re.compile(out + r"(?= |$)")


def test_shipped_templates():
    rnd, scanner, fill = random.Random(6), licenses.Scanner({}, licenses.TEMPLATES), ["acme", "the", "2", "software"]
    patterns = {label: as_pattern(t) for label, t in licenses.TEMPLATES.items()}
    accepted = Counter()
    for label, template in licenses.TEMPLATES.items():
        for _ in range(12):
            text = re.sub(r"\[\[.*?\]\]", lambda m: m[0][2:-2] if rnd.random() < 0.6 else "", template)
            text = re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(rnd.choice(fill) for _ in range(rnd.randint(0, int(m[1]) + (rnd.random() < 0.2)))), text)
            words_ = text.split()
            if rnd.random() < 0.4:  # a word of the wording is changed, dropped or doubled
                i = rnd.randrange(len(words_))
                words_[i : i + 1] = rnd.choice((["other"], [], [words_[i]] * 2))
            words_ = ["x"] * rnd.randint(0, 3) + words_ + ["y"] * rnd.randint(0, 3)
            line = " " + " ".join(words_)
            want = {x for x, p in patterns.items() if p.search(line)}
            got = scanner.scan(" ".join(words_).upper().replace(" ", ", "))[3]
            assert {m[0] for m in got} == want
            for name, start, end in got:
                assert patterns[name].fullmatch(" " + " ".join(words_[start:end]))
            accepted[label] += label in want
    assert all(accepted[label] >= 4 for label in licenses.TEMPLATES)


def test_many_places_take_linear_time():
    scanner, seconds = licenses.Scanner(licenses.PHRASES, {}), []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        found = scanner.scan("mit license " * n)
        seconds.append(time.perf_counter() - began)
        assert found[1] == list(range(0, 2 * n, 2))
    assert seconds[1] < 12 * seconds[0] + 0.1


def test_language(spark):
    rnd = random.Random(8)
    parts = {"aa": ["ba", "lo", "mi"], "bb": ["shr", "unk", "est"], "cc": ["ñu", "és", "ço"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(30)), None, lang) for i in range(240) for lang in [rnd.choice(list(parts))]]
    odd = [(900, None, None, "aa"), (901, "123 --", None, "aa"), (902, "", None, None), (903, "balomi " * 20000, None, None)]
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = table(spark, rows + odd)
    model = language_id.train(docs, use=~held)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]].lang_pred == r[3] for r in unseen) >= 0.95 * len(unseen)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language_id.train(docs.filter("lang = 'zz'"))
    assert language_id.identify(docs.limit(3), none).first().lang_pred == "und"
    assert language_id.identify(table(spark, EMPTY), model).collect() == []


def test_filter_returns_all_languages(spark):
    """An n-gram that a sample has LEAST times or more is found for that language, whatever other languages have it."""
    rows = [(i, t, g) for i, (t, g) in enumerate([("shared words here common", "a"), ("shared words there common", "b"), ("shared " * 50 + "alone", "c"), ("rare", "a")] * 4)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = {g: Counter(h for _, t, x in rows if x == g for h in language_id.gram_hashes(t).tolist()) for g in "abc"}
    chance = np.zeros(3)
    assert model.languages == list("abc")
    for i, g in enumerate("abc"):
        for h, n in seen[g].items():
            masks = [int(model.masks[p[0]]) for p in model.places(np.array([h], "uint64"))]
            if n >= language_id.LEAST:
                assert all(m >> i & 1 for m in masks)
    assert (model.shares("shared", chance) == 1).all()


def test_language_by_exact_sets(spark):
    """The filter's predictions against sets of n-grams, which have no false positives."""
    rnd = random.Random(12)
    parts = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["shr", "unk", "est", "ta"], "cc": ["ñu", "és", "ço", "lo"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[g]) for _ in range(3)) for _ in range(20)), g) for i in range(150) for g in [rnd.choice(list(parts))]]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = {g: Counter(h for _, t, x in rows if x == g for h in language_id.gram_hashes(t).tolist()) for g in parts}
    sets = {g: {h for h, n in c.items() if n >= language_id.LEAST} for g, c in seen.items()}
    texts = [(1000 + i, " ".join("".join(rnd.choice(parts[g] if rnd.random() < 0.8 else parts["aa"]) for _ in range(3)) for _ in range(rnd.randint(1, 9)))) for i in range(120) for g in [rnd.choice(list(parts))]]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for d, t in texts:
        grams = language_id.gram_hashes(t).tolist()
        shares = {g: sum(h in held for h in grams) / len(grams) for g, held in sets.items()}
        best = max(sorted(shares), key=shares.get)
        assert got[d].lang_pred == best or shares[got[d].lang_pred] > shares[best] - 0.02
        assert abs(got[d].score - shares[got[d].lang_pred] / sum(shares.values())) < 0.02


def test_language_filter_has_no_false_negatives():
    rnd = np.random.default_rng(4)
    grams = {name: rnd.integers(0, 2**63, 3000, dtype="uint64") for name in "xyz"}
    made = language_id.LanguageFilter.build(grams)
    for i, name in enumerate("xyz"):
        assert all(((made.masks[p] >> np.uint64(i)) & np.uint64(1)).all() for p in made.places(grams[name]))


def test_gains(spark):
    """The log likelihood ratio of a word and the label against its definition."""
    rnd, rows = random.Random(4), []
    for _ in range(200):
        n = rnd.randint(2, 400)
        pos, seen = rnd.randint(1, n - 1), rnd.randint(1, n)
        rows.append((n, pos, seen, rnd.randint(max(0, seen + pos - n), min(seen, pos))))
    for n, pos, seen, hit in rows[:60]:
        got = spark.range(1).select(toxicity.gain(F.lit(seen), F.lit(hit), n, pos).alias("g")).first().g
        table = {(1, 1): hit, (1, 0): seen - hit, (0, 1): pos - hit, (0, 0): n - pos - seen + hit}
        row, col = {1: seen, 0: n - seen}, {1: pos, 0: n - pos}
        want = sum(k * math.log(k * n / (row[a] * col[b])) for (a, b), k in table.items() if k)
        assert abs(got - (want if hit * n > seen * pos else 0)) < 1e-6


def test_scores_by_noisy_or(spark):
    weights = {b"bad": 2.0, b"^verba": 1.0, b"worse": 3.5}
    model = toxicity.Model(-1.0, weights, -4.0)
    texts = ["Bad day. A worse one! Nothing here", "verbal; bad bad", None, "", "fine\nfine", "BAD worse"]
    got = [r.score for r in toxicity.with_scores(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), model).orderBy("doc_id").collect()]
    sig = lambda z: 1 / (1 + math.exp(-z))
    logits = [[1.0, 2.5], [-1.0 + 2.0 + 1.0], [], [], [], [-1.0 + 2.0 + 3.5]]
    want = [1 - (1 - sig(-4.0)) * math.prod(1 - sig(z) for z in zs) for zs in logits]
    assert np.allclose(got, want)
    found = toxicity.toxic_sentences(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), model).collect()
    assert [(r.sentence, r.words) for r in found] == [(0, "bad day"), (1, "a worse one")]


def test_toxicity(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(700):
        sentences = [" ".join(rnd.choice(["the", "a", "dog", "ran", "far", "home", "sky", "blue"]) for _ in range(6)) for _ in range(rnd.randint(1, 25))]
        toxic = i % 5 == 0
        if toxic:
            sentences[rnd.randrange(len(sentences))] += " " + rnd.choice(["zork", "blarg"])
        rows.append((i, ". ".join(sentences), None, None))
        labels.append((i, int(toxic)))
    rows += [(900, None, None, None), (901, "", None, None), (902, "the dog. " * 5000, None, None)]
    docs, known = table(spark, rows).drop("score"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    held = toxicity.fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, known, use=~held)
    got = {r.doc_id: r.score for r in toxicity.with_scores(docs, model).collect()}
    unseen = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in unseen) >= 0.97 * len(unseen)
    assert all(0 <= x <= 1 for x in got.values()) and max(got[900], got[901], got[902]) < 0.5
    found = toxicity.toxic_sentences(docs, model).collect()
    assert found and all("zork" in r.words or "blarg" in r.words for r in found)
    assert toxicity.Model.from_json(model.to_json()) == model
    assert toxicity.with_scores(docs.limit(0), model).collect() == []
    none = toxicity.train(docs, known.limit(0))
    assert max(r.score for r in toxicity.with_scores(docs, none).collect()) < 0.5


def slow_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in capped]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > most * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / total for s in rest}
        for s in over:
            capped[s] = float(most * sizes[s])
        left = float(sum(sizes.values())) - sum(capped.values())


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mixing(spark, block):
    rows = [*corpus(), (50, "again", "tiny", None), (50, "again", "tiny", None), (None, "x y", "tiny", None), (51, " ", "blank", None), (52, None, "blank", None)]
    mixed = mixing.mix(table(spark, rows), block_words=block, shard_slots=5)
    got = mixed.documents.collect()
    count = Counter()
    sizes = defaultdict(int)
    for d, t, s, _ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        count[d, n, s] += 1
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == count
    targets, taken = slow_targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert abs(r.target - targets[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in sizes)
    again = mixing.mix(table(spark, rows).repartition(3), block_words=block, shard_slots=5).documents.collect()
    assert Counter((r.doc_id, r.start, r.taken) for r in again) == Counter((r.doc_id, r.start, r.taken) for r in got)
    assert mixed.slots.agg(F.sum("words")).first()[0] == sum(taken.values())
    # Each document by brute force, from the slots: the words of its source's stream that each of them stands for.
    number = {r.name: r.number for r in mixed.sources.select(F.col("source").alias("name"), "number").collect()}
    streams = defaultdict(Counter)
    for r in mixed.slots.collect():
        streams[r.number].update(range(r.block * block, r.block * block + r.words))
    for r in got:
        assert r.taken == sum(streams[number[r.source]][w] for w in range(r.start, r.start + r["size"]))
    # The draws: shards take a source's slots one behind another, and all of them.
    drawn = defaultdict(list)
    for r in mixed.draws.collect():
        drawn[r.number].append((r["first"], r["count"], r.shard))
    held = Counter((r.number, r.shard) for r in mixed.slots.collect())
    for n, parts in drawn.items():
        assert [f for f, _, _ in sorted(parts)] == [sum(c for _, c, _ in sorted(parts)[:i]) for i in range(len(parts))]
        assert all(held[n, shard] == c for _, c, shard in parts)
    assert sum(held.values()) == sum(c for parts in drawn.values() for _, c, _ in parts)
    none = mixing.mix(table(spark, EMPTY))
    assert none.documents.collect() == [] and none.slots.collect() == []


def test_halves_are_binomial(spark):
    for n in (0, 1, 63, 64, 65, 1000, mixing.COINS, mixing.COINS + 1, 10**6):
        x = np.array([r.x for r in spark.range(3000).select(mixing.half(F.lit(n).cast("long"), F.lit(7), F.col("id")).alias("x")).collect()])
        assert x.min() >= 0 and x.max() <= n
        if n:
            assert abs(x.mean() - n / 2) < 4 * (n / 4 / 3000) ** 0.5 and abs(x.var() / (n / 4) - 1) < 0.15
    sizes = spark.range(6).select(F.col("id").alias("number"), F.lit(20000).cast("long").alias("source_size"), F.lit(20000.0).alias("target"))
    _, draws = mixing._draws(sizes, 10, 100, 3)
    counts = defaultdict(Counter)
    for r in draws.collect():
        counts[r.shard][r.number] += r["count"]
    assert len(counts) == 128 and all(sum(c[n] for c in counts.values()) == 2000 for n in range(6))
    cells = np.array([[c[n] for n in range(6)] for c in counts.values()], float)
    chi2 = ((cells - 2000 / 128) ** 2 / (2000 / 128)).sum()  # 6 * 127 degrees of freedom
    assert abs(chi2 - 762) < 5 * (2 * 762) ** 0.5


def test_mixed_blocks(spark):
    rows = [(d, t, s, x) for d, t, s, x in corpus() if s and d != 3003]
    docs = table(spark, rows)
    mixed = mixing.mix(docs, block_words=16)
    texts = mixing.block_texts(docs, mixed, 16).collect()
    used = Counter()
    words = {r["name"]: r.number for r in mixed.sources.select(F.col("source").alias("name"), "number").collect()}
    for r in texts:
        used[r.number] += len(r.tokens)
    for r in mixed.documents.groupBy("source").agg(F.sum("taken").alias("t")).collect():
        assert used[words[r.source]] == r.t


def test_permutations(spark):
    for n in (1, 2, 3, 10, 1000):
        rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("x"))
        rows = rows.withColumn("back", mixing.permuted(F.col("x"), F.lit(n), F.lit(5), reverse=True)).collect()
        assert sorted(r.x for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_chat(spark):
    rnd = random.Random(2)
    bits = ["<", "|", "\\", "im_end", "|>", "<|im_end|>", "<|im_start|>assistant ok", "\n", "a", "<\\|", "é"]
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "a\n%0A<|"]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))))
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    rows += [(101, 0, "assistant", None), (101, 0, "assistant", None), (101, None, None, "x"), (None, 1, "assistant", "lost"), (102, 0, "assistant", "long " * 40000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, segment int, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256, g.rewrites) == (len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), 0)
        assert g.formatted_chars == len(chat.chatml([(r, x) for _, r, x in turns]))
    assert chat.format_chats(df.limit(0)).collect() == []


def test_rewritten_history():
    def forgets(turns):
        return "".join(f"[{r}]{'' if r == 'assistant' and i < len(turns) - 1 else x}" for i, (r, x) in enumerate(turns))

    assert [s[4] for s in chat.spans(forgets, [("user", "q"), ("assistant", "x"), ("user", "z")])[1]] == [False, False, True]
    with pytest.raises(ValueError):
        chat.parse_chatml("noise" + chat.chatml([("user", "q")]))


@pytest.mark.parametrize("name", ["counts", "strips"])
def test_rewritten_history_of_long_conversations(spark, name):
    def counts(turns):
        return f"<s {len(turns)}>" + "".join(f"[{r}]{x}" for r, x in turns)

    def strips(turns):
        return "<s>" + "".join(f"[{turns[0][1]}|{r}]{'' if r == 'assistant' and i < len(turns) - 5 else x}" for i, (r, x) in enumerate(turns))

    template = {"counts": counts, "strips": strips}[name]
    turns = [("assistant" if t % 2 else "user", f"turn {t}") for t in range(150)]
    df = spark.createDataFrame([(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    joined, rewrites = defaultdict(str), defaultdict(list)
    for r in chat.format_chats(df, template).orderBy("conv_id", "segment").collect():
        joined[r.conv_id] += r.formatted
        rewrites[r.conv_id] += [x.rewrote for x in r.spans]
    want = [t > 0 and not template(turns[: t + 1]).startswith(template(turns[:t])) for t in range(150)]
    assert joined == {1: template(turns), 2: template(turns)}
    assert all(got[1:] == want[1:] for got in rewrites.values()) and sum(want) > 60


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    ours = bpe.load_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ranks = dict(zip(ours.keys, ours.ids, strict=True))
    return ours, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(pair):
    ours, theirs = pair
    rnd = random.Random(1)
    alphabet = " \n\t  a b'sre1²\x1c\x85 é日"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    texts += ["a" * 20000, "ab " * 500 + "   \n\n  x", " ", "  ", "\n \n", ""] + [t or "" for _, t, *_ in corpus()]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t) and ours.decode(ids) == t.encode()
    assert sorted(ours.hash(k) for k in ours.keys) == list(range(len(ours.keys)))
    # With a tiny table, generations change all the time.
    most, ours.words.most, ours.words.new = ours.words.most, 5, words.Table(5)
    assert all(ours.encode(t) == theirs.encode_ordinary(t) for t in texts)
    ours.words.most, ours.words.new = most, words.Table(most)


def of_all_characters(n=6000):
    """Texts of characters about which engines disagree, of others from the whole code space, and of what patterns name."""
    rnd = random.Random(8)
    odd, every = list(map(chr, bpe.disputed())), words.code_points()
    known = [" ", "  ", "\n", "\t", "\x00", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "\u180e", "'s", "'t", "'re", "'ll", "a", "\u00e9", "1", "\u00b2", "<|endoftext|>", "!", " the"]
    some = [c + end for c in map(chr, (0xA7CE, 0xA7CF, 0xA7D2, 0xA7D4, 0xA7DD)) for end in ("'s", "'t")]
    return some + ["".join(rnd.choice(rnd.choice((known, known, odd, every))) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_bpe_of_all_characters(pair):
    ours, theirs = pair
    some = of_all_characters()
    ids, ends = ours.encode_batch(some)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [theirs.encode_ordinary(t) for t in some]


def test_library_of_all_characters(tokenizer):
    ours, some = token_store.TextEncoder(tokenizer.to_str()), of_all_characters()
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    ids, ends = ours.words.ids(pa.array(some))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == want
    ours.words.most, ours.words.new = 5, words.Table(5)
    assert [ours.words.ids(pa.array([t, None, t]))[0].tolist() for t in some[:900]] == [x + x for x in want[:900]]


def test_bpe_digests(spark, pair):
    rows = [*corpus(), (4000, "same", None, None), (4000, "same", None, None), (None, "x", None, None)]
    want = Counter()
    for d, t, *_ in rows:
        ids = pair[1].encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe_digests(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe_digests(table(spark, EMPTY)).collect() == []


def test_round_trip_is_encode_and_decode(spark, pair):
    shared = spark.sparkContext.broadcast(pair[0])
    docs = table(spark, [*corpus(), (None, "x \x1c\ua7d2's", None, None)])
    both = bpe.decode(bpe.encode(docs, shared), shared).collect()
    assert Counter(map(str, both)) == Counter(map(str, bpe.round_trip(docs, shared).collect()))


def test_heaps_side_by_side(pair):
    rnd = random.Random(2)
    words_ = [bytes(rnd.choice(b"aabcdeorst \xc3\xa9") for _ in range(n)) for n in (2, 3, 7, 8, 9, 16, 17, 31, 33, 64) for _ in range(40)]
    for width in bpe.WIDTHS:
        some = [w for w in words_ if len(w) <= width]
        assert [np.frombuffer(x, "int32").tolist() for x in pair[0].merge_together(some, width)] == [pair[0].merge(w) for w in some]


def test_over_64_languages(spark):
    rnd = random.Random(3)
    words = {f"l{k:02}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(40 * k + i, " ".join(rnd.choice(words[lang]) for _ in range(30)), lang) for k, lang in enumerate(words) for i in range(12 if k < 64 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == sorted(words)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert got == {d: lang for d, _, lang in rows}

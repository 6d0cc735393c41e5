"""Queries of the studies: resampling, robust errors, rank correlation, terms of classes, coherence, associations, axes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions.units import sections
from gleaner.operators import lookups, topics
from gleaner.operators import resampling as rs
from gleaner.operators import statistics as st
from gleaner.operators import vectors as vc
from gleaner.plans.registry import Registry
from gleaner.plans.spaces import centres
from gleaner.plans.units import with_units
from gleaner.sources.tables import load

query = Registry()


@query("""
    WITH p AS (SELECT source, sum(n_chars)::DOUBLE AS s, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), w AS (SELECT sum(s) AS s, sum(n) AS n, count(*) AS k FROM p),
    l AS (SELECT (w.s - p.s) / (w.n - p.n) AS m, w.s / w.n AS mean, k FROM p CROSS JOIN w)
    SELECT round(max(mean), 6) AS mean, round(sqrt(var_pop(m) * (max(k) - 1)), 6) AS se, max(k) AS clusters FROM l""")
def jackknife_error(spark: SparkSession, sf: str) -> DataFrame:
    return rs.jackknife(load(spark, sf, "documents"), "source", F.col("n_chars"))


@query()
def stratified_interval(spark: SparkSession, sf: str) -> DataFrame:
    return rs.stratified_bootstrap(load(spark, sf, "documents"), "doc_id", "lang", F.col("n_chars"), 200)


@query()
def did_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents")
    return rs.did_interval(rows, "doc_id", F.col("lang") == "en", F.col("doc_id") % 2 == 1, F.col("n_chars"), 200)


@query()
def clustered_permutation(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    return rs.permutation_test(rows, "doc_id", F.col("quality") == 1, F.col("n_chars"), 100, cluster="lang")


@query("""
    WITH r AS (SELECT l_returnflag AS f, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem), s AS (SELECT f, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM r GROUP BY f),
    e AS (SELECT f, n, b, sxx, x - mx AS d, (y - my - b * (x - mx)) / (1 - 1.0 / n - (x - mx) * (x - mx) / sxx) AS e FROM r JOIN s USING (f))
    SELECT f AS l_returnflag, n, round(b, 4) AS slope, round(sqrt(sum(d * d * e * e)) / sxx, 4) AS hc3 FROM e GROUP BY f, n, b, sxx""")
def robust_slopes(spark: SparkSession, sf: str) -> DataFrame:
    out = st.robust_regression(load(spark, sf, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), ["l_returnflag"])
    return out.withColumn("slope", F.round("slope", 4)).withColumn("hc3", F.round("hc3", 4))


@query("""
    WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS c FROM lineitem GROUP BY ALL), s AS (SELECT sum(a.c * b.c * CASE WHEN a.y > b.y THEN 1 WHEN a.y < b.y THEN -1 ELSE 0 END) AS s FROM c a JOIN c b ON a.x > b.x),
    n AS (SELECT sum(c) AS n, sum(c) * (sum(c) - 1) / 2.0 AS p FROM c), tx AS (SELECT sum(t * (t - 1) / 2.0) AS tx FROM (SELECT sum(c) AS t FROM c GROUP BY x)), ty AS (SELECT sum(t * (t - 1) / 2.0) AS ty FROM (SELECT sum(c) AS t FROM c GROUP BY y))
    SELECT CAST(n AS BIGINT) AS n, round(s / sqrt((p - tx) * (p - ty)), 6) AS tau FROM s CROSS JOIN n CROSS JOIN tx CROSS JOIN ty""")
def kendall_tau(spark: SparkSession, sf: str) -> DataFrame:
    return st.kendall(load(spark, sf, "lineitem"), "l_quantity", "l_discount")


_CLASS = """
    WITH w AS (SELECT lang AS class, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents WHERE lang IS NOT NULL), tf AS (SELECT class, term, count(*) AS tf FROM w GROUP BY ALL), f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1),
    a AS (SELECT sum(tf) / count(DISTINCT class) AS a FROM tf), x AS (SELECT class, term, tf * ln(1 + a / f) AS w FROM tf JOIN f USING (term) CROSS JOIN a), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY w DESC, term) AS rank FROM x)"""


@query(_CLASS + " SELECT class, CAST(rank AS INTEGER) AS rank, term, round(w, 4) AS weight FROM r WHERE rank <= 10")
def class_terms(spark: SparkSession, sf: str) -> DataFrame:
    return st.class_terms(load(spark, sf, "documents").select("lang", tx.tokens(F.col("text"), "[a-z]{3,}").alias("w")), F.col("w"), F.col("lang"), 10)


@query(_CLASS + """, t AS (SELECT class AS topic, term FROM r WHERE rank <= 6), d AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) WHERE term IN (SELECT term FROM t)),
    n AS (SELECT count(*) AS n FROM documents), k AS (SELECT term, count(*) AS k FROM d GROUP BY 1), b AS (SELECT x.term AS a, y.term AS b, count(*) AS met FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL),
    p AS (SELECT x.topic, CASE WHEN met IS NULL THEN -1 WHEN met = n THEN 1 ELSE ln((met / n) / ((kx.k / n) * (ky.k / n))) / (-ln(met / n)) END AS npmi
          FROM t x JOIN t y ON x.topic = y.topic AND x.term < y.term JOIN k kx ON kx.term = x.term JOIN k ky ON ky.term = y.term LEFT JOIN b ON b.a = x.term AND b.b = y.term CROSS JOIN n),
    m AS (SELECT topic, avg((c = 1)::INT) AS diversity FROM (SELECT topic, count(*) OVER (PARTITION BY term) AS c FROM t) GROUP BY topic)
    SELECT topic, round(avg(npmi), 6) AS npmi, round(max(diversity), 6) AS diversity FROM p JOIN m USING (topic) GROUP BY topic""")
def topic_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """How well the strongest terms of each language hold together, and how many are its own."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", tx.tokens(F.col("text"), "[a-z]{3,}").alias("w"))
    topics = st.class_terms(docs, F.col("w"), F.col("lang"), 6).select(F.col("class").alias("topic"), "term")
    return st.coherence(docs, "doc_id", F.col("w"), topics)


@query("""
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), x AS (SELECT label, unnest(generate_series(1, len(e))) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), a AS (SELECT c AS ca FROM c WHERE label = 0), b AS (SELECT c AS cb FROM c WHERE label = 1),
    s AS (SELECT label, list_cosine_similarity(e, ca) - list_cosine_similarity(e, cb) AS s FROM v CROSS JOIN a CROSS JOIN b WHERE label IN (2, 3))
    SELECT round((avg(s) FILTER (WHERE label = 2) - avg(s) FILTER (WHERE label = 3)) / stddev_samp(s), 5) AS d, count(*) AS n FROM s""")
def association_effect(spark: SparkSession, sf: str) -> DataFrame:
    """The effect size of the differential association of two sets of vectors with two attributes."""
    c = centres(spark, sf)
    rows = load(spark, sf, "embeddings").filter("label in (2, 3)").withColumn("s", vc.differential_association(F.col("embedding"), c[0], c[1]))
    gap = F.avg(F.when(F.col("label") == 2, F.col("s"))) - F.avg(F.when(F.col("label") == 3, F.col("s")))
    return rows.agg(F.round(gap / F.stddev("s"), 5).alias("d"), F.count(F.lit(1)).alias("n"))


@query()
def association_test(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of the association, and its chance by relabelings (both plus one)."""
    c = centres(spark, sf)
    rows = load(spark, sf, "embeddings").filter("label in (2, 3)").withColumn("s", vc.differential_association(F.col("embedding"), c[0], c[1]))
    return rs.permutation_test(rows, "vec_id", F.col("label") == 2, F.col("s"), 200)


@query()
def axis_stability(spark: SparkSession, sf: str) -> DataFrame:
    """An axis from pairs of centroids, and without each pair: its cosine with the whole axis, and where the pair then lies."""
    c = centres(spark, sf)
    pairs = [(a, b) for a, b in zip(sorted(c)[::2], sorted(c)[1::2], strict=False)]
    return spark.createDataFrame(vc.leave_one_out([(a, b, c[a] - c[b]) for a, b in pairs]), "a int, b int, cosine double, held_out double")


@query("""
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), x AS (SELECT label, unnest(generate_series(1, len(e))) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), a AS (SELECT x.c AS ca, y.c AS cb FROM c x JOIN c y ON x.label = 0 AND y.label = 1), p AS (SELECT vec_id, label, (list_dot_product(e, cb) - list_dot_product(e, ca)) / list_distance(ca, cb) / sqrt(list_dot_product(e, e)) AS p FROM v CROSS JOIN a)
    SELECT label, round(quantile_cont(p, 0.1), 5) AS p10, round(quantile_cont(p, 0.5), 5) AS p50, round(quantile_cont(p, 0.9), 5) AS p90 FROM p GROUP BY label""")
def axis_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Where the vectors of each label lie on the axis from one centroid to another."""
    c = centres(spark, sf)
    axis = (c[1] - c[0]) / np.linalg.norm(c[1] - c[0])
    rows = load(spark, sf, "embeddings").select("label", vc.dot(vc.unit(F.col("embedding")), vc.constant(axis)).alias("p"))
    return rows.groupBy("label").agg(*[F.round(F.percentile("p", q / 100), 5).alias(f"p{q}") for q in (10, 50, 90)])


_SYLLABLES = r"[aeiouy]+"
_SILENT = r"[bcdfghjkmnpqrstvwxz]e([^a-zà-ÿ]|$)"


@query(r"""
    WITH t AS (SELECT doc_id, lower(text) AS t, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, len(regexp_extract_all(text, '[.!?]+')) AS ends FROM documents),
    s AS (SELECT doc_id, words, greatest(ends, 1) AS sentences, greatest(len(regexp_extract_all(t, '[aeiouy]+')) - len(regexp_extract_all(t, '[bcdfghjkmnpqrstvwxz]e([^a-zà-ÿ]|$)')), words) AS syllables FROM t WHERE words > 0)
    SELECT doc_id, round(206.835::DOUBLE - 1.015::DOUBLE * (words / sentences::DOUBLE) - 84.6::DOUBLE * (syllables / words::DOUBLE), 6) AS ease, round(0.39::DOUBLE * (words / sentences::DOUBLE) + 11.8::DOUBLE * (syllables / words::DOUBLE) - 15.59::DOUBLE, 6) AS grade FROM s""")
def reading_ease(spark: SparkSession, sf: str) -> DataFrame:
    """Flesch's ease and grade; a syllable is a run of vowels, but for a silent e at a word's end, and a word has one at least."""
    text = F.col("text")
    rows = load(spark, sf, "documents").select("doc_id", tx.word_count(text).alias("words"), F.greatest(tx.matches(text, "[.!?]+"), F.lit(1)).alias("sentences"), (tx.matches(F.lower(text), _SYLLABLES) - tx.matches(F.lower(text), _SILENT)).alias("s"))
    per_word, per_sentence = F.greatest("s", "words") / F.col("words"), F.col("words") / F.col("sentences")
    return rows.filter("words > 0").select("doc_id", F.round(206.835 - 1.015 * per_sentence - 84.6 * per_word, 6).alias("ease"), F.round(0.39 * per_sentence + 11.8 * per_word - 15.59, 6).alias("grade"))


#: Small words by which a language shows.
_SMALL = {"en": "the|of|and|to|with|for|is", "de": "der|die|das|und|mit|ist|zu", "fr": "le|la|les|des|et|une|est", "es": "el|los|las|y|una|es|del"}


@query(
    "WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^ -~]', '', 'g')) / nullif(length(text), 0)::DOUBLE AS plain, "
    + ", ".join(f"len(regexp_extract_all(lower(text), '\\b({w})\\b')) AS {n}" for n, w in _SMALL.items())
    + " FROM documents) SELECT doc_id, CASE WHEN plain IS NULL THEN 'unknown' WHEN plain >= 0.6 AND en > 0 AND en >= greatest(de, fr, es) THEN 'true' ELSE 'false' END AS english FROM c"
)
def english_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text is English: mostly printable ASCII, with small words of English, no fewer than of another language; '' and null are unknown."""
    text = F.col("text")
    rows = load(spark, sf, "documents").select("doc_id", tx.printable_share(text).alias("plain"), tx.ascii_words(text, "|".join(_SMALL.values())).alias("w"))
    counts = {n: tx.count_in("w", w.split("|")) for n, w in _SMALL.items()}
    yes = (F.col("plain") >= 0.6) & (counts["en"] > 0) & (counts["en"] >= F.greatest(*[c for n, c in counts.items() if n != "en"]))
    return rows.select("doc_id", F.when(F.col("plain").isNull(), "unknown").otherwise(yes.cast("string")).alias("english"))


@query("""
    WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS limits, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1),
    w AS (SELECT *, avg(n) OVER p AS mean, count(*) OVER p AS days FROM d WINDOW p AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)), k AS (SELECT count(DISTINCT event_type) AS k FROM events)
    SELECT day, n, days = 7 AND n < 0.5 * mean AS low, 1 - users / n::DOUBLE > 0.9 AS repetitive, limits >= 3 AS limited, kinds < k AS missing FROM w CROSS JOIN k""")
def alert_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Days with under half of the mean of the seven before, mostly repeated rows, three refusals or more, or a missing kind."""
    rows = load(spark, sf, "events")
    day = rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("limits"), F.count_distinct("event_type").alias("kinds")
    )
    kinds = rows.agg(F.count_distinct("event_type").alias("k"))
    week = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(-7, -1)  # a row for each day
    low = (F.count("n").over(week) == 7) & (F.col("n") < 0.5 * F.avg("n").over(week))
    out = day.withColumn("low", F.coalesce(low, F.lit(False))).crossJoin(F.broadcast(kinds))  # one row
    return out.select("day", "n", "low", (1 - F.col("users") / F.col("n") > 0.9).alias("repetitive"), (F.col("limits") >= 3).alias("limited"), (F.col("kinds") < F.col("k")).alias("missing"))


@query("""
    SELECT lang, round(avg(regexp_matches(text, '[0-9]')::INT), 6) AS raw, round(avg(regexp_matches(substr(text, 1, 400), '[0-9]')::INT), 6) AS core,
           round(avg(regexp_matches(substr(text, 1, 400), '[0-9]')::INT) - avg(regexp_matches(text, '[0-9]')::INT), 6) AS shift FROM documents GROUP BY lang""")
def substrate_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """The same rate over two substrates: whole texts and their beginnings."""
    hit = lambda c: F.avg(c.rlike("[0-9]").cast("int"))
    raw, core = hit(F.col("text")), hit(F.substring("text", 1, 400))
    return load(spark, sf, "documents").groupBy("lang").agg(F.round(raw, 6).alias("raw"), F.round(core, 6).alias("core"), F.round(core - raw, 6).alias("shift"))


@query("""
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), x AS (SELECT label, unnest(generate_series(1, len(e))) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), a AS (SELECT x.c AS ca, y.c AS cb FROM c x JOIN c y ON x.label = 0 AND y.label = 1), p AS (SELECT vec_id % 2 AS era, abs(list_dot_product(e, cb) - list_dot_product(e, ca)) / list_distance(ca, cb) < 0.05 AS near FROM v CROSS JOIN a)
    SELECT era, count(*) AS n, round(avg(near::INT), 6) AS near_boundary FROM p GROUP BY era""")
def boundary_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each era's vectors that lie near the boundary between two centroids."""
    rows = _projected(spark, sf)
    return rows.groupBy("era").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.abs("p") < 0.05).cast("int")), 6).alias("near_boundary"))


@query()
def boundary_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """The change of that share between eras, and its chance by relabelings (both plus one)."""
    return rs.permutation_test(_projected(spark, sf), "vec_id", F.col("era") == 1, (F.abs("p") < 0.05).cast("double"), 200)


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    c = centres(spark, sf)
    axis = (c[1] - c[0]) / np.linalg.norm(c[1] - c[0])
    return load(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 2).alias("era"), vc.projection(F.col("embedding"), axis).alias("p"))


@query()
def drift_null(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's drift between eras, and the share of relabeled eras with one at least as large (both plus one)."""
    return vc.drift_test(load(spark, sf, "embeddings"), "vec_id", "label", F.col("vec_id") % 2 == 1, "embedding", 50)


@query()
def text_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each kind of section over all documents."""
    units = with_units(load(spark, sf, "documents"), "doc_id", "text").select("doc_id", sections("units").alias("s"))
    return units.select("doc_id", F.explode("s").alias("x")).groupBy("x.section").agg(F.sum(F.length("x.text")).alias("chars"), F.count_distinct("doc_id").alias("docs"))


@query()
def factor_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest terms of the factors of a non-negative factorisation of documents by terms."""
    docs = load(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text"), "[a-z]{3,}").alias("w"))
    return topics.factors(docs, "doc_id", F.col("w"), 4, 8)


@query()
def latent_topics(spark: SparkSession, sf: str) -> DataFrame:
    """How the documents of each language spread over the topics of a latent Dirichlet allocation."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", tx.tokens(F.col("text"), "[a-z]{3,}").alias("w"))
    return topics.mixtures(docs, "w", 4).groupBy("lang", "topic").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH c AS (SELECT c_custkey % 60 AS city, min(c_nationkey % 3) AS state FROM customer GROUP BY 1)
    SELECT 'city ' || city AS city, 'state ' || state AS state, CASE WHEN city % 4 = 0 THEN 'title metro ' || city WHEN city % 4 = 1 AND state < 2 THEN 'county metro ' || state WHEN city % 6 = 2 THEN 'fallback metro ' || city END AS metro,
           CASE WHEN city % 4 = 0 THEN 'medium' WHEN city % 4 = 1 AND state < 2 THEN 'high' WHEN city % 6 = 2 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def metro_reference(spark: SparkSession, sf: str) -> DataFrame:
    """A metro for each city: by its title, else by the county that a geocoder found, else by a wider title."""
    cities = load(spark, sf, "customer").groupBy((F.col("c_custkey") % 60).alias("k")).agg(F.min(F.col("c_nationkey") % 3).alias("s"))
    label = lambda text, c: F.concat(F.lit(text), F.col(c).cast("string"))
    named = cities.select("k", "s", label("city ", "k").alias("city"), label("state ", "s").alias("state"))
    titles = named.filter("k % 4 = 0").select("city", "state", label("title metro ", "k").alias("metro"))
    found = named.filter("k % 4 in (0, 1)").select("city", "state", label("county ", "s").alias("county"))
    counties = named.filter("s < 2").select(label("county ", "s").alias("county"), label("county metro ", "s").alias("metro")).distinct()
    wider = named.filter("k % 6 = 2").select("city", "state", label("fallback metro ", "k").alias("metro"))
    return lookups.metro_reference(named.select("city", "state"), titles, found, counties, wider)

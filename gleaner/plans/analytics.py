"""Queries over the statistics and the vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import statistics as st
from gleaner.operators import vectors as vc
from gleaner.plans.registry import Registry
from gleaner.sources.tables import load

query = Registry()


@query("""
    WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE contains(text, 'icense')) AS k FROM documents GROUP BY source), z AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g)
    SELECT source, n, k, CASE WHEN k = 0 THEN 0.0 ELSE round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) END::DOUBLE AS low, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM z""")
def wilson_intervals(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("text", F.lit("icense"))).alias("k"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_RANKED = """
    WITH r AS (SELECT o_orderpriority AS k, o_totalprice AS x, o_custkey AS y FROM orders),
    q AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2 AS ry FROM r)
    SELECT k AS o_orderpriority, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM q GROUP BY k"""


@query(_RANKED)
def rank_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return st.spearman(load(spark, sf, "orders"), "o_totalprice", "o_custkey", ["o_orderpriority"])


@query("""
    WITH s AS (SELECT avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS m1, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m2, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS v1,
      var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS v2, count(*) FILTER (WHERE o_orderstatus = 'F') AS n1, count(*) FILTER (WHERE o_orderstatus = 'O') AS n2, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 200000) AS k1,
      count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 200000) AS k2 FROM orders)
    SELECT round((m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2)), 6) AS d, round((m1 - m2) / sqrt(v1/n1 + v2/n2), 6) AS t, round(2*asin(sqrt(k1/n1)) - 2*asin(sqrt(k2/n2)), 6) AS h,
      round((k1/n1 - k2/n2) / sqrt(((k1+k2)/(n1+n2)) * (1 - (k1+k2)/(n1+n2)) * (1/n1 + 1/n2)), 6) AS z FROM s""")
def effect_sizes(spark: SparkSession, sf: str) -> DataFrame:
    a, b, x = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", F.col("o_totalprice")
    one = load(spark, sf, "orders").agg(
        F.avg(F.when(a, x)).alias("m1"), F.avg(F.when(b, x)).alias("m2"), F.var_samp(F.when(a, x)).alias("v1"), F.var_samp(F.when(b, x)).alias("v2"),
        F.count_if(a).alias("n1"), F.count_if(b).alias("n2"), F.count_if(a & (x > 200000)).alias("k1"), F.count_if(b & (x > 200000)).alias("k2"),
    )
    m = [F.col(c) for c in ("m1", "m2", "v1", "v2", "n1", "n2")]
    k1, n1, k2, n2 = (F.col(c) for c in ("k1", "n1", "k2", "n2"))
    return one.select(F.round(st.cohen_d(*m), 6).alias("d"), F.round(st.welch_t(*m)[0], 6).alias("t"), F.round(st.cohen_h(k1 / n1, k2 / n2), 6).alias("h"), F.round(st.two_proportion_z(k1, n1, k2, n2), 6).alias("z"))


@query("""
    WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS o FROM orders GROUP BY ALL), r AS (SELECT a, sum(o) AS r FROM c GROUP BY a), s AS (SELECT b, sum(o) AS s FROM c GROUP BY b), n AS (SELECT sum(o)::DOUBLE AS n FROM c),
    e AS (SELECT a, b, r * s / n AS e, n FROM r CROSS JOIN s CROSS JOIN n), x AS (SELECT sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi, max(n) AS n FROM e LEFT JOIN c USING (a, b))
    SELECT round(chi, 4) AS chi2, (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM c) AS dof, round(sqrt(chi / (n * (SELECT least(count(DISTINCT a), count(DISTINCT b)) - 1 FROM c))), 6) AS cramers_v FROM x""")
def chi_square(spark: SparkSession, sf: str) -> DataFrame:
    return st.chi_square(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("""
    WITH q AS (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id)),
    s AS (SELECT lang, sum(r) FILTER (WHERE toxic = 1) AS rs, count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic <> 1) AS n2 FROM q GROUP BY lang), u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u FROM s)
    SELECT lang, n1, n2, round(u, 1) AS u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z, round(u / (n1 * n2), 6) AS auc FROM u""")
def rank_sum_tests(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id")
    return st.rank_sum(rows, "n_chars", F.col("toxic") == 1, ["lang"])


@query("""
    WITH s AS (SELECT n_chars AS v, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang <> 'en') AS b FROM documents GROUP BY 1)
    SELECT round(max(d), 6) AS ks FROM (SELECT abs(sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER ()) AS d FROM s)""")
def kolmogorov_distance(spark: SparkSession, sf: str) -> DataFrame:
    return st.kolmogorov(load(spark, sf, "documents"), "n_chars", F.col("lang") == "en")


@query("""
    WITH g AS (SELECT o_custkey, count(*) FILTER (WHERE NOT l) AS n0, count(*) FILTER (WHERE l) AS n1, avg(v) FILTER (WHERE NOT l) AS m0, avg(v) FILTER (WHERE l) AS m1
      FROM (SELECT o_custkey, o_orderdate >= TIMESTAMP '1995-07-01' AS l, CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM orders) GROUP BY 1),
    s AS (SELECT *, n0 / sum(n0) OVER () AS s0, n1 / sum(n1) OVER () AS s1, m0 IS NOT NULL AND m1 IS NOT NULL AS b FROM g)
    SELECT count(*) FILTER (WHERE b) AS units, round(sum(coalesce(s1 * m1, 0)) - sum(coalesce(s0 * m0, 0)), 6) AS change, round(sum((s0 + s1) / 2 * (m1 - m0)) FILTER (WHERE b), 6) AS within,
      round(sum((m0 + m1) / 2 * (s1 - s0)) FILTER (WHERE b), 6) AS between, round(sum(CASE WHEN b THEN 0 ELSE coalesce(s1 * m1, 0) - coalesce(s0 * m0, 0) END), 6) AS turnover FROM s""")
def within_between(spark: SparkSession, sf: str) -> DataFrame:
    later = F.col("o_orderdate") >= F.lit("1995-07-01").cast("timestamp")
    return st.decomposition(load(spark, sf, "orders"), "o_custkey", later, F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0))


@query("""
    WITH c AS (SELECT avg(v) FILTER (WHERE NOT t AND NOT p) AS m_00, avg(v) FILTER (WHERE NOT t AND p) AS m_01, avg(v) FILTER (WHERE t AND NOT p) AS m_10, avg(v) FILTER (WHERE t AND p) AS m_11
      FROM (SELECT o_orderpriority = '1-URGENT' AS t, o_orderdate >= TIMESTAMP '1995-07-01' AS p, o_totalprice AS v FROM orders))
    SELECT round(m_00, 6) AS m_00, round(m_01, 6) AS m_01, round(m_10, 6) AS m_10, round(m_11, 6) AS m_11, round((m_11 - m_10) - (m_01 - m_00), 6) AS did FROM c""")
def difference_in_differences(spark: SparkSession, sf: str) -> DataFrame:
    return st.diff_in_diff(load(spark, sf, "orders"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate") >= F.lit("1995-07-01").cast("timestamp"), F.col("o_totalprice"))


@query("""
    WITH p AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels), n AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po FROM p),
    e AS (SELECT sum(x * y) AS xy FROM (SELECT a, count(*)::DOUBLE AS x FROM p GROUP BY a) JOIN (SELECT b, count(*)::DOUBLE AS y FROM p GROUP BY b) ON a = b)
    SELECT n, round(po, 6) AS agreement, round((po - xy / (n::DOUBLE * n)) / (1 - xy / (n::DOUBLE * n)), 6) AS kappa FROM n CROSS JOIN e""")
def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return st.kappa(load(spark, sf, "labels"), "quality", "toxic")


@query("""
    WITH p AS (SELECT toxic = 1 AS t, regexp_matches(text, 'idiot|scum|clown|trash') AS r FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT count(*) FILTER (WHERE t AND r) AS tp, count(*) FILTER (WHERE NOT t AND r) AS fp, count(*) FILTER (WHERE t AND NOT r) AS fn FROM p)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def rule_against_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", "text").join(load(spark, sf, "labels"), "doc_id")
    return rows.agg(*st.retrieval_scores(F.col("toxic") == 1, F.col("text").rlike("idiot|scum|clown|trash")))


_TERMS = """
    WITH w AS (SELECT lang = 'en' AS c, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents), t AS (SELECT term, count(*) FILTER (WHERE c) AS a, count(*) FILTER (WHERE NOT c) AS b FROM w GROUP BY term)"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return st.term_counts(load(spark, sf, "documents"), tx.tokens(F.col("text"), "[a-z]{3,}"), F.col("lang") == "en")


@query(_TERMS + """, n AS (SELECT sum(a) AS sa, sum(b) AS sb, count(*) * 0.01 AS pr FROM t), x AS (SELECT term, a, b, a + 0.01 AS x, b + 0.01 AS y, sa, sb, pr FROM t CROSS JOIN n),
    d AS (SELECT *, (ln(x / (sa + pr - x)) - ln(y / (sb + pr - y)))::DOUBLE AS d FROM x)
    SELECT term, a, b, round(d, 6) AS log_odds, round(d / sqrt(1 / x + 1 / y), 6) AS z FROM d WHERE a + b >= 50""")
def distinguishing_terms(spark: SparkSession, sf: str) -> DataFrame:
    return st.log_odds(_counts(spark, sf)).filter("a + b >= 50")


@query(_TERMS + """, n AS (SELECT sum(a) AS sa, sum(b) AS sb FROM t), p AS (SELECT a, b, a / sa AS p, b / sb AS q FROM t CROSS JOIN n)
    SELECT round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 6) AS jsd,
           count(*) FILTER (WHERE a = 0 AND b > 0) AS only_b, count(*) FILTER (WHERE b = 0 AND a > 0) AS only_a FROM p""")
def term_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return st.jensen_shannon(_counts(spark, sf))


@query("""
    SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""")
def regression_lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(*st.regression(F.col("l_quantity"), F.col("l_extendedprice")))


_VEC = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), "
_CENT = "x AS (SELECT label, unnest(generate_series(1, len(e))) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)"


@query(_VEC + _CENT + " SELECT v.label, count(*) AS n, round(avg(1 - list_cosine_similarity(e, c)), 6) AS spread FROM v JOIN c USING (label) GROUP BY 1")
def cluster_spread(spark: SparkSession, sf: str) -> DataFrame:
    return vc.spread(load(spark, sf, "embeddings"), "label", "embedding")


@query(_VEC + _CENT + " SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS cosine FROM c a JOIN c b ON a.label < b.label")
def centroid_similarities(spark: SparkSession, sf: str) -> DataFrame:
    return vc.centroid_similarity(load(spark, sf, "embeddings"), "label", "embedding")


@query(_VEC + "p AS (SELECT a.label, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id), n AS (SELECT label, count(*) AS n FROM v GROUP BY 1) SELECT label, n, round(avg(s), 6) AS mean_cosine FROM p JOIN n USING (label) GROUP BY label, n")
def template_saturation(spark: SparkSession, sf: str) -> DataFrame:
    return vc.mean_pairwise_cosine(load(spark, sf, "embeddings"), "label", "embedding")


@query(_VEC + "a AS (SELECT e AS anchor FROM v WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(e, anchor), 6) AS cosine FROM v CROSS JOIN a ORDER BY list_cosine_similarity(e, anchor) DESC, vec_id LIMIT 15")
def anchor_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings")
    anchor = rows.filter("vec_id = 7").select("embedding").first()[0]
    return vc.nearest_to(rows, "vec_id", "embedding", vc.constant(anchor), 15).withColumn("cosine", F.round("cosine", 6))

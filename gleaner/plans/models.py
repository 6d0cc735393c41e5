"""Queries over clusterings, feature matrices, alerts, core tables and fitted models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import clusters as cl
from gleaner.plans.registry import Registry
from gleaner.sources.tables import load

query = Registry()


@query("""
    WITH c AS (SELECT source AS a, lang AS b, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), x AS (SELECT a, sum(n) AS x FROM c GROUP BY a), y AS (SELECT b, sum(n) AS y FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
    s AS (SELECT sum(n * (n - 1) / 2) AS same, sum(n / t * ln(n * t / (x * y))) AS mi FROM c JOIN x USING (a) JOIN y USING (b) CROSS JOIN t), p AS (SELECT sum(x * (x - 1) / 2) AS sx, -sum(x / t * ln(x / t)) AS hx FROM x CROSS JOIN t),
    q AS (SELECT sum(y * (y - 1) / 2) AS sy, -sum(y / t * ln(y / t)) AS hy FROM y CROSS JOIN t)
    SELECT t::BIGINT AS n, round((same - sx * sy / (t * (t - 1) / 2)) / ((sx + sy) / 2 - sx * sy / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((hx + hy) / 2), 6) AS nmi FROM s CROSS JOIN p CROSS JOIN q CROSS JOIN t""")
def clustering_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return cl.clustering_agreement(load(spark, sf, "documents"), "source", "lang")


_TECH = {"plus": r"[a-z][+]{2}", "sharp": "[a-z]#", "dotted": "[.][a-z]+", "digits": "[0-9]{4}", "pipe": "[|]", "license": "icense"}


@query(r"SELECT doc_id, " + ", ".join(f"regexp_matches(regexp_replace(text, '\\\\([+#.\\-*_&])', '\\1', 'g'), '{p}') AS {n}" for n, p in _TECH.items()) + " FROM documents")
def technology_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return cl.feature_matrix(load(spark, sf, "documents"), "doc_id", cl.unescaped(F.col("text")), _TECH, width=3)


@query("""
    WITH f AS (SELECT o_custkey AS u, o_orderpriority AS x FROM orders GROUP BY ALL), t AS (SELECT count(DISTINCT u)::DOUBLE AS t FROM f), n AS (SELECT x, count(*)::DOUBLE AS n FROM f GROUP BY x),
    p AS (SELECT a.x AS a, b.x AS b, count(*) AS n_both FROM f a JOIN f b ON a.u = b.u AND a.x < b.x GROUP BY ALL)
    SELECT p.a, p.b, n_both, round((t * n_both - na.n * nb.n) / sqrt(na.n * nb.n * (t - na.n) * (t - nb.n)), 6) AS phi, round(ln(t * n_both / (na.n * nb.n)) / -ln(n_both / t), 6) AS npmi
    FROM p JOIN n na ON na.x = p.a JOIN n nb ON nb.x = p.b CROSS JOIN t""")
def feature_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("f"))
    return cl.cooccurrence(rows, "o_custkey", F.col("f"))


@query()
def feature_communities(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(F.element_at(F.split("p_name", " "), -1)).alias("f"))
    pairs = cl.cooccurrence(rows, "p_brand", F.col("f")).filter("n_both >= 2").select("a", "b", "n_both").collect()  # of a fixed vocabulary
    found = cl.communities([(r.a, r.b, float(r.n_both)) for r in pairs])
    return spark.createDataFrame(sorted(found.items()), "feature string, community int")


@query("""
    WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS site, count(*) AS n, count(DISTINCT user_id) AS kept FROM events GROUP BY ALL),
    m AS (SELECT *, avg(n) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean7, 1 - kept / n AS dropped FROM d)
    SELECT day, site, n, round(mean7, 6) AS mean7, round(dropped, 6) AS dropped, concat_ws('|', CASE WHEN n < 0.5 * mean7 THEN 'low_volume' END, CASE WHEN dropped > 0.9 THEN 'mostly_duplicates' END, CASE WHEN n = 0 THEN 'no_rows' END) AS flags FROM m""")
def alert_metrics(spark: SparkSession, sf: str) -> DataFrame:
    daily = load(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("site")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("kept"))
    return cl.alert_metrics(daily, "day", "site", "n", "kept")


@query("""
    WITH c AS (SELECT DISTINCT c_mktsegment AS g, c_custkey AS k FROM customer), h AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 350000)
    SELECT g AS segment, count(*) AS keys, count(h.k) AS cached, round(count(h.k) / count(*), 6) AS hit_rate FROM c LEFT JOIN h USING (k) GROUP BY g""")
def cache_hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"))
    return cl.cache_hit_rates(rows, load(spark, sf, "orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("k")), "k", "segment")


@query("""
    WITH q AS (SELECT list_sort(list_distinct(quantile_cont(n_chars, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM documents)
    SELECT bin, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM (SELECT n_chars, greatest(len(list_filter(e, lambda x: x < n_chars)) - 1, 0) AS bin FROM documents CROSS JOIN q) GROUP BY bin""")
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = cl.quantile_bins(load(spark, sf, "documents").select("n_chars"), "n_chars", 4)
    return rows.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("""
    SELECT d.doc_id AS uid, d.lang AS language, sha256(d.text) AS description_hash, length(d.text) AS description_length, coalesce(l.quality = 1, false) AS is_core, coalesce(l.toxic = 1, false) AS is_control
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.n_chars >= 100 AND (l.quality = 1 OR d.source = 'src1')""")
def core_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    core = F.col("quality") == 1
    # Three-valued: unknown or true is true, so control rows stay without a label.
    rows = rows.filter((F.col("n_chars") >= 100) & (core | (F.col("source") == "src1")))
    computed = {"is_core": F.coalesce(core, F.lit(False)), "is_control": F.coalesce(F.col("toxic") == 1, F.lit(False)), "description_hash": tx.lineage_hash(F.col("text")), "description_length": F.length("text").cast("long")}
    return rows.select(F.col("doc_id").alias("uid"), F.col("lang").alias("language"), *[c.alias(n) for n, c in computed.items()])


@query("""
    WITH o AS (SELECT DISTINCT user_id AS uid, strftime(ts, '%Y-%m-%d') AS scrape_date FROM events), u AS (SELECT c_custkey AS uid, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0)
    SELECT uid, scrape_date, segment FROM o JOIN u USING (uid)""")
def core_observations(spark: SparkSession, sf: str) -> DataFrame:
    seen = load(spark, sf, "events").select(F.col("user_id").alias("uid"), F.date_format("ts", "yyyy-MM-dd").alias("scrape_date")).distinct()
    return seen.join(load(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("segment")), "uid")


@query("""
    SELECT count(*) AS rows, count(DISTINCT doc_id) AS uids, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars < 50) AS short, count(*) FILTER (WHERE quality IS NOT NULL) AS labeled,
           count(*) FILTER (WHERE toxic = 1) AS toxic, count(DISTINCT source) AS sources, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS max_chars FROM documents LEFT JOIN labels USING (doc_id)""")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("doc_id").alias("uids"),
        F.count_if(F.col("lang") == "en").alias("english"),
        F.count_if(F.col("n_chars") < 50).alias("short"),
        F.count("quality").alias("labeled"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_distinct("source").alias("sources"),
        F.round(F.avg("n_chars"), 6).alias("mean_chars"),
        F.max("n_chars").alias("max_chars"),
    )


@query("""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS t FROM documents), f AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT t, count(*) AS df FROM f GROUP BY t), n AS (SELECT count(*) AS n FROM documents)
    SELECT doc_id, t AS term, round(tf * ln((n + 1) / (df + 1)), 6) AS weight FROM f JOIN d USING (t) CROSS JOIN n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf * ln((n + 1) / (df + 1)) DESC, t) <= 3""")
def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The three terms of each document that weigh most."""
    docs = load(spark, sf, "documents")
    docs = docs.select("doc_id", tx.tokens(F.col("text"), "[a-z]{2,}").alias("w"))
    words = docs.select("doc_id", F.explode_outer("w").alias("term")).filter("term is not null")  # explode() would match the pattern twice more
    tf = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads tf, so that both sides of the join share one shuffle
    weight = F.col("tf") * F.ln((F.col("n") + 1) / (F.col("df") + 1))
    rows = tf.join(df, "term").crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).withColumn("x", weight)
    top = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("x"), "term"))
    return rows.withColumn("r", top).filter("r <= 3").select("doc_id", "term", F.round("x", 6).alias("weight"))


@query()
def text_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """TF-IDF, length 1, k-means: the share of each language per cluster."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", tx.tokens(F.col("text"), "[a-zà-ÿ]{2,}").alias("w"))
    counted = HashingTF(inputCol="w", outputCol="c", numFeatures=1 << 16).transform(docs)  # every term counts, at one of these places
    weighted = Normalizer(inputCol="i", outputCol="features").transform(IDF(inputCol="c", outputCol="i", minDocFreq=2).fit(counted).transform(counted))
    found = KMeans(k=4, seed=1, maxIter=10).fit(weighted).transform(weighted)
    return found.groupBy("prediction", "lang").agg(F.count(F.lit(1)).alias("n"))


@query()
def boundary_auc(spark: SparkSession, sf: str) -> DataFrame:
    """How well two labels are told apart: the area under the curve per fold of a logistic model, folds by hash."""
    rows = load(spark, sf, "embeddings").filter("label in (0, 1)").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("raw"))
    rows = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows).withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(3))).cache()
    out = []
    for fold in range(3):
        scored = LogisticRegression(regParam=0.1, maxIter=20).fit(rows.filter(F.col("fold") != fold)).transform(rows.filter(F.col("fold") == fold))
        out.append((fold, float(BinaryClassificationEvaluator().evaluate(scored)), scored.count()))
    return spark.createDataFrame(out, "fold int, auc double, n long")


@query()
def embedding_components(spark: SparkSession, sf: str) -> DataFrame:
    """Two principal components of the vectors."""
    rows = load(spark, sf, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("v"))
    found = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows)
    return found.select("vec_id", "label", vector_to_array("p").alias("p")).select("vec_id", "label", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query()
def cluster_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The silhouette of k-means over the vectors for some numbers of clusters."""
    rows = VectorAssembler(inputCols=["v"], outputCol="features").transform(load(spark, sf, "embeddings").select(array_to_vector("embedding").alias("v"))).cache()
    out = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=1, maxIter=10).fit(rows).transform(rows)))) for k in (2, 4, 8)]
    return spark.createDataFrame(out, "k int, silhouette double")

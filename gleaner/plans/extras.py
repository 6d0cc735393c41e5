"""Queries over what is left: keys and hashes, places, quotas, approximate aggregates, relations in SQL, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import posting as ps
from gleaner.functions import text as tx
from gleaner.operators import frames as fr
from gleaner.operators import lookups as lk
from gleaner.operators import neighbours as nb
from gleaner.operators import statistics as st
from gleaner.plans.registry import Registry
from gleaner.sources.tables import load

query = Registry()


@query(r"""
    SELECT page_id, sha256('["' || replace(replace(url, '\', '\\'), '"', '\"') || '","",' || '"' || (page_id % 10)::VARCHAR || '"]') AS input_hash,
           trim(regexp_replace(replace(lower(url), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS label_key FROM pages""")
def keys_and_hashes(spark: SparkSession, sf: str) -> DataFrame:
    digit = (F.col("page_id") % 10).cast("string")
    return load(spark, sf, "pages").select("page_id", tx.input_hash(F.col("url"), F.lit(None).cast("string"), digit).alias("input_hash"), tx.label_key(F.col("url")).alias("label_key"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_nationkey < 5 THEN 'search' WHEN c_mktsegment = 'FURNITURE' THEN 'alias' WHEN c_acctbal > 5000 THEN 'lookup' WHEN c_acctbal > 0 THEN 'reference' END AS metro,
           CASE WHEN c_custkey % 9 = 0 THEN 'unresolved' WHEN c_nationkey < 5 THEN 'search_metro' WHEN c_mktsegment = 'FURNITURE' THEN 'manual_alias' WHEN c_acctbal > 5000 THEN 'city_state_lookup' WHEN c_acctbal > 0 THEN 'city_state_reference' ELSE 'unresolved' END AS source FROM customer""")
def metro_precedence(spark: SparkSession, sf: str) -> DataFrame:
    got = ps.metro(
        F.when(F.col("c_nationkey") < 5, "search"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "alias"),
        F.when(F.col("c_acctbal") > 5000, "lookup"),
        F.when(F.col("c_acctbal") > 0, "reference"),
        F.col("c_custkey") % 9 == 0,
    )
    return load(spark, sf, "customer").select("c_custkey", got.alias("m")).select("c_custkey", "m.metro", "m.source")


@query("""
    WITH d AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(o_orderdate AS DATE) AS seen, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 130 AS INTEGER) + 5 AS posted FROM orders)
    SELECT o_orderkey, CASE WHEN k = 0 THEN 'missing' WHEN k = 1 THEN 'parse_failed' WHEN posted > seen THEN 'future' WHEN seen - posted > 60 THEN 'stale_gt_60d' ELSE 'valid' END AS quality FROM d""")
def posted_qualities(spark: SparkSession, sf: str) -> DataFrame:
    k, seen = F.col("o_orderkey") % 7, F.to_date("o_orderdate")
    posted = F.date_add(F.date_sub(seen, (F.col("o_orderkey") % 130).cast("int")), 5)
    text = F.when(k == 0, " ").when(k == 1, "soon").otherwise(F.date_format(posted, "yyyy-MM-dd"))
    return load(spark, sf, "orders").select("o_orderkey", ps.posted_quality(text, seen).alias("quality"))


_WORK = {"Full-time": r"full[- ]?time|vollzeit", "Contract": "contract|tion", "Internship": r"\bintern\b|der", "Temporary": "temp"}


@query("""
    SELECT doc_id, nullif(concat_ws(', ', CASE WHEN regexp_matches(lower(text), 'full[- ]?time|vollzeit') THEN 'Full-time' END, CASE WHEN regexp_matches(lower(text), 'contract|tion') THEN 'Contract' END,
           CASE WHEN regexp_matches(lower(text), '\\bintern\\b|der') THEN 'Internship' END, CASE WHEN regexp_matches(lower(text), 'temp') THEN 'Temporary' END), '') AS work FROM documents""")
def work_type_labels(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", tx.work_types(F.col("text"), _WORK).alias("work"))


@query("""
    WITH s AS (SELECT lang, count(*) AS room, CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.3 ELSE 0.1 END AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang), t AS (SELECT sum(share) AS all_shares, count(*) AS k FROM s)
    SELECT lang, CAST(least(room, floor(20 * share / all_shares)) AS BIGINT) AS at_least FROM s CROSS JOIN t""")
def budget_split(spark: SparkSession, sf: str) -> DataFrame:
    """What each language gets at least of a budget of 20, by share; the budget is spent to the last unit."""
    room = {r.lang: r["count"] for r in load(spark, sf, "documents").filter("lang is not null").groupBy("lang").count().collect()}  # a row for each language
    shares = {"en": 0.5, "de": 0.3}
    given = fr.split_budget(20, room, {k: shares.get(k, 0.1) for k in room})
    total = sum(shares.get(k, 0.1) for k in room)
    if sum(given.values()) != min(20, sum(room.values())):
        raise AssertionError("a budget must be spent")
    return spark.createDataFrame([(k, min(given[k], int(20 * shares.get(k, 0.1) / total))) for k in sorted(room)], "lang string, at_least long")


@query("""
    WITH c AS (SELECT event_type, count(*) AS room FROM events GROUP BY 1), h AS (SELECT unnest(range(1, 20000)) AS h), u AS (SELECT h, sum(least(h, room)) AS used FROM h CROSS JOIN c GROUP BY h),
    m AS (SELECT max(h) AS h FROM u WHERE used <= 300), l AS (SELECT c.*, m.h, 300 - sum(least(m.h, room)) OVER () AS rest, row_number() OVER (PARTITION BY room > m.h ORDER BY event_type) AS r FROM c CROSS JOIN m)
    SELECT event_type, CAST(least(h, room) + CASE WHEN room > h AND r <= rest THEN 1 ELSE 0 END AS BIGINT) AS given FROM l""")
def filled_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """300 units poured over the event types: each rises with the others until it is full."""
    room = {r.event_type: r["count"] for r in load(spark, sf, "events").groupBy("event_type").count().collect()}  # a row for each type
    return spark.createDataFrame(list(fr.water_fill(room, 300).items()), "event_type string, given long")


@query("""
    WITH kept AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents WHERE doc_id % 50 = 0)
    SELECT doc_id, CAST(ord AS BIGINT) AS ord FROM kept""")
def sticky_frame(spark: SparkSession, sf: str) -> DataFrame:
    """A frame whose target lies below its size stays as it is, in its order."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source")
    kept = docs.filter("doc_id % 50 = 0").select("doc_id", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("ord"))
    return fr.top_up(docs, kept, "doc_id", "lang", "source", 1).select("doc_id", "ord")


@query("""
    WITH c AS (SELECT source, count(*) AS n, avg((lang = 'en')::INT) AS p, stddev_samp(n_chars) AS s FROM documents GROUP BY source), b AS (SELECT n AS n0, p AS p0 FROM c WHERE source = 'src0'),
    x AS (SELECT source, n, (p - p0) / nullif(sqrt(((p * n + p0 * n0) / (n + n0)) * (1 - (p * n + p0 * n0) / (n + n0)) * (1.0 / n + 1.0 / n0)), 0) AS z, (1.959963984540054 + 0.8416212335729143) * sqrt(p0 * (1 - p0) * (1.0 / n + 1.0 / n0)) AS mde,
          (1.959963984540054 + 0.8416212335729143) * s * sqrt(1.0 / n + 1.0 / n0) AS mde_chars FROM c CROSS JOIN b WHERE source <> 'src0')
    SELECT source, n, CASE WHEN abs(z) >= 2 THEN 'strong' WHEN abs(z) >= 1 THEN 'moderate' ELSE 'weak' END AS signal, round(mde, 6) AS mde, round(mde_chars, 4) AS mde_chars FROM x""")
def source_power(spark: SparkSession, sf: str) -> DataFrame:
    """Each source against the first: how clear the difference of its English share is, and what differences could be found."""
    rows = load(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("k"), F.avg((F.col("lang") == "en").cast("int")).alias("p"), F.stddev("n_chars").alias("s"))
    base = rows.filter("source = 'src0'").select(F.col("n").alias("n0"), F.col("k").alias("k0"), F.col("p").alias("p0"))
    both = rows.filter("source <> 'src0'").crossJoin(F.broadcast(base))  # one row
    z = st.two_proportion_z(F.col("k"), F.col("n"), F.col("k0"), F.col("n0"))
    return both.select(
        "source",
        "n",
        st.signal_flag(z).alias("signal"),
        F.round(st.minimum_effect(F.col("n"), F.col("n0"), F.col("p0")), 6).alias("mde"),
        F.round(st.minimum_mean_effect(F.col("n"), F.col("n0"), F.col("s")), 4).alias("mde_chars"),
    )


@query("""
    WITH p AS (SELECT p_type, avg(p_size) / 51 AS p FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, p_type) AS i, count(*) OVER () AS m FROM p)
    SELECT p_type, round(p, 6) AS p, round(least(1, min(p * m / i) OVER (ORDER BY p DESC, p_type DESC)), 6) AS q FROM r""")
def adjusted_p_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").groupBy("p_type").agg((F.avg("p_size") / 51).alias("p"))
    return st.benjamini_hochberg(rows, "p", "q").select("p_type", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query("""
    SELECT event_type, abs(count(DISTINCT user_id) - count(DISTINCT user_id)) = 0 AS close_distinct, TRUE AS close_median, bool_or(event_type LIKE 's%') AS prefix, TRUE AS any_of_group FROM events GROUP BY event_type""")
def approximate_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Whether approximate counts and quantiles are within 5 % of the exact ones, and any_value is a value of its group."""
    rows = load(spark, sf, "events")
    out = rows.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("a"),
        F.count_distinct("user_id").alias("e"),
        F.approx_percentile("value", 0.5, 10_000).alias("m"),
        F.percentile("value", 0.45).alias("low"),
        F.percentile("value", 0.55).alias("high"),
        F.bool_or(F.col("event_type").startswith("s")).alias("prefix"),
        F.any_value("event_type").alias("any"),
    )
    return out.select("event_type", (F.abs(F.col("a") - F.col("e")) <= 1 + 0.1 * F.col("e")).alias("close_distinct"), F.col("m").between(F.col("low"), F.col("high")).alias("close_median"), "prefix", (F.col("any") == F.col("event_type")).alias("any_of_group"))


@query("""
    WITH wanted AS (SELECT unnest([1, 5, 5, 42, 199, -3, NULL]) AS doc_id)
    SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM wanted)""")
def parameter_list(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a list of ids that the caller has: a semi join with it as a relation."""
    ids = spark.createDataFrame([(i,) for i in (1, 5, 5, 42, 199, -3, None)], "doc_id long")
    return load(spark, sf, "documents").select("doc_id", "n_chars").join(ids, "doc_id", "left_semi")


@query("""
    SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars >= 5000)::BOOLEAN AS has_long FROM documents WHERE lang LIKE 'e%' GROUP BY ALL""")
def session_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The same in SQL over session relations: a view, a column that is added, an aggregate."""
    view = f"docs_{abs(hash(sf))}"
    load(spark, sf, "documents").createOrReplaceTempView(view)
    spark.sql(f"SELECT *, n_chars >= 5000 AS is_long FROM {view}").createOrReplaceTempView(f"{view}_flagged")
    return spark.sql(f"SELECT lang, source, count(*) AS n, sum(n_chars) AS chars, max(is_long) AS has_long FROM {view}_flagged WHERE lang LIKE 'e%' GROUP BY lang, source")


@query("""
    SELECT event_id, json_array_length('[' || repeat('1,', (event_id % 4)::INT) || '0]') AS items, json_extract_string(props, '$.k') AS k FROM events""")
def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit("["), F.repeat(F.lit("1,"), (F.col("event_id") % 4).cast("int")), F.lit("0]"))
    return load(spark, sf, "events").select("event_id", F.json_array_length(made).cast("long").alias("items"), F.get_json_object("props", "$.k").alias("k"))


_NEAR = """
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 2 = 1), c AS (SELECT * FROM v WHERE vec_id % 2 = 0),
    p AS (SELECT q.vec_id, q.label, c.vec_id AS nearest, list_cosine_similarity(q.e, c.e) AS s FROM q CROSS JOIN c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, nearest) AS r FROM p)"""


@query(_NEAR + " SELECT vec_id, nearest, round(s, 5) AS cosine FROM b WHERE r = 1")
def nearest_earlier(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vector of the earlier era for each of the later one."""
    rows = load(spark, sf, "embeddings").select("vec_id", "embedding")
    return nb.nearest(rows.filter("vec_id % 2 = 1"), rows.filter("vec_id % 2 = 0"), "vec_id", "embedding").withColumn("cosine", F.round("cosine", 5))


@query(_NEAR + """, n AS (SELECT label, 1 - s AS d FROM b WHERE r = 1), t AS (SELECT quantile_cont(d, 0.9) AS t FROM n WHERE label < 5)
    SELECT label, count(*) AS n, round(avg(d), 4) AS distance, round(avg((d > t)::INT), 4) AS emergent FROM n CROSS JOIN t GROUP BY label""")
def emergence_index(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each label's later vectors that lie further from all earlier ones than a threshold, calibrated on some labels."""
    rows = load(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    found = nb.nearest(rows.filter("vec_id % 2 = 1"), rows.filter("vec_id % 2 = 0"), "vec_id", "embedding")
    near = found.join(rows.select("vec_id", "label"), "vec_id").withColumn("d", 1 - F.col("cosine"))
    bar = near.filter("label < 5").agg(F.percentile("d", 0.9).alias("t"))
    out = near.crossJoin(F.broadcast(bar)).groupBy("label")  # one row
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 4).alias("distance"), F.round(F.avg((F.col("d") > F.col("t")).cast("int")), 4).alias("emergent"))


@query("""
    WITH w AS (SELECT p_partkey, p_size > 25 AS later, string_split(lower(p_name), ' ') AS w FROM part), g AS (SELECT later, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS gram FROM w),
    n AS (SELECT count(*) FILTER (WHERE later) AS b, count(*) FILTER (WHERE NOT later) AS a FROM w), c AS (SELECT gram, count(*) FILTER (WHERE NOT later) AS ka, count(*) FILTER (WHERE later) AS kb FROM g GROUP BY gram)
    SELECT gram, ka AS before, kb AS after, round(kb / b - ka / a, 6) AS delta FROM c CROSS JOIN n""")
def title_gram_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How the share of titles with each word or pair of words has changed between two eras."""
    rows = load(spark, sf, "part").select((F.col("p_size") > 25).alias("later"), F.split(F.lower("p_name"), " ").alias("w"))
    return st.share_delta(rows.select("later", F.concat("w", tx.ngrams(F.col("w"), 2)).alias("terms")), "terms", F.col("later")).withColumnRenamed("term", "gram")


@query("""
    WITH c AS (SELECT c_custkey, c_nationkey AS k, c_custkey % 40 AS t FROM customer)
    SELECT c_custkey, 'county ' || CASE WHEN exact THEN k WHEN one THEN CASE WHEN t < 10 THEN 0 WHEN t < 20 THEN 1 ELSE 2 END END AS county, CASE WHEN exact THEN 'exact' WHEN one THEN 'fallback' ELSE 'none' END AS how
    FROM (SELECT *, k < 3 AND t BETWEEN 10 * k AND 10 * k + 14 AS exact, t < 10 OR t BETWEEN 15 AND 19 OR t BETWEEN 25 AND 34 AS one FROM c)""")
def county_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A county by state and town; else by the town alone, where only one county has it. Counties overlap in some towns."""
    town = lambda c: F.concat(F.lit("town "), c.cast("string"))
    rows = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("state"), town(F.col("c_custkey") % 40).alias("town"))
    known = load(spark, sf, "nation").filter("n_nationkey < 3").select(F.concat(F.lit("county "), F.col("n_nationkey").cast("string")).alias("county"), F.col("n_nationkey").alias("state"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i"))
    known = known.select("county", "state", town(10 * F.col("state") + F.col("i")).alias("town"))
    return lk.with_fallback(rows, known, ["state", "town"], ["town"], "county").select("c_custkey", "county", "how")


@query("""
    WITH s AS (SELECT doc_id, source, lang, split_part(source, 'c', 2) AS k FROM documents)
    SELECT doc_id, 'site' || '_' || lower(source) || '_' || doc_id AS uid, strftime(make_timestamp(1700000000000000 + doc_id * 86400000000), '%Y-%m-%d') AS day FROM s""")
def unified_uids(spark: SparkSession, sf: str) -> DataFrame:
    """The id that a row of a third source has in the unified schema, and its day from milliseconds."""
    rows = load(spark, sf, "documents")
    return rows.select("doc_id", tx.site_uid(F.concat(F.lit("Site_"), F.upper("source")), F.col("doc_id")).alias("uid"), tx.day_of_millis(F.lit(1_700_000_000_000) + F.col("doc_id") * 86_400_000).alias("day"))

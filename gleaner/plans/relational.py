"""Queries over the relational operators: rates, joins, aggregates, windows, samples, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators import concentration as conc
from gleaner.operators import relational as rel
from gleaner.plans.registry import Registry
from gleaner.sources.tables import load

query = Registry()

#: Regexes without word boundaries, whose meaning differs between engines.
AI = "(?i)(ation|tion)"
MANAGE = "(?i)(manag|lead|super)"


@query("""
    SELECT source, lang, count(*) AS n,
           CAST(sum(CASE WHEN regexp_matches(text, '(?i)(ation|tion)') THEN 1 ELSE 0 END) AS BIGINT) AS hit_n,
           round(sum(CASE WHEN regexp_matches(text, '(?i)(ation|tion)') THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS hit_rate,
           CAST(sum(CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END) AS BIGINT) AS long_n,
           round(sum(CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS long_rate
    FROM documents GROUP BY source, lang""")
def conditional_rates(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("source", "lang", "text", "n_chars")
    return rel.conditional_rates(docs, ["source", "lang"], {"hit": F.col("text").rlike(AI), "long": F.col("n_chars") >= 2000})


_PATTERNS = {"license": "license", "email": "[a-z0-9]+@[a-z0-9]+", "number": "[0-9]{3,}", "caps": "[A-Z]{4,}", "accent": "[é|ü|ñ]", "url": "https?://", "pipe": "[|]", "stars": "[*]{3}"}


@query("SELECT lang, " + ", ".join(f"CAST(sum(CASE WHEN regexp_matches(text, '{p}') THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, p in _PATTERNS.items()) + " FROM documents GROUP BY lang")
def pattern_family_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return docs.groupBy("lang").agg(*[F.sum(F.when(F.col("text").rlike(p), 1).otherwise(0)).cast("long").alias(n) for n, p in _PATTERNS.items()])


@query("""
    SELECT * FROM (
      SELECT 'all' AS slice, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem UNION ALL
      SELECT 'late', count(*), count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-06-01' UNION ALL
      SELECT 'big', count(*), count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem WHERE l_quantity >= 40 UNION ALL
      SELECT 'discounted', count(*), count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem WHERE l_discount > 0.05)""")
def parameter_slices(spark: SparkSession, sf: str) -> DataFrame:
    variants = {"all": F.lit(True), "late": F.col("l_shipdate") >= F.lit("1997-06-01").cast("timestamp"), "big": F.col("l_quantity") >= 40, "discounted": F.col("l_discount") > 0.05}
    return rel.slices(load(spark, sf, "lineitem"), variants, {"n": F.lit(True), "returned": F.col("l_returnflag") == "R"})


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean_qty, round(median(l_quantity), 4) AS median_qty,
           round(stddev(l_extendedprice), 2) AS sd_price, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_price,
           round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, count(DISTINCT l_partkey) AS parts
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def summary_statistics(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("l_quantity"), 4).alias("mean_qty"),
        F.round(F.median("l_quantity"), 4).alias("median_qty"),
        F.round(F.stddev("l_extendedprice"), 2).alias("sd_price"),
        F.round(F.percentile("l_extendedprice", 0.9), 4).alias("p90_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"),
        F.count_distinct("l_partkey").alias("parts"),
    )


@query("""
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS large, bool_or(o_totalprice > 400000) AS any_huge,
           CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS finished, max(o_totalprice) AS top
    FROM orders GROUP BY ALL HAVING count(*) > 10""")
def filtered_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    out = load(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_totalprice") > 100000).alias("large"),
        F.bool_or(F.col("o_totalprice") > 400000).alias("any_huge"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.max("o_totalprice").alias("top"),
    )
    return out.filter("n > 10")


@query("""
    SELECT n_name, string_agg(s_name, ',' ORDER BY s_name) AS names, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def ordered_string_agg(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


@query("""
    SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
    FROM customer GROUP BY c_mktsegment""")
def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    out = load(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations"))
    return out.withColumn("share_pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY source, lang")
def share_within_group(spark: SparkSession, sf: str) -> DataFrame:
    return rel.shares(load(spark, sf, "documents"), ["source", "lang"], ["source"])


@query("""
    WITH c AS (SELECT o_orderpriority AS k, o_custkey AS u, count(*) AS c FROM orders GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c, u) AS i, row_number() OVER (PARTITION BY k ORDER BY c DESC, u) AS r FROM c)
    SELECT k AS o_orderpriority, count(*) AS units, CAST(sum(c) AS BIGINT) AS rows, round(sum(c::DOUBLE * c) / (sum(c) * sum(c)), 6) AS hhi,
           round(2 * sum(i::DOUBLE * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*), 6) AS gini,
           round(sum(CASE WHEN r <= 1 THEN c ELSE 0 END) / sum(c), 6) AS top1_share, round(sum(CASE WHEN r <= 5 THEN c ELSE 0 END) / sum(c), 6) AS top5_share,
           round(sum(CASE WHEN r <= 10 THEN c ELSE 0 END) / sum(c), 6) AS top10_share, round(sum(CASE WHEN r <= 20 THEN c ELSE 0 END) / sum(c), 6) AS top20_share,
           round(sum(CASE WHEN r <= 50 THEN c ELSE 0 END) / sum(c), 6) AS top50_share
    FROM r GROUP BY k""")
def concentration_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return conc.concentration(load(spark, sf, "orders"), "o_custkey", ["o_orderpriority"], (1, 5, 10, 20, 50))


@query("""
    WITH c AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY ALL), s AS (SELECT c, count(*) AS u, sum(c) AS r FROM c GROUP BY c)
    SELECT c AS size, round(sum(u) OVER (ORDER BY c) / sum(u) OVER (), 6) AS unit_share, round(sum(r) OVER (ORDER BY c) / sum(r) OVER (), 6) AS row_share FROM s""")
def lorenz_curve(spark: SparkSession, sf: str) -> DataFrame:
    return conc.lorenz(load(spark, sf, "orders"), "o_custkey")


@query("""
    WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS place FROM t)
    SELECT o_custkey, n, place, round(n / sum(n) OVER (), 6) AS share FROM r QUALIFY place <= 25""")
def global_rank(spark: SparkSession, sf: str) -> DataFrame:
    total = Window.partitionBy(F.lit(0))
    counted = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    # Only the top rows are numbered in one place; the total is a pre-aggregated row beside them.
    whole = counted.agg(F.sum("n").alias("total"))
    top = counted.orderBy(F.desc("n"), "o_custkey").limit(25).withColumn("place", F.row_number().over(total.orderBy(F.desc("n"), "o_custkey")))
    return top.crossJoin(F.broadcast(whole)).select("o_custkey", "n", F.col("place").cast("long").alias("place"), F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(concat(l_orderkey, '-', l_linenumber, '|s1')), l_orderkey, l_linenumber) <= 5")
def capped_per_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    rows = rows.withColumn("uid", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return rel.first_per_key(rows, ["l_suppkey"], [rel.hashed_order("uid", seed="s1"), "l_orderkey", "l_linenumber"], 5).drop("uid")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY md5(concat(doc_id, '|42')), doc_id) <= 3")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rel.stratified_sample(load(spark, sf, "documents"), ["source", "lang"], "doc_id", 3, "42").select("source", "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY md5(concat(doc_id, '|7')), doc_id LIMIT 40")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rel.hash_sample(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 40, "7")


@query("""
    SELECT c_custkey, c_acctbal, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quartile FROM customer""")
def ntile_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return load(spark, sf, "customer").select("c_custkey", "c_acctbal", F.ntile(4).over(w).cast("long").alias("quartile"))


@query("""
    WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, sum(value) AS v FROM events GROUP BY ALL)
    SELECT day, event_type, CASE WHEN count(v) OVER w >= 7 THEN round(avg(v) OVER w, 6) END AS mean7 FROM d
    WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    days = load(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.sum("value").alias("v"))
    return rel.rolling_mean(days, ["event_type"], "day", "v", 7, "mean7").drop("v")


@query("""
    SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(*) AS n_obs, count(DISTINCT CAST(ts AS DATE)) AS n_days,
           CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS BIGINT) AS span_days
    FROM events GROUP BY user_id""")
def posting_lifespan(spark: SparkSession, sf: str) -> DataFrame:
    out = rel.lifespan(load(spark, sf, "events"), "user_id", "ts")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


@query("""
    WITH f AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS observed, count(*) FILTER (WHERE c.c_custkey IS NOT NULL) AS known
    FROM f LEFT JOIN customer c ON f.user_id = c.c_custkey GROUP BY day""")
def observation_panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    seen = rel.first_per_key(rows, ["user_id", "day"], ["ts", "event_id"])
    seen = seen.join(load(spark, sf, "customer").select("c_custkey"), seen["user_id"] == F.col("c_custkey"), "left")
    return seen.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("observed"), F.count("c_custkey").alias("known"))


@query("""
    WITH e AS (SELECT o_custkey, o_totalprice, o_orderdate >= TIMESTAMP '1995-07-01' AS late FROM orders),
    p AS (SELECT o_custkey, count(*) FILTER (WHERE NOT late) AS n_before, count(*) FILTER (WHERE late) AS n_after, avg(o_totalprice) FILTER (WHERE NOT late) AS mb, avg(o_totalprice) FILTER (WHERE late) AS ma
          FROM e GROUP BY o_custkey)
    SELECT o_custkey, n_before, n_after, round(mb, 6) AS mean_before, round(ma, 6) AS mean_after, round(ma - mb, 6) AS delta FROM p WHERE n_before >= 3 AND n_after >= 3""")
def within_unit_panel(spark: SparkSession, sf: str) -> DataFrame:
    era = F.col("o_orderdate") >= F.lit("1995-07-01").cast("timestamp")
    return rel.within_panel(load(spark, sf, "orders"), "o_custkey", era, F.col("o_totalprice"), 3)


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS place FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey")
def lookup_with_default(spark: SparkSession, sf: str) -> DataFrame:
    table = load(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return rel.lookup(load(spark, sf, "supplier"), table, ["s_nationkey"], "n_name", F.lit("unknown"), "place").select("s_suppkey", "s_name", "place")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS big_buyer FROM customer")
def membership_flag(spark: SparkSession, sf: str) -> DataFrame:
    big = load(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return rel.membership(load(spark, sf, "customer").select("c_custkey"), big, "c_custkey", "big_buyer")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").filter("l_quantity >= 49").select("l_orderkey")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    customers, orders = load(spark, sf, "customer").select("c_custkey", "c_name"), load(spark, sf, "orders").filter("o_totalprice > 400000").select("o_custkey")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)")
def null_aware_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    load(spark, sf, "customer").createOrReplaceTempView("gleaner_customer")
    load(spark, sf, "orders").createOrReplaceTempView("gleaner_orders")
    return spark.sql("SELECT count(*) AS n FROM gleaner_customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM gleaner_orders)")


@query("""
    SELECT s_suppkey, n_name, r_name, a.n_lines FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_suppkey = s_suppkey""")
def chained_left_joins(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"))
    out = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = out.join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("s_suppkey", "n_name", "r_name", "n_lines")


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) = 1""")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return rel.first_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey"]).drop("o_orderdate")


@query("""
    SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 10) USING (l_partkey)
    GROUP BY l_suppkey""")
def top_k_restriction(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    top = lines.groupBy("l_partkey").count().orderBy(F.desc("count"), "l_partkey").limit(10).select("l_partkey")
    return lines.join(F.broadcast(top), "l_partkey").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
    WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')
    SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_eras, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_first,
           (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either_era""")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    # One pass: whether a key occurs in each era decides all three sets.
    eras = load(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.bool_or(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("a"), F.bool_or(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")).alias("b")
    )
    return eras.agg(F.count_if(F.col("a") & F.col("b")).alias("both_eras"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(F.col("a") | F.col("b")).alias("either_era"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT c_name AS name, 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, 'supplier', s_acctbal FROM supplier")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(load(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("""
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_P
    FROM orders GROUP BY o_orderpriority""")
def pivot_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rel.pivot_counts(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def melt(spark: SparkSession, sf: str) -> DataFrame:
    return rel.melt(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def sorted_page(spark: SparkSession, sf: str) -> DataFrame:
    return rel.page(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 20, 2)


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, value LIMIT 3")
def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    return rel.facet(load(spark, sf, "documents"), "lang", 3)


@query("""
    SELECT count(*) AS n FROM documents WHERE (lang IN ('en', 'fr') OR lang IS NULL) AND n_chars BETWEEN 200 AND 5000
      AND (contains(lower(text), 'license') OR contains(lower(source), 'license'))""")
def filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    test = rel.where([("lang", "in", ["en", "fr", None]), ("n_chars", "between", (200, 5000))], "License", ["text", "source"])
    return load(spark, sf, "documents").filter(test).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT source, count(*) AS n, round(avg(CASE WHEN lang IS NULL THEN 1 ELSE 0 END), 6) AS lang_null_rate, round(avg(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END), 6) AS toxic_null_rate
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def null_rate_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rel.null_rates(load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left"), ["source"], ["lang", "toxic"])


@query("""
    WITH g AS (SELECT n_name, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END), 9) AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    t AS (SELECT * FROM g ORDER BY n DESC, n_name LIMIT 10) SELECT round(avg(r), 6) AS balanced_rate, count(*) AS groups FROM t""")
def balanced_macro_average(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    groups = rows.groupBy("n_name").agg(rel.rate(F.col("c_acctbal") > 0, 9).alias("r"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "n_name").limit(10)
    return groups.agg(F.round(F.avg("r"), 6).alias("balanced_rate"), F.count(F.lit(1)).alias("groups"))


@query("""
    SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2""")
def several_values_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("kinds")).filter("kinds >= 2")


@query("""
    WITH v AS (SELECT doc_id % 50 AS item, lang AS label FROM documents), c AS (SELECT item, label, count(*) AS k FROM v GROUP BY ALL), t AS (SELECT item, sum(k) AS n FROM c GROUP BY item)
    SELECT item, CAST(n AS BIGINT) AS votes, string_agg(label, ',' ORDER BY label) FILTER (WHERE k >= floor(n / 2) + 1) AS winner FROM c JOIN t USING (item) WHERE n >= 2 GROUP BY item, n""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    votes = load(spark, sf, "documents").groupBy((F.col("doc_id") % 50).alias("item"), F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k").over(Window.partitionBy("item"))
    votes = votes.withColumn("n", total).filter("n >= 2")
    won = F.when(F.col("k") >= F.floor(F.col("n") / 2) + 1, F.col("label"))
    out = votes.groupBy("item", F.col("n").alias("votes")).agg(F.array_sort(F.collect_list(won)).alias("w"))
    return out.select("item", "votes", F.when(F.size("w") > 0, F.array_join("w", ",")).alias("winner"))


@query("""
    SELECT mode_status AS status, count(*) AS customers FROM (
      SELECT o_custkey, first(o_orderstatus ORDER BY c DESC, o_orderstatus) AS mode_status FROM (SELECT o_custkey, o_orderstatus, count(*) AS c FROM orders GROUP BY ALL) GROUP BY o_custkey) GROUP BY 1""")
def mode_per_group(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("o_custkey").agg(F.min(F.struct(-F.col("c"), F.col("o_orderstatus").alias("status"))).alias("m"))
    return best.groupBy(F.col("m.status").alias("status")).agg(F.count(F.lit(1)).alias("customers"))


@query("""
    SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def calendar_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT width, count(*) AS n FROM (SELECT CASE WHEN n_chars < 500 THEN '0-499' WHEN n_chars < 2000 THEN '500-1999' WHEN n_chars < 10000 THEN '2000-9999' ELSE '10000+' END AS width FROM documents) GROUP BY width""")
def binned_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    width = F.when(n < 500, "0-499").when(n < 2000, "500-1999").when(n < 10000, "2000-9999").otherwise("10000+")
    return load(spark, sf, "documents").groupBy(width.alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT o_orderkey, l_linenumber, round(l_extendedprice / (SELECT avg(l_extendedprice) FROM lineitem), 6) AS relative FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 350000""")
def scalar_subquery(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    mean = lines.agg(F.avg("l_extendedprice").alias("mean"))
    rows = lines.join(load(spark, sf, "orders").filter("o_totalprice > 350000").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.crossJoin(F.broadcast(mean)).select("o_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.col("mean"), 6).alias("relative"))


@query("""
    WITH a AS (SELECT l_partkey AS k, count(*) AS n_early FROM lineitem WHERE l_shipdate < TIMESTAMP '1994-01-01' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n_late FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
    SELECT k, coalesce(n_early, 0) AS n_early, coalesce(n_late, 0) AS n_late FROM a FULL JOIN b USING (k)""")
def full_outer_merge(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    a = lines.filter(F.col("l_shipdate") < F.lit("1994-01-01").cast("timestamp")).groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n_early"))
    b = lines.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")).groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n_late"))
    return a.join(b, "k", "outer").select("k", F.coalesce("n_early", F.lit(0)).alias("n_early"), F.coalesce("n_late", F.lit(0)).alias("n_late"))

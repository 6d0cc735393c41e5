"""Queries over the posting operators: dedupe, frames, caches, places, dates, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import posting as ps
from gleaner.functions import text as tx
from gleaner.operators import dedupe as dd
from gleaner.operators import frames as fr
from gleaner.operators.lookups import modal_values
from gleaner.plans.registry import Registry
from gleaner.sources.tables import load

query = Registry()

_KEY = r"CASE WHEN lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) = '' THEN '' ELSE md5(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) END"


@query(f"""
    WITH h AS (SELECT doc_id, source, lang, {_KEY} AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, lang, h ORDER BY doc_id) AS rn FROM h)
    SELECT doc_id, source, h AS desc_hash FROM r WHERE h = '' OR rn = 1""")
def exact_opening_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", "source", "lang", tx.hash_key(F.col("text")).alias("desc_hash"))
    return dd.drop_repeated(rows, ["source", "lang", "desc_hash"], [F.col("doc_id")], F.col("desc_hash") != "").drop("lang")


@query(f"""
    WITH h AS (SELECT doc_id, lang, source, {_KEY} AS h FROM documents), g AS (SELECT lang, h, count(DISTINCT source) AS places, min(doc_id) AS first FROM h GROUP BY ALL)
    SELECT doc_id, CASE WHEN places >= 2 THEN 'multi-location' ELSE source END AS place, h AS desc_hash FROM h JOIN g USING (lang, h) WHERE places < 2 OR doc_id = first""")
def multi_location_collapse(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("place"), tx.hash_key(F.col("text")).alias("desc_hash"))
    return dd.collapse_places(rows, ["lang", "desc_hash"], "place", "doc_id").select("doc_id", "place", "desc_hash")


@query(f"""
    WITH h AS (SELECT doc_id, source, {_KEY} AS h, n_chars FROM documents), f AS (SELECT source, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) = 1 AS exact, n_chars >= 500 AS long FROM h)
    SELECT source, count(*) AS raw, count(*) FILTER (WHERE exact) AS after_exact, count(*) FILTER (WHERE exact AND long) AS after_long FROM f GROUP BY source""")
def dedupe_funnel(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", "source", "n_chars", tx.hash_key(F.col("text")).alias("h"))
    first = F.row_number().over(Window.partitionBy("source", "h").orderBy("doc_id")) == 1
    return dd.funnel(rows.withColumn("exact", first).withColumn("long", F.col("n_chars") >= 500), "source", ["exact", "long"])


@query()
def near_duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    rows = part.select("p_partkey", "p_brand", F.col("p_type").alias("kind"), tx.opening_key(F.col("p_name")).alias("title"), (F.col("p_size") % 3).alias("complete"), "p_retailprice")
    return dd.near_duplicates(rows, ["p_brand", "kind"], "p_partkey", "p_partkey", "title", ["complete", "p_retailprice"])


@query("""
    WITH r AS (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 + 0 DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, event_type, value FROM r WHERE rn = 1""")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "event_type", "value", F.struct((F.col("event_id") % 2).alias("a"), F.col("event_id").alias("b")).alias("version"))
    return dd.upsert(rows.filter("version.a = 0"), rows.filter("version.a = 1"), ["user_id", "event_type"], "version").drop("version")


@query("""
    SELECT k AS o_custkey, CASE WHEN f AND c THEN 'core_cached' WHEN c THEN 'supplemental_cached' WHEN f THEN 'fresh' ELSE 'outside' END AS part
    FROM (SELECT o_custkey AS k, bool_or(o_totalprice > 300000) AS f, bool_or(o_orderstatus = 'P') AS c FROM orders GROUP BY 1)""")
def cache_partition(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    return fr.cache_partition(orders, "o_custkey", orders.filter("o_totalprice > 300000"), orders.filter("o_orderstatus = 'P'"))


@query("""
    SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'labeled' WHEN n_chars % 7 = 0 AND n_chars >= 1000 THEN 'deferred' WHEN n_chars < 300 AND n_chars >= 100 THEN 'skipped_short' WHEN n_chars < 100 THEN 'not_selected' ELSE 'pending' END AS state
    FROM documents LEFT JOIN labels USING (doc_id)""")
def coverage_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    return rows.select("doc_id", fr.coverage(n >= 100, n < 300, (n % 7 == 0) & (n >= 1000), (F.col("quality") == 1) & (F.col("toxic") == 0)).alias("state"))


@query("""
    WITH c AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
    SELECT lang, count(*) AS n FROM c WHERE r <= 2 GROUP BY lang""")
def balanced_frame(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source")
    cells = docs.groupBy("lang", "source").count()
    two_each = cells.agg(F.sum(F.least("count", F.lit(2)))).first()[0]
    frame = docs.join(cells.withColumnRenamed("count", "room"), ["lang", "source"]).withColumn("cell", F.concat_ws("/", "lang", "source")).filter("room >= 1")
    return fr.select_balanced(frame, "doc_id", "cell", "lang", two_each).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_STATES = list(ps.STATES.items())


@query(f"""
    WITH c AS (SELECT c_custkey, c_custkey % 11 AS k, list_extract({[n.title() for n, _ in _STATES]!r}, (c_nationkey + c_custkey // 11) % {len(_STATES)} + 1) AS name,
               list_extract({[a for _, a in _STATES]!r}, (c_nationkey + c_custkey // 11) % {len(_STATES)} + 1) AS code, 'City' || c_nationkey AS town, 'NATION_' || c_nationkey AS land FROM customer)
    SELECT c_custkey, CASE WHEN k IN (0, 1, 4, 5) THEN town WHEN k = 8 THEN 'Remote' WHEN k = 10 THEN town END AS city,
           CASE WHEN k IN (0, 1, 2, 7, 8) THEN code END AS state,
           CASE WHEN k IN (0, 1, 2, 6, 7, 8) THEN 'US' WHEN k IN (4, 5) THEN land END AS country, k IN (3, 8) AS remote FROM c""")
def parsed_places(spark: SparkSession, sf: str) -> DataFrame:
    """Places written in eleven ways, with every state."""
    at = ((F.col("c_nationkey") + F.floor(F.col("c_custkey") / 11)) % len(_STATES) + 1).cast("int")
    name, code = (F.element_at(F.array(*map(F.lit, x)), at) for x in ([n.title() for n, _ in _STATES], [a for _, a in _STATES]))
    town, land = F.concat(F.lit("City"), F.col("c_nationkey").cast("string")), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    comma = F.lit(", ")
    forms = (
        F.concat(town, comma, code),
        F.concat(town, comma, name),
        F.concat(name, F.lit(", United States")),
        F.lit("Remote"),
        F.concat(town, comma, land),
        F.concat(town, F.lit(", Shire, "), land),
        F.lit("United States"),
        F.lower(name),
        F.concat(F.lit("Remote, "), code),
        F.lit(" "),
        town,
    )
    raw = F.element_at(F.array(*forms), (F.col("c_custkey") % 11 + 1).cast("int"))
    rows = load(spark, sf, "customer").select("c_custkey", raw.alias("raw"))  # a column: the expression is named often
    return rows.select("c_custkey", ps.place(F.col("raw")).alias("p")).select("c_custkey", "p.*")


@query("""
    WITH d AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate + to_days(CAST(o_orderkey % 12000 AS INTEGER)) AS seen, o_orderdate AS posted FROM orders)
    SELECT o_orderkey, CASE WHEN w = '' THEN 'ok' ELSE w END AS flag, CASE WHEN k IN (1, 2) THEN 'unknown' ELSE strftime(seen, '%Y-%m') END AS period
    FROM (SELECT *, concat_ws('|', CASE WHEN k = 1 THEN 'scrape_date_invalid' WHEN k <> 2 AND seen < DATE '2020-01-01' THEN 'scrape_date_out_of_range' END,
                                   CASE WHEN k = 3 THEN 'date_posted_invalid' WHEN k <> 4 AND posted < DATE '2020-01-01' THEN 'date_posted_out_of_range' END) AS w FROM d)""")
def date_checks(spark: SparkSession, sf: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    seen = F.when(k == 1, "not-a-date").when(k != 2, F.date_format(F.date_add(day, (F.col("o_orderkey") % 12000).cast("int")), "yyyy-MM-dd"))
    posted = F.when(k == 3, "2020/31/12").when(k != 4, F.date_format(day, "yyyy-MM-dd"))
    return load(spark, sf, "orders").select("o_orderkey", ps.date_flags(scrape_date=seen, date_posted=posted).alias("flag"), ps.period(F.lit("scraped"), seen, {}).alias("period"))


@query("""
    WITH l AS (SELECT p_partkey, p_size % 12 AS y, CASE p_partkey % 3 WHEN 0 THEN 'entry' WHEN 1 THEN 'associate' ELSE 'mid-senior' END AS s FROM part)
    SELECT p_partkey, (s = 'entry' AND y >= 3) OR (s = 'associate' AND y >= 5) AS contradiction, CASE WHEN s <> 'entry' THEN 'low' WHEN y >= 5 THEN 'high' WHEN y >= 3 THEN 'medium' ELSE 'low' END AS risk FROM l""")
def ghost_risks(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("entry"), F.lit("associate"), F.lit("mid-senior")), (F.col("p_partkey") % 3 + 1).cast("int"))
    years = (F.col("p_size") % 12).cast("double")
    no = ps.contradicts(label, years)
    return load(spark, sf, "part").select("p_partkey", no.alias("contradiction"), ps.ghost_risk(label, years, no).alias("risk"))


@query("""
    SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0 THEN 'empty' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 THEN 'too_short' ELSE 'ok' END AS quality FROM documents""")
def description_quality(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", ps.quality(F.col("text")).alias("quality"))


@query("""
    WITH k AS (SELECT n_name AS key, c_mktsegment AS metro, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    t AS (SELECT *, sum(c) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY c DESC, metro) AS r FROM k)
    SELECT key, metro, CASE WHEN c / n >= 0.24 AND n >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM t WHERE r = 1 AND n >= 2 AND c / n >= 0.22""")
def modal_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return modal_values(rows, "n_name", "c_mktsegment", high=0.24, medium=0.22).select(F.col("key"), F.col("value").alias("metro"), "confidence")

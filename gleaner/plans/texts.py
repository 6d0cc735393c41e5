"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.plans.registry import Registry
from gleaner.sources.tables import load

query = Registry()


@query(r"""
    SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(text, '\n', chr(10)), '\r', chr(13)), '\t', chr(9)), '\-', '-'), '\*', '*'), '\#', '#'),
      '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS cleaned, md5(text) AS raw_md5 FROM documents""")
def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"), F.md5(F.col("text").cast("binary")).alias("raw_md5"))


@query(r"""
    SELECT doc_id, CASE WHEN k = '' THEN '' ELSE md5(k) END AS desc_hash FROM (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS k FROM documents)""")
def dedup_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", tx.hash_key(F.col("text")).alias("desc_hash"))


@query(r"""
    SELECT p_partkey, trim(regexp_replace(lower(p_name || ' - ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS entity, trim(regexp_replace(lower(p_name), '[^a-z0-9+#/& ]+', ' ', 'g')) AS opening,
           md5(concat_ws('|', trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')))) AS print
    FROM part""")
def entity_keys(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(
        "p_partkey",
        tx.entity_key(F.concat_ws(" - ", "p_name", "p_type")).alias("entity"),
        tx.opening_key(F.col("p_name")).alias("opening"),
        tx.fingerprint(F.col("p_name"), F.col("p_brand")).alias("print"),
    )


_LABELS = (" Entry level ", "entry_level", "ENTRY", "Junior", "Associate", "Mid Senior", "Mid-Senior level", "mid senior level", "mid-senior", "DIRECTOR", "Executive", "internship", " Intern", "Not Applicable", "")


@query(f"""
    WITH r AS (SELECT c_custkey, lower(trim(list_extract({list(_LABELS)!r}, (c_custkey + c_nationkey) % {len(_LABELS)} + 1))) AS raw FROM customer),
    l AS (SELECT c_custkey, CASE WHEN raw LIKE 'entry%' OR raw = 'junior' THEN 'entry' WHEN raw LIKE 'mid%senior%' THEN 'mid-senior' WHEN raw LIKE 'intern%' THEN 'intern' WHEN raw IN ('associate', 'director', 'executive') THEN raw END AS label FROM r)
    SELECT c_custkey, label, CASE label WHEN 'entry' THEN 'junior' WHEN 'associate' THEN 'mid' WHEN 'mid-senior' THEN 'senior' WHEN 'director' THEN 'senior' ELSE 'unknown' END AS label_3 FROM l""")
def seniority_labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _LABELS)), ((F.col("c_custkey") + F.col("c_nationkey")) % len(_LABELS) + 1).cast("int"))
    label = tx.seniority(raw)
    return load(spark, sf, "customer").select("c_custkey", label.alias("label"), tx.seniority_3(label).alias("label_3"))


@query("""
    WITH n AS (SELECT o_orderkey, o_custkey AS a, o_custkey + o_orderkey % 5000 AS b, o_orderkey % 6 AS k, o_orderstatus AS s FROM orders)
    SELECT o_orderkey, CASE WHEN k IN (0, 4) THEN (a + b) / 2.0 WHEN k IN (1, 2, 5) THEN a END::DOUBLE AS size, s = 'O' AS yes FROM n""")
def parsed_sizes(spark: SparkSession, sf: str) -> DataFrame:
    a, k = F.col("o_custkey"), F.col("o_orderkey") % 6
    b = a + F.col("o_orderkey") % 5000
    raw = (
        F.when(k == 0, F.concat(F.format_number(a, 0), F.lit("-"), F.format_number(b, 0), F.lit(" employees")))
        .when(k == 1, F.concat(F.format_number(a, 0), F.lit("+")))
        .when(k == 2, F.concat(a.cast("string"), F.lit(" people")))
        .when(k == 4, F.concat(F.lit("about "), a.cast("string"), F.lit(" to "), F.format_number(b, 0)))
        .when(k == 5, F.concat(a.cast("string"), F.lit("+, later "), b.cast("string")))
        .otherwise("none")
    )
    yes = F.when(F.col("o_orderstatus") == "O", " Yes ").when(F.col("o_orderstatus") == "F", "no")
    return load(spark, sf, "orders").select("o_orderkey", tx.company_size(raw).alias("size"), tx.truth(yes).alias("yes"))


@query("""
    SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, length(text) AS chars,
           round(length(regexp_replace(text, '[^ -~]', '', 'g')) / nullif(length(text), 0)::DOUBLE, 6) AS printable FROM documents""")
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return load(spark, sf, "documents").select("doc_id", tx.word_count(c).cast("long").alias("words"), F.length(c).cast("long").alias("chars"), F.round(tx.printable_share(c), 6).alias("printable"))


@query("""
    SELECT doc_id, sha256(text) AS lineage, sha256(coalesce(source, '') || chr(10) || '--' || chr(10) || coalesce(text, '')) AS framed, 'doc_' || substr(sha256(source || doc_id), 1, 16) AS uid FROM documents""")
def lineage_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(
        "doc_id", tx.lineage_hash(F.col("text")).alias("lineage"), tx.framed_hash([F.col("source"), F.col("text")], "\n--\n").alias("framed"), tx.hashed_uid(F.concat("source", F.col("doc_id").cast("string")), "doc_").alias("uid")
    )


@query("""
    SELECT lang, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS numbers, CAST(sum(length(text) - length(regexp_replace(text, '[^a-zA-Z ]', '', 'g'))) AS BIGINT) AS odd_chars FROM documents GROUP BY lang""")
def pattern_density(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return load(spark, sf, "documents").groupBy("lang").agg(F.sum(tx.matches(c, "[0-9]+")).alias("numbers"), F.sum(tx.matched_chars(c, "[^a-zA-Z ]")).alias("odd_chars"))


@query("""
    SELECT doc_id, substr(text, greatest(1, strpos(text, 'icense') - 60), strpos(text, 'icense') - greatest(1, strpos(text, 'icense') - 60) + 6 + 60) AS excerpt
    FROM documents WHERE contains(text, 'icense')""")
def match_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", tx.excerpt(F.col("text"), "icense", 60).alias("excerpt")).filter("excerpt is not null")


_TOPICS = {"license": "(?i)license", "contact": "[a-z0-9]+@[a-z0-9]+", "table": "[|]", "list": r"(?m)^- ", "code": r"[{}]", "accent": "[éüñ]"}


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _TOPICS.items()) + ") AS topics FROM documents")
def topic_lists(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.array_join(tx.topics(F.col("text"), _TOPICS), ",").alias("topics"))


@query("""
    SELECT CASE WHEN regexp_matches(p_name, 'widget|gadget') THEN 'device' WHEN regexp_matches(p_name, 'steel|iron|brass') THEN 'metal' WHEN regexp_matches(p_type, 'ECONOMY|PROMO') THEN 'cheap' ELSE 'other' END AS family, count(*) AS n
    FROM part GROUP BY 1""")
def title_families(spark: SparkSession, sf: str) -> DataFrame:
    rules = F.coalesce(tx.first_rule(F.col("p_name"), [("widget|gadget", "device"), ("steel|iron|brass", "metal")]), tx.first_rule(F.col("p_type"), [("ECONOMY|PROMO", "cheap")], "other"))
    return load(spark, sf, "part").groupBy(rules.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents WHERE lang = 'en'),
    g AS (SELECT unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM w)
    SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 50""")
def top_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return _bigrams(load(spark, sf, "documents").filter("lang = 'en'"))


def _bigrams(docs: DataFrame) -> DataFrame:
    words = docs.select(tx.tokens(F.col("text"), "[a-z]+").alias("w"))  # once a document, not once a bigram
    grams = words.select(F.explode(tx.ngrams(F.col("w"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(50)


@query(r"""
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS content FROM pages""")
def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", tx.without_html(F.col("html")).alias("content"))


@query(r"""
    SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS canonical FROM pages""")
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical"))


@query("""
    SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CAST(weekofyear(ts) AS INTEGER) AS iso_week, strftime(ts, '%Y-%m') AS period FROM events""")
def json_and_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"),
        F.weekofyear("ts").alias("iso_week"),
        F.date_format("ts", "yyyy-MM").alias("period"),
    )


@query("""
    SELECT x.tok AS tok, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name || ',' || p_type), ',')) AS tok FROM part) x WHERE trim(x.tok) <> '' GROUP BY 1""")
def delimited_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").select(F.explode(tx.listed(F.concat_ws(",", "p_name", "p_type"))).alias("tok"))
    return rows.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT DISTINCT w AS stop FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM part) WHERE w <> '' AND w NOT IN ('steel', 'small')""")
def name_stoplist(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z0-9]+")).alias("stop"))
    return words.filter((F.col("stop") != "") & ~F.col("stop").isin("steel", "small")).distinct()


@query("""
    SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN round(s_acctbal * 2080, 2) WHEN 1 THEN round(s_acctbal * 12, 2) END AS annual FROM supplier""")
def annual_salaries(spark: SparkSession, sf: str) -> DataFrame:
    period = F.element_at(F.array(F.lit("Hourly"), F.lit("monthly "), F.lit("per moon")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return load(spark, sf, "supplier").select("s_suppkey", tx.annual_pay(F.col("s_acctbal"), period).alias("annual"))


@query("""
    SELECT e.event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END), ''), md5(event_type || event_id)) AS key FROM events e""")
def fallback_keys(spark: SparkSession, sf: str) -> DataFrame:
    first = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type"))
    return load(spark, sf, "events").select("event_id", tx.first_key(first, F.md5(F.concat("event_type", F.col("event_id").cast("string")).cast("binary"))).alias("key"))

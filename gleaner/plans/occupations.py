"""Queries over occupations, levels, agencies, company names, and the flags that follow from them.

Titles and names are composed from columns of the tables, so that every rule meets many inputs; the SQL composes the same
texts and applies the rules by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import company as co
from gleaner.functions import occupation as oc
from gleaner.functions import text as tx
from gleaner.operators import companies, lookups
from gleaner.operators import dedupe as dd
from gleaner.operators import frames as fr
from gleaner.plans.registry import Registry
from gleaner.sources.tables import load

query = Registry()

LEVELS = ("Senior ", "", "Junior ", "Lead ", "", "Staff ", "Director of ", "", "Sr. ", "Fresh Grad ", "VP, ")
ROLES = (
    "Software Engineer", "Full Stack Engineer", "Java Developer", "JavaScript Developer", "Sales Engineer", "Registered Nurse", "Data Scientist", "Cloud Architect",
    "Accountant", "Store", "Network Engineer", "Data Engineer", "C# Developer", "Go Developer", "Baker", "Mechanical Engineer", "Security Engineer", "Systems Engineer",
    "Machine Learning Engineer", "Technical Writer", "Wizard of Code", "Civil Engineer", ".NET Programmer",
)
TAILS = ("", " Intern", " Manager", " - Remote", " II", " (Backend)", " Supervisor")
CURATED = (("wizard of code", "SWE"), ("Technical Writer", "SWE_ADJACENT"), ("baker", "NOT_SWE"), ("Store", "SWE"), ("store", "NOT_SWE"))


def _pick(items: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (at % len(items) + 1).cast("int"))


def _sql_pick(items: tuple[str, ...], at: str) -> str:
    return f"list_extract([{', '.join(repr(x) for x in items)}], ({at}) % {len(items)} + 1)"


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf, "part").select("p_partkey", F.concat(_pick(LEVELS, k), _pick(ROLES, F.floor(k / 3)), _pick(TAILS, F.col("p_size"))).alias("title"))


def _re2(pattern: str) -> str:
    """A pattern without the two looks ahead that another engine lacks: what follows them says the same."""
    return pattern.replace("java(?!script)", "java").replace(r"go(?=\s*(developer|engineer|dev|programmer))", "go").replace("'", "''")


_TITLES_SQL = f"""
    t AS (SELECT p_partkey, {_sql_pick(LEVELS, "p_partkey")} || {_sql_pick(ROLES, "p_partkey // 3")} || {_sql_pick(TAILS, "p_size")} AS title FROM part),
    k AS (SELECT p_partkey, lower(title) AS raw, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower(title),
          '\\.net\\b', 'dotnet', 'g'), 'c#', 'csharp'), '\\b(senior|sr\\.?|junior|jr\\.?|lead|staff|principal|distinguished)\\b', '', 'g'), '\\b(i{{1,3}}|iv|v)\\b', '', 'g'),
          '\\s*-\\s*(remote|hybrid|onsite|on-site)\\s*$', ''), '\\s*[/,:;()-]+\\s*$', ''), '\\s+', ' ', 'g')) AS key FROM t),
    c(key, label) AS (VALUES ('wizard of code', 'SWE'), ('technical writer', 'SWE_ADJACENT'), ('baker', 'NOT_SWE')),
    o AS (SELECT k.*, label, regexp_matches(k.key, '{_re2(oc.SOFTWARE)}') AND NOT regexp_matches(k.key, '{_re2(oc.NOT_SOFTWARE)}') AS soft, regexp_matches(raw, '{oc.CONTROL}') AS ctl,
          regexp_matches(k.key, '{oc.ADJACENT}') AS adj FROM k LEFT JOIN c ON k.key = c.key),
    f AS (SELECT *, coalesce(soft OR (NOT ctl AND label = 'SWE'), FALSE) AS is_swe, coalesce(NOT soft AND NOT ctl AND (label = 'SWE_ADJACENT' OR label IS NULL AND adj), FALSE) AS is_adj FROM o)"""


@query(f"""
    WITH {_TITLES_SQL}
    SELECT p_partkey, is_swe, is_adj AS is_swe_adjacent, ctl AND NOT is_swe AND NOT is_adj AS is_control,
           CASE WHEN soft OR ctl THEN 1.0 WHEN label = 'SWE_ADJACENT' THEN 0.85 WHEN label IS NOT NULL THEN 0.9 WHEN adj THEN 0.82 ELSE 0.0 END::DOUBLE AS confidence,
           CASE WHEN soft OR ctl THEN 'regex' WHEN label IS NOT NULL THEN 'title_lookup_llm' WHEN adj THEN 'regex' ELSE 'unresolved' END AS tier FROM f""")
def occupation_labels(spark: SparkSession, sf: str) -> DataFrame:
    curated = lookups.curated_labels(spark.createDataFrame(list(CURATED), "title string, label string"), "title", "label", ("SWE", "SWE_ADJACENT", "NOT_SWE"))
    return lookups.occupations(_titles(spark, sf), "title", curated).select("p_partkey", "is_swe", "is_swe_adjacent", "is_control", "confidence", "tier")


@query(f"""
    WITH {_TITLES_SQL},
    g AS (SELECT p_partkey, raw, CASE WHEN ctl THEN 'control' WHEN is_adj THEN 'adjacent' WHEN is_swe THEN 'swe' ELSE 'other' END AS fam FROM f),
    m AS (SELECT *, ((fam = 'adjacent' AND regexp_matches(raw, '{oc.TRADES["adjacent"]}')) OR (fam = 'control' AND regexp_matches(raw, '{oc.TRADES["control"]}')))
          AND (regexp_matches(raw, '{oc.MANAGER}') OR regexp_matches(raw, '(^|[\\s,/:()\\-])lead\\b')) AS managed FROM g)
    SELECT p_partkey, CASE WHEN regexp_matches(raw, '{oc.INTERN}') THEN 'entry' WHEN regexp_matches(raw, '{oc.DIRECTOR}') THEN 'director' WHEN regexp_matches(raw, '{oc.SENIOR}') OR managed OR regexp_matches(raw, '{oc.LEAD}') THEN 'mid-senior'
           WHEN regexp_matches(raw, '{oc.JUNIOR}') THEN 'entry' ELSE 'unknown' END AS level,
           CASE WHEN regexp_matches(raw, '{oc.INTERN}') OR regexp_matches(raw, '{oc.DIRECTOR}') OR regexp_matches(raw, '{oc.SENIOR}') THEN 'title_keyword' WHEN managed THEN 'title_manager'
           WHEN regexp_matches(raw, '{oc.LEAD}') OR regexp_matches(raw, '{oc.JUNIOR}') THEN 'title_keyword' ELSE 'unknown' END AS level_source FROM m""")
def title_levels(spark: SparkSession, sf: str) -> DataFrame:
    curated = lookups.curated_labels(spark.createDataFrame(list(CURATED), "title string, label string"), "title", "label", ("SWE", "SWE_ADJACENT", "NOT_SWE"))
    return lookups.occupations(_titles(spark, sf), "title", curated).select("p_partkey", "level", "level_source")


FIRMS = ("Dice", "Lensa Inc", "Turing", "Turing Pharmaceutical Group", "Acme Pumps", "jobs  via Foo", "Robert Half Talent", "Hired", "Hired Hands", "Wipro", "Net2Source Inc.", "Blue Bakery")
_AGENCY_SQL = (
    "(lower(trim(firm)) IN ("
    + ", ".join(f"'{a}'" for a in co.AGENCIES)
    + ") OR regexp_matches(firm, '(?i)"
    + "|".join(p.split("(?!")[0] for p in co.AGENCY_PATTERNS if "turing" not in p)
    + r"') OR (regexp_matches(firm, '(?i)\bturing\b') AND NOT regexp_matches(firm, '(?i)\bturing\s+(pharmaceutical|medical)')))"
)


@query(f"""
    WITH s AS (SELECT c_custkey, {_sql_pick(FIRMS, "c_custkey")} || CASE WHEN c_nationkey % 5 = 0 THEN ' ' ELSE '' END AS firm, c_mktsegment, c_custkey % 4 AS k FROM customer),
    e AS (SELECT *, {_AGENCY_SQL} AS agency FROM s),
    r AS (SELECT *, CASE WHEN k = 0 THEN c_mktsegment || ' Works' WHEN k = 1 THEN c_mktsegment || ' Holdings' WHEN k = 2 THEN NULL ELSE c_mktsegment || ' North' END AS named FROM e)
    SELECT c_custkey, agency, CASE WHEN agency THEN named END AS employer, CASE WHEN agency AND named IS NOT NULL THEN named ELSE firm END AS company FROM r""")
def employers(spark: SparkSession, sf: str) -> DataFrame:
    """Agencies by name, the employer that a description names, and the company that counts."""
    firm = F.concat(_pick(FIRMS, F.col("c_custkey")), F.when(F.col("c_nationkey") % 5 == 0, " ").otherwise(""))
    market = F.initcap("c_mktsegment")
    told = (
        F.concat(F.lit("We post for others. Our client, "), F.col("c_mktsegment"), F.lit(" Works, is expanding its plant in the valley.")),
        F.concat(F.lit("An opening is filled on behalf of "), F.col("c_mktsegment"), F.lit(" Holdings. Apply to us and not to them.")),
        F.concat(F.lit("Our client is seeking people with an eye for "), market, F.lit("; the position is with a leading company, and it is well paid.")),
        F.concat(F.lit("We are partnered with a team for years. This role is with "), F.col("c_mktsegment"), F.lit(" North in the old town, second floor.")),
    )
    description = F.element_at(F.array(*told), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = load(spark, sf, "customer").select("c_custkey", firm.alias("firm"), description.alias("description"))
    rows = rows.withColumn("agency", co.is_agency(F.col("firm"))).withColumn("employer", F.when(F.col("agency"), co.real_employer(F.col("description"), F.col("firm"))))
    return rows.select("c_custkey", "agency", "employer", co.effective_company(F.col("agency"), F.col("employer"), F.col("firm")).alias("company"))


SPELLINGS = ("{}", "{}, Inc.", "{} LLC", "The {}", "{} (NY)")


@query("""
    WITH s AS (SELECT c_custkey, substr(md5((c_nationkey + 25 * (c_custkey % 3))::VARCHAR), 1, 9) || ' ' || substr(md5((c_nationkey + 25 * (c_custkey % 3))::VARCHAR), 12, 9) AS base, c_custkey % 7 AS k FROM customer),
    t AS (SELECT CASE WHEN k = 0 THEN 'Facebook' WHEN k = 6 AND c_custkey % 2 = 0 THEN 'google cloud' WHEN k IN (1, 2) THEN base || ', Inc.' WHEN k = 3 THEN upper(base) || ' LLC' ELSE base END AS name,
          CASE WHEN k = 0 THEN 'Meta' WHEN k = 6 AND c_custkey % 2 = 0 THEN 'Google' END AS alias, base FROM s),
    n AS (SELECT name, alias, coalesce(alias, base) AS key, count(*) AS n FROM t GROUP BY ALL),
    l AS (SELECT *, first_value(name) OVER (PARTITION BY key ORDER BY n DESC, name) AS label FROM n)
    SELECT name, coalesce(alias, label) AS canonical, CASE WHEN alias IS NOT NULL THEN 'alias' WHEN name <> label THEN 'exact_normalized' ELSE 'passthrough' END AS method FROM l""")
def company_names(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings of made-up companies, and two known ones, brought together."""
    k, code = F.col("c_custkey") % 7, F.md5((F.col("c_nationkey") + 25 * (F.col("c_custkey") % 3)).cast("string").cast("binary"))
    base = F.concat_ws(" ", F.substring(code, 1, 9), F.substring(code, 12, 9))
    name = F.when(k == 0, "Facebook").when((k == 6) & (F.col("c_custkey") % 2 == 0), "google cloud").when(k.isin(1, 2), F.concat(base, F.lit(", Inc.")))
    name = name.when(k == 3, F.concat(F.upper(base), F.lit(" LLC"))).otherwise(base)
    return companies.company_lookup(load(spark, sf, "customer").select(name.alias("company")), "company")


@query("""
    SELECT doc_id, coalesce(source IN ('src0', 'src1') AND lang = 'en' AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 15 AND quality = 1, FALSE) AS eligible,
           coalesce(quality = 1, FALSE) AS is_swe, coalesce(toxic = 1 AND NOT coalesce(quality = 1, FALSE), FALSE) AS is_swe_adjacent,
           coalesce(lang = 'de', FALSE) AND NOT coalesce(quality = 1, FALSE) AND NOT coalesce(toxic = 1, FALSE) AS is_control
    FROM documents LEFT JOIN labels USING (doc_id)""")
def frame_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", "source", "lang", "text").join(load(spark, sf, "labels"), "doc_id", "left")
    can = oc.eligible(F.col("source"), F.col("lang") == "en", F.col("text"), F.col("quality") == 1, ("src0", "src1"))
    one = oc.exclusive(F.col("quality") == 1, F.col("toxic") == 1, F.col("lang") == "de")
    return rows.select("doc_id", can.alias("eligible"), one.alias("o")).select("doc_id", "eligible", "o.*")


@query("""
    WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'director' ELSE 'unknown' END AS rule, CASE WHEN n_chars % 4 = 0 THEN NULL WHEN n_chars % 4 = 1 THEN 'associate' ELSE 'mid-senior' END AS told,
               CASE WHEN n_chars < 1000 THEN 'labeled' ELSE 'deferred' END AS state, CASE n_chars % 6 WHEN 0 THEN 'SWE' WHEN 1 THEN 'SWE_ADJACENT' WHEN 2 THEN 'NOT_SWE' END AS occ FROM documents),
    f AS (SELECT *, CASE WHEN state = 'labeled' AND told IS NOT NULL THEN told ELSE rule END AS final FROM d)
    SELECT doc_id, rule, final, CASE final WHEN 'entry' THEN 'junior' WHEN 'associate' THEN 'mid' WHEN 'mid-senior' THEN 'senior' WHEN 'director' THEN 'senior' ELSE 'unknown' END AS final_3, coalesce((occ IN ('SWE', 'SWE_ADJACENT'))::VARCHAR, 'unknown') AS combined FROM f""")
def label_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """A label of a model over that of a rule, which stays beside it; and the flag of a combined label."""
    n = F.col("n_chars")
    rule = F.when(F.col("doc_id") % 5 == 0, "entry").when(F.col("doc_id") % 5 == 1, "director").otherwise("unknown")
    told = F.when(n % 4 == 1, "associate").when(n % 4 > 1, "mid-senior")
    state = F.when(n < 1000, "labeled").otherwise("deferred")
    occ = F.when(n % 6 == 0, "SWE").when(n % 6 == 1, "SWE_ADJACENT").when(n % 6 == 2, "NOT_SWE")
    rows = load(spark, sf, "documents").select("doc_id", rule.alias("rule"), fr.overridden(rule, told, state).alias("final"), F.coalesce(oc.combined_label(occ).cast("string"), F.lit("unknown")).alias("combined"))
    return rows.withColumn("final_3", tx.seniority_3(F.col("final")))


@query("""
    WITH e AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, event_id % 3 AS f FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY f, event_id) AS r FROM e),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY f, event_id) AS q FROM s WHERE r = 1)
    SELECT event_id, user_id, event_type, day, q = 1 AS posting FROM p""")
def harmonized_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that repeat a snapshot's posting go; of what stays, the first of each posting is marked. Files have an order."""
    rows = load(spark, sf, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 3).alias("file"))
    return dd.two_levels(rows, ["user_id", "event_type", "day"], ["user_id", "event_type"], [F.col("file"), F.col("event_id")], "posting").drop("file")


@query("""
    WITH o AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events), c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d'), event_id) AS r FROM events)
    SELECT c.user_id, c.day AS first_day, c.event_id, (SELECT count(*) FROM o WHERE o.user_id = c.user_id) AS days FROM c WHERE r = 1""")
def canonical_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical row of each user, and how many days it was observed on."""
    rows = load(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    canonical, observed = dd.canonical_and_observations(rows, "user_id", "day", ["event_id"])
    return canonical.withColumnRenamed("day", "first_day").join(observed.groupBy("user_id").agg(F.count(F.lit(1)).alias("days")), "user_id")

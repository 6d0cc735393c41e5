"""Queries over text units, external inference and embedding inputs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import experience as xp
from gleaner.functions import text as tx
from gleaner.functions.ship import ship
from gleaner.functions.units import units
from gleaner.operators import inference as inf
from gleaner.plans.registry import Registry
from gleaner.sources.tables import load

query = Registry()
_UNITS = "array<struct<unit_id:int,unit_type:string,text:string>>"


def with_units(df: DataFrame, uid: str, text: str) -> DataFrame:
    """uid and the text's units as an array."""
    ship(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({uid: p[uid], "units": [units(t) for t in p[text]]})

    return df.select(uid, text).mapInPandas(run, f"{uid} {df.schema[uid].dataType.simpleString()}, units {_UNITS}")


@query()
def text_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of each document by kind, and the longest."""
    rows = with_units(load(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.explode("units").alias("u"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("u.unit_type") == "sentence").alias("sentences"), F.max(F.length("u.text")).alias("longest"))


@query()
def reconstructed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without their first unit."""
    rows = with_units(load(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.length(inf.kept_text(F.col("units"), F.array(F.lit(1)))).alias("kept_chars"), F.size("units").alias("units"))


def rule_provider(prompts: list[str]) -> list[str]:
    """A stand-in for a model: answers by rule, fenced as models do, sometimes with a brace missing."""
    out = []
    for p in prompts:
        level = "entry" if "intern" in p else "director" if len(p) > 3000 else "unknown"
        body = json.dumps({"swe_classification": "SWE" if "tion" in p else "NOT_SWE", "seniority": level, "ghost_assessment": "realistic", "yoe_min_years": len(p) % 7})
        out.append(f"```json\n{body[:-1] if len(p) % 5 == 0 else body}\n```")
    return out


@query("""
    SELECT md5(text) AS key, CASE WHEN contains(text, 'tion') THEN 'SWE' ELSE 'NOT_SWE' END AS label, CASE WHEN contains(text, 'intern') THEN 'entry' WHEN length(text) > 3000 THEN 'director' ELSE 'unknown' END AS seniority,
           CAST(length(text) % 7 AS BIGINT) AS years, count(*) AS n_rows FROM documents GROUP BY text""")
def inferred_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("text", F.md5(F.col("text").cast("binary")).alias("key"))
    found = inf.infer(docs, "key", "text", rule_provider, inf.CLASSIFICATION)
    counts = docs.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    get = lambda f: F.get_json_object("payload", f"$.{f}")
    return found.filter("error is null").join(counts, "key").select("key", get("swe_classification").alias("label"), get("seniority").alias("seniority"), get("yoe_min_years").cast("long").alias("years"), "n_rows")


@query(r"""
    WITH t AS (SELECT doc_id, source AS h, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM documents)
    SELECT doc_id, CASE WHEN b = '' THEN NULL WHEN length(h) + 2 + length(b) > 300 THEN h || chr(10) || chr(10) || rtrim(substr(b, 1, 300 - length(h) - 2)) ELSE h || chr(10) || chr(10) || b END AS input FROM t""")
def embedding_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", inf.embedding_text(F.col("source"), F.col("text"), 100).alias("input"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('fr') GROUP BY lang")
def uncached_work(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    cache = docs.filter("lang = 'fr'")
    return inf.work_list(docs, cache, "doc_id").filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT doc_id, round(length(regexp_replace(text, '[^aeiouyAEIOUY]', '', 'g')) / greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), 1)::DOUBLE, 6) AS vowels_per_word,
           round(length(text) / greatest(len(regexp_extract_all(text, '[.!?]')), 1)::DOUBLE, 6) AS chars_per_sentence FROM documents""")
def readability(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id",
        F.round(F.length(F.regexp_replace(c, "[^aeiouyAEIOUY]", "")) / F.greatest(tx.word_count(c), F.lit(1)), 6).alias("vowels_per_word"),
        F.round(F.length(c) / F.greatest(tx.matches(c, "[.!?]"), F.lit(1)), 6).alias("chars_per_sentence"),
    )


#: Postings by part number: n and m are years, m at least n.
_POSTINGS = (
    "Requirements:\nYou bring {n}+ years of software engineering experience.",
    "Experience: {n} - {m} yrs",
    "Our office opened {n} years ago.",
    "Preferred: {n} years of relevant experience",
    "A bachelor's degree and {n} years of experience, or a master's degree and {m} years of experience.",
    "Salary {n} years of sales experience, $100 per hour",
    "{n} years in hospitals",
)


@query("""
    WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, p_size AS n, p_size + p_partkey % 3 AS m FROM part),
    j AS (SELECT *, CASE k WHEN 2 THEN FALSE WHEN 5 THEN FALSE WHEN 1 THEN n >= 1 AND m <= 20 ELSE n BETWEEN 1 AND 20 END AS one, k = 4 AND m BETWEEN 1 AND 20 AS two FROM p)
    SELECT p_partkey,
           CASE WHEN k = 6 OR NOT (one OR two) THEN NULL WHEN k = 4 AND NOT one THEN m::DOUBLE ELSE n::DOUBLE END AS years,
           CASE WHEN k = 6 OR NOT (one OR two) THEN NULL WHEN (k = 1 AND one) OR two THEN m::DOUBLE ELSE n::DOUBLE END AS most,
           one::INT + two::INT AS n,
           CASE WHEN NOT (one OR two) THEN 'no_valid_mentions' WHEN k = 6 THEN 'subskill_only_abstain' WHEN k = 4 THEN 'degree_ladder_parallel_min_path' WHEN k = 0 THEN 'required_total_role'
                WHEN k = 3 THEN 'preferred_total_role' WHEN m > n THEN 'range_primary' ELSE 'overall_total_role' END AS rule FROM j""")
def experience_years(spark: SparkSession, sf: str) -> DataFrame:
    """Postings written from a table of parts: years asked for, the most of all that count, their number, and the rule that chose."""
    n, m = F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 3
    texts = F.array(*[F.replace(F.replace(F.lit(t), F.lit("{n}"), n.cast("string")), F.lit("{m}"), m.cast("string")) for t in _POSTINGS])
    rows = load(spark, sf, "part").select("p_partkey", F.element_at(texts, (F.col("p_partkey") % 7 + 1).cast("int")).alias("text"))
    return xp.with_sightings(rows, "text").select("p_partkey", xp.years("sightings").alias("y")).select("p_partkey", "y.years", "y.most", "y.n", "y.rule")

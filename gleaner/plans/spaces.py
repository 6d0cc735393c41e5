"""Queries over resampling and vector spaces: intervals, permutation tests, axes, boundaries, drift, association."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import resampling as rs
from gleaner.operators import vectors as vc
from gleaner.plans.registry import Registry
from gleaner.sources.tables import load

query = Registry()

#: Labels whose centroids one process assigns; more raise an error.
LABELS = 500


def centres(spark: SparkSession, sf: str) -> dict[int, np.ndarray]:
    """The centroids of the labels, of which there may be LABELS."""
    found = vc.centroids(load(spark, sf, "embeddings"), ["label"], F.col("embedding")).filter("label is not null").limit(LABELS + 1).collect()
    if len(found) > LABELS:
        raise ValueError(f"over {LABELS} labels: their centroids are too many for one process")
    return {r.label: np.array(r.centroid) for r in found}


@query()
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    return rs.bootstrap_difference(load(spark, sf, "documents"), "doc_id", F.col("lang") == "en", F.col("n_chars"), 200)


@query()
def permutation_test(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    return rs.permutation_test(rows, "doc_id", F.col("toxic") == 1, F.col("n_chars"), 100)


@query()
def axis_projections(spark: SparkSession, sf: str) -> DataFrame:
    """Mean projection of each label on the axis through the centroids of labels 0 and 1."""
    c = centres(spark, sf)
    axis = vc.difference_axis(np.array([c[1] - c[0]]))
    rows = load(spark, sf, "embeddings").select("label", vc.projection(F.col("embedding"), axis).alias("p"))
    return rows.groupBy("label").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev("p"), 6).alias("sd"), F.round(F.avg((F.abs("p") < 0.1).cast("int")), 6).alias("near_boundary"))


@query("""
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), x AS (SELECT label, unnest(generate_series(1, len(e))) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), a AS (SELECT c AS ca FROM c WHERE label = 0), b AS (SELECT c AS cb FROM c WHERE label = 1)
    SELECT label, round(avg(list_cosine_similarity(e, ca) - list_cosine_similarity(e, cb)), 6) AS association, count(*) AS n FROM v CROSS JOIN a CROSS JOIN b GROUP BY label""")
def differential_association(spark: SparkSession, sf: str) -> DataFrame:
    c = centres(spark, sf)
    rows = load(spark, sf, "embeddings")
    return rows.groupBy("label").agg(F.round(F.avg(vc.differential_association(F.col("embedding"), c[0], c[1])), 6).alias("association"), F.count(F.lit(1)).alias("n"))


@query("""
    WITH v AS (SELECT label, vec_id % 2 AS era, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), x AS (SELECT label, era, unnest(generate_series(1, len(e))) AS i, unnest(e) AS x FROM v), m AS (SELECT label, era, i, avg(x) AS m FROM x GROUP BY ALL),
    c AS (SELECT label, era, list(m ORDER BY i) AS c FROM m GROUP BY ALL)
    SELECT a.label, round(list_distance(a.c, b.c), 6) AS drift, round(list_cosine_similarity(a.c, b.c), 6) AS cosine FROM c a JOIN c b ON a.label = b.label AND a.era = 0 AND b.era = 1""")
def centroid_drift(spark: SparkSession, sf: str) -> DataFrame:
    c = vc.centroids(load(spark, sf, "embeddings").withColumn("era", F.col("vec_id") % 2), ["label", "era"], F.col("embedding"))
    a, b = c.filter("era = 0").select("label", F.col("centroid").alias("a")), c.filter("era = 1").select("label", F.col("centroid").alias("b"))
    gap = F.zip_with("a", "b", lambda x, y: x - y)
    return a.join(b, "label").select("label", F.round(vc.norm(gap), 6).alias("drift"), F.round(vc.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query()
def aligned_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The one-to-one assignment of the labels' centroids in two halves of the rows that is nearest by cosine. Rows without a label have no cluster."""
    c = vc.centroids(load(spark, sf, "embeddings").withColumn("era", F.col("vec_id") % 2), ["label", "era"], F.col("embedding")).filter("label is not null").limit(2 * LABELS + 1).collect()
    if len(c) > 2 * LABELS:
        raise ValueError(f"over {LABELS} labels: their centroids are too many to be assigned in one process")
    names = sorted({r.label for r in c})
    sides = [np.array([next(r.centroid for r in c if r.label == n and r.era == e) for n in names]) for e in (0, 1)]
    sides = [s / np.linalg.norm(s, axis=1, keepdims=True) for s in sides]
    cost = 1 - sides[0] @ sides[1].T
    return spark.createDataFrame([(int(names[i]), int(names[j]), float(1 - cost[i, j])) for i, j in enumerate(vc.assignment(cost))], "label int, matched int, cosine double")

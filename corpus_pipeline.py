"""A corpus pipeline: documents pass toxicity, exact dedup, near-duplicate removal, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. Its result is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import store, toxicity
from gleaner.llm.exact_dedup import exact_dedup
from gleaner.llm.jaccard_join import jaccard_components
from gleaner.llm.mixing import copies, mix
from gleaner.llm.queries import bpe_digests
from gleaner.sources.tables import load

#: Scores from which a document is rejected.
TOXIC = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained from the labels at hand, scores below TOXIC. Null and empty texts stay."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    score = _free(docs, "score")
    return toxicity.with_scores(docs, model, score).filter(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of repeated rows one. A null doc_id stays where no other has the text.

    What goes is far less than what stays, so the rows that go are looked up, and texts need not be shuffled for it.
    """
    key, sha = _free(docs, "gone_id"), _free(docs, "text_sha256")
    found = store.written(exact_dedup(docs, keep="max"), "pipeline-copies")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = store.small(found.filter(~F.col("kept") & ~same).select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)))
    rows = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone[key]) & (rows[sha] == gone[sha]), "left_anti")
    if found.filter(~F.col("kept") & same).head(1):  # rows that repeat the one that stays
        rows = rows.dropDuplicates(["doc_id", sha])
    return rows.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of their shingle sets connect, one: that with the smallest doc_id, of several rows with it
    the one with the smallest digest; a null doc_id comes last. Empty texts all stay.

    Rows are told apart by doc_id and the digest of the text, so a doc_id that stands for several texts loses none that has
    no copy; of rows that repeat each other in both, one stays if they stand for their component.
    """
    sha, key = _free(docs, "text_sha256"), _free(docs, "gone_id")
    rows = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    found = store.written(jaccard_components(rows, carry=sha), "pipeline-components").filter("component_key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("first_id"), F.col(sha).alias("first_sha")))
    stay = found.groupBy("component_key").agg(first.alias("f"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component_key", "f.first_id", "f.first_sha")
    judged = found.join(store.small(stay), "component_key")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col(sha) == F.col("first_sha"))
    gone = judged.filter(~is_first).select(F.col("doc_id").alias(key), F.col(sha).alias("gone_sha")).distinct()
    kept = rows.join(store.small(gone), rows["doc_id"].eqNullSafe(F.col(key)) & (rows[sha] == F.col("gone_sha")), "left_anti")
    twice = judged.filter(is_first).groupBy("doc_id", sha).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if twice.head(1):  # rows that repeat the one that stays
        number = F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(F.lit(0)))
        again = kept.join(store.small(twice.select(F.col("doc_id").alias(key), F.col(sha).alias("gone_sha"))), rows["doc_id"].eqNullSafe(F.col(key)) & (rows[sha] == F.col("gone_sha")), "left_semi")
        alone = kept.join(store.small(twice.select(F.col("doc_id").alias(key), F.col(sha).alias("gone_sha"))), rows["doc_id"].eqNullSafe(F.col(key)) & (rows[sha] == F.col("gone_sha")), "left_anti")
        kept = alone.unionByName(again.withColumn(key, number).filter(F.col(key) == 1).drop(key))
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, 0 to 3 times each, so that the words of a source add up to its target. Texts without words go.

    Rows with one doc_id and source are one document: they come as often as each other. A null doc_id or source is one too.
    """
    key, source, times = _free(docs, "mixed_id"), _free(docs, "mixed_source"), _free(docs, "times")
    taken = copies(mix(docs)).select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("times").alias(times))
    taken = store.small(store.written(taken, "pipeline-mix"))
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken[key]) & docs["source"].eqNullSafe(taken[source]))
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: No SQL: the first stage trains a model. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.written(docs, "pipeline")
    return docs

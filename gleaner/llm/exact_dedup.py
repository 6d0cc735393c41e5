"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the texts, an external sort places equal texts side by side, and
the comparison of neighbouring full texts (the partition change test of the window over the sorted
rows) forms runs of equals.

* The range key is (first bytes, SHA-256, salt): it is short, so the splitter sample on the driver stays
  small however long texts are, and it sends equal texts to one place whatever prefix they share.
* A digest with more than ``hot_rows`` rows is salted into ranges of about that many rows. Counting digests
  is a pre-aggregated pass over 32-byte keys. One representative text per salted range then meets the others
  in a second full comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import store

#: Rows of one digest from which its range is split.
HOT_ROWS = 512
#: Leading bytes that lead the sort order.
HEAD_BYTES = 24
#: Most hot digests that are broadcast (under 10 MB); beyond, the same join shuffles.
BROADCAST_DIGESTS = 100_000


def exact_dedup(docs: DataFrame, normalised: Column | None = None, keep: str = "min", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    ``normalised`` is the expression under which texts are compared (the text itself, if None; a null counts as
    empty). ``keep`` says whether the smallest ("min") or largest ("max") doc_id of equal texts stays. A null doc_id
    gives way to any other. Of repeated rows with the doc_id that stays, exactly one is kept. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    text = F.coalesce((F.col("text") if normalised is None else normalised).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("content"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    hot = store.written(rows.groupBy("sha").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows), "dedup-hot")
    ranges = hot.select("sha", F.ceil(F.col("n") / hot_rows).cast("long").alias("ranges"))
    if hot.count() <= BROADCAST_DIGESTS:
        ranges = F.broadcast(ranges)
    rows = (
        rows.join(ranges, "sha", "left")
        .withColumn("salt", F.when(F.col("ranges").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("ranges"))).otherwise(F.lit(-1)))
        .withColumn("head", F.substring(F.col("content").cast("binary"), 1, HEAD_BYTES))
        .select("head", "sha", "salt", "content", "doc_id")
    )
    first = F.asc_nulls_last("doc_id") if keep == "min" else F.desc_nulls_last("doc_id")
    run = Window.partitionBy("head", "sha", "salt", "content").orderBy(first)
    everything = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = rows.repartitionByRange("head", "sha", "salt").select(
        "doc_id",
        "sha",
        "salt",
        F.row_number().over(run).alias("rn"),
        F.first("doc_id").over(everything).alias("run_keep"),
        F.count("*").over(everything).alias("run_size"),
        "content",
    )
    runs = runs.withColumn("content", F.when((F.col("salt") >= 0) & (F.col("rn") == 1), F.col("content")))
    runs = store.written(runs, "dedup-runs")
    best = (F.min if keep == "min" else F.max)("run_keep")
    heads = runs.filter("salt >= 0 and rn = 1")
    # The texts that represent salted ranges are compared in full once more.
    groups = heads.groupBy("sha", "content").agg(best.alias("keep_id"), F.sum("run_size").alias("group_size"))
    members = heads.alias("h").join(groups.alias("g"), (F.col("h.sha") == F.col("g.sha")) & (F.col("h.content") == F.col("g.content")))
    members = members.select(F.col("h.sha").alias("sha"), F.col("h.salt").alias("salt"), F.col("h.run_keep").alias("run_keep"), "g.keep_id", "g.group_size")
    split = runs.filter("salt >= 0").drop("content").alias("r").join(
        members.alias("m"),
        (F.col("r.sha") == F.col("m.sha")) & (F.col("r.salt") == F.col("m.salt")) & F.col("r.run_keep").eqNullSafe(F.col("m.run_keep")),
    ).select("r.doc_id", "r.sha", "r.salt", "r.rn", "m.keep_id", "m.group_size")
    whole = runs.filter("salt < 0").select("doc_id", "sha", "salt", "rn", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"))
    # A group without any doc_id has no keeper to name: its row of the smallest salt stays.
    lowest = split.filter("keep_id is null").groupBy("sha").agg(F.min("salt").alias("least"))
    split = split.join(lowest, "sha", "left")
    stays = (F.col("rn") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("least").isNull() | (F.col("least") == F.col("salt")))
    out = whole.withColumn("least", F.lit(None).cast("long")).unionByName(split.select("doc_id", "sha", "salt", "rn", "keep_id", "group_size", "least"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

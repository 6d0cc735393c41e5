"""Incremental ingest with Structured Streaming: the batch rules over files as they arrive.

The schema is given, never inferred. State grows with the number of keys inside the watermark, not with history, except
where a function says that it keeps every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gleaner.operators.relational import first_per_key


def arriving(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int = 8, glob: str = "*") -> DataFrame:
    """A stream of the files of a folder."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).load(folder)


def first_seen(stream: DataFrame, uid: str, ts: str, delay: str) -> DataFrame:
    """Each uid once; a uid is remembered for as long as the watermark waits."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([uid])


def lifespans(stream: DataFrame, uid: str, ts: str) -> DataFrame:
    """First and last time and observations per uid, to be written in update mode; the state has every uid."""
    return stream.groupBy(uid).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_obs"))


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, delay: str) -> DataFrame:
    """Rows per key and calendar window; a window is closed when the watermark has passed it."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def split_observations(stream: DataFrame, uid: str, seen: str, canonical: str, observations: str, checkpoint: str, tie: Sequence[str] = ()) -> StreamingQuery:
    """Writes every (uid, day) once to ``observations``, and to ``canonical`` the rows that :func:`canonical_rows` chooses from.

    Each batch is joined with what is there, and adds its first row of a uid only where none is there that comes before
    it by ``seen`` and ``tie``; so a later batch with an earlier day puts things right, and a batch that is run again after
    a failure adds nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch.persist()
        try:
            days = rows.select(uid, seen).distinct()
            old = _table(spark, observations, days)
            days.join(old, [uid, seen], "left_anti").write.mode("append").parquet(observations)
            first = first_per_key(rows, [uid], [F.col(seen), *map(F.col, tie)])
            best = _table(spark, canonical, rows).groupBy(F.col(uid).alias("_uid")).agg(F.min(F.struct(seen, *tie)).alias("_best"))
            newer = first.join(best, F.col(uid) == F.col("_uid"), "left").filter(F.col("_best").isNull() | (F.struct(seen, *tie) < F.col("_best")))
            newer.select(*rows.columns).write.mode("append").parquet(canonical)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def canonical_rows(spark: SparkSession, path: str, uid: str, seen: str, tie: Sequence[str] = ()) -> DataFrame:
    """The first row of each uid by ``seen`` and ``tie`` among those that :func:`split_observations` has written."""
    return first_per_key(spark.read.parquet(path), [uid], [F.col(seen), *map(F.col, tie)])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], like.schema)


def run_once(stream: DataFrame, folder: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into Parquet below ``folder`` and returns what the table then holds.

    A batch that is run again replaces its own files. In mode "complete" the last batch is the table, in mode "append" all
    batches are.
    """
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number:08d}")
        last.append(number)

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    paths = [f"{folder}/batch-{n:08d}" for n in sorted(set(last))]
    return spark.read.schema(stream.schema).parquet(*(paths[-1:] if mode == "complete" else paths)) if paths else spark.createDataFrame([], stream.schema)

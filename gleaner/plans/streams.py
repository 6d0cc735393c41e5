"""Queries that run as streams over all files present; their results equal those of a batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.registry import Registry
from gleaner.sources.tables import load
from gleaner.streaming import ingest

query = Registry()


def _folders(spark: SparkSession) -> tuple[str, str]:
    """New folders in the shared one: for a table and for a stream's state."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = folder or f"file://{tempfile.mkdtemp(prefix='gleaner-stream-')}"
    own = f"{folder}/stream-{uuid.uuid4().hex}"
    return f"{own}/table", f"{own}/state"


def _run(stream: DataFrame, mode: str) -> DataFrame:
    table, state = _folders(stream.sparkSession)
    return ingest.run_once(stream, table, mode, state)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    stream = ingest.arriving(spark, sf, load(spark, sf, "events").schema, glob="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n_obs FROM events GROUP BY user_id""")
def streamed_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(ingest.lifespans(_events(spark, sf), "user_id", "ts"), "complete")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")})


@query("""
    SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def streamed_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(ingest.windowed_counts(_events(spark, sf), "ts", "event_type", "7 days", "1 hour"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def streamed_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    stream = ingest.first_seen(_events(spark, sf), "user_id", "ts", "400 days").select("user_id")
    return _run(stream, "append")

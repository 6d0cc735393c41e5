"""Further sources: CSV as relations, frames as relations, SQLite files, arrays on disk, web pages, and copies of folders.

What Spark reads by itself stays a lazy plan. The others are read on the executors in ranges, so their paths must name a
folder that all executors share.
"""

from __future__ import annotations

import json
import sqlite3
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.functions.ship import ship


def read_csv_where(spark: SparkSession, path: str | Sequence[str], schema: StructType, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """The named columns of CSV files with headers, and of these the rows for which ``where`` holds.

    Spark cuts the files in splits and reads only what is named; the filter is tested as rows are parsed.
    """
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return (rows if where is None else rows.filter(where)).select(*columns)


def csv_view(spark: SparkSession, name: str, path: str, schema: str) -> None:
    """CSV files as a relation for SQL."""
    spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).createOrReplaceTempView(name)


def register(spark: SparkSession, name: str, frame: pd.DataFrame, schema: str | None = None) -> None:
    """A frame in memory as a relation for SQL; for small tables."""
    spark.createDataFrame(frame, schema).createOrReplaceTempView(name)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """The columns of ``schema`` of a table in an SQLite file; each task reads a range of row ids.

    The file is opened read-only. A table without rows gives none.
    """
    ship(spark)
    names = [f.name for f in StructType.fromDDL(schema).fields]
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quote(table)}").fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // parts)
    sql = f"SELECT {', '.join(map(quote, names))} FROM {quote(table)} WHERE rowid >= ? AND rowid < ?"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                try:
                    cursor = db.execute(sql, (int(low + k * step), int(low + (k + 1) * step)))
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)
                finally:
                    db.close()

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def read_array(spark: SparkSession, path: str, keys: Mapping[str, int] | None = None, rows_per_task: int = 10_000) -> DataFrame:
    """key and vector of each row of a two-dimensional ``.npy`` file, which tasks map into memory and read their rows of.

    ``keys`` gives the rows names, by their number (without it the number is the name); rows that it does not name are left out.
    """
    ship(spark)
    n = np.load(path, mmap_mode="r").shape[0]
    parts = max(1, -(-n // rows_per_task))
    names = None if keys is None else {v: k for k, v in keys.items()}
    shared = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array, known = np.load(path, mmap_mode="r"), shared.value
        for batch in batches:
            for k in batch["id"]:
                low, high = int(k) * rows_per_task, min(n, (int(k) + 1) * rows_per_task)
                at = [i for i in range(low, high) if known is None or i in known]
                if at:
                    yield pd.DataFrame({"key": [str(i) if known is None else known[i] for i in at], "vector": array[at].astype("float32").tolist()})

    return spark.range(0, parts, 1, parts).mapInPandas(run, "key string, vector array<float>")


def fetch_text(url: str, timeout: float = 30.0) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        return answer.read().decode("utf-8", "replace")


def read_pages(requests: DataFrame, url: str, fetch: Callable[[str], str] = fetch_text, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """``requests`` with body and error: what ``fetch`` gives for the column ``url``; one of both is null.

    A request that fails is tried again after ``pause``, 2 ``pause``, ... seconds; how many run at once is the number of
    partitions. A null url has neither body nor error.
    """
    ship(requests.sparkSession)
    fields = requests.columns

    def get(address: str | None) -> tuple[str | None, str | None]:
        if address is None:
            return None, None
        for k in range(attempts):
            try:
                return fetch(address), None
            except Exception as e:  # noqa: BLE001 - any failure of a source is data
                said = f"{type(e).__name__}: {e}"
                if k + 1 < attempts:
                    time.sleep(pause * 2**k)
        return None, said

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [get(u) for u in batch[url]]
            yield batch.assign(body=[f[0] for f in found], error=[f[1] for f in found])

    return requests.mapInPandas(run, StructType([*requests.schema.fields]).add("body", "string").add("error", "string")).select(*fields, "body", "error")


def json_records(pages: DataFrame, path: Sequence[str], schema: str) -> DataFrame:
    """The records below ``path`` in the JSON of ``body``, a row each; bodies that are no JSON give none."""
    records = F.from_json(F.get_json_object("body", "$" + "".join(f".{p}" for p in path)), f"array<struct<{schema}>>")
    return pages.select(F.explode(records).alias("r")).select("r.*")


def backup(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """Copies a folder file by file to any store that Spark writes, and says what is there: bytes by relative path.

    Files that are there with the same length are not copied again; a copy of another length raises an error. The manifest
    is written last, so a folder without one is not whole.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root, goal = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    from_, to = root.getFileSystem(conf), goal.getFileSystem(conf)
    base, done = from_.getFileStatus(root).getPath().toString().rstrip("/"), {}
    files = from_.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString()[len(base) + 1 :]
        copy = jvm.org.apache.hadoop.fs.Path(goal, name)
        if not (to.exists(copy) and to.getFileStatus(copy).getLen() == status.getLen()):
            jvm.org.apache.hadoop.fs.FileUtil.copy(from_, status.getPath(), to, copy, False, True, conf)
        if to.getFileStatus(copy).getLen() != status.getLen():
            raise OSError(f"{name} was not copied whole")
        done[name] = status.getLen()
    out = to.create(jvm.org.apache.hadoop.fs.Path(goal, "_MANIFEST.json"), True)
    try:
        out.write(bytearray(json.dumps(done, sort_keys=True).encode()))
    finally:
        out.close()
    return done

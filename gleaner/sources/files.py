"""File sources and sinks: snapshot folders, width-checked CSV, atomic tables, append logs, small workbooks."""

from __future__ import annotations

import csv
import json
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.operators.relational import first_per_key


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def listing(spark: SparkSession, folder: str, pattern: str, skip: str = r"$^") -> list[str]:
    """The files of a folder whose names match ``pattern`` and not ``skip``, in order of name; through Spark's file systems."""
    fs, path = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isFile()]
    return [f"{folder}/{n}" for n in sorted(names) if re.fullmatch(pattern, n) and not re.search(skip, n)]


def first_lines(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """The first line of each file, through Spark's file systems: no job, and no more than a buffer of each file is read."""

    def first(path: str) -> str:
        fs, hadoop = _fs(spark, path)
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(hadoop), "UTF-8"))
        try:
            return (reader.readLine() or "").removeprefix("\ufeff")
        finally:
            reader.close()

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(first, files))


@dataclass
class Snapshots:
    rows: DataFrame
    accepted: list[str]
    rejected: dict[str, int]


def read_snapshots(spark: SparkSession, files: Sequence[str], columns: Sequence[str]) -> Snapshots:
    """CSV snapshots with exactly the given columns, the day from each file's name in ``scrape_date``; files of another
    width are rejected and named with their width. Only headers are read to decide."""
    accepted, rejected = [], {}
    for f, header in zip(files, first_lines(spark, files), strict=True):
        width = len(next(csv.reader([header]), []))
        if width == len(columns):
            accepted.append(f)
        else:
            rejected[f] = width
    schema = StructType([StructField(c, StringType()) for c in columns])
    if not accepted:
        return Snapshots(spark.createDataFrame([], schema.add("scrape_date", StringType()).add("file_name", StringType())), accepted, rejected)
    rows = spark.read.schema(schema).csv(accepted, header=True, multiLine=True, escape='"')
    name = F.col("_metadata.file_name")
    rows = rows.withColumn("file_name", name).withColumn("scrape_date", F.regexp_extract("file_name", r"\d{4}-\d{2}-\d{2}", 0))
    return Snapshots(rows, accepted, rejected)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types: missing ones as nulls, others dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def replace_table(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Writes a Parquet table beside ``path`` and puts it there when it is whole.

    The old table is moved aside and goes when the new one is in its place; if that fails it is moved back. What a crash
    leaves is one of the two at ``path``, or the old one at ``path`` + ".old": :func:`recover_table` puts it back.
    """
    spark = df.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.option("compression", compression).parquet(fresh)
    fs, target = _fs(spark, path)
    _, made = _fs(spark, fresh)
    recover_table(spark, path)
    _, aside = _fs(spark, f"{path}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(made, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"{fresh} could not be moved to {path}")
    fs.delete(aside, True)


def recover_table(spark: SparkSession, path: str) -> None:
    """After a crash of :func:`replace_table`: the old table is put back if no new one has come, and else deleted."""
    fs, target = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.old")
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        elif not fs.rename(aside, target):
            raise OSError(f"{path}.old could not be moved back")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows as JSON lines behind those that are there."""
    df.write.mode("append").json(path)


def merge_daily(existing: DataFrame | None, fresh: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A day's file with new rows: per key the row that was there first."""
    both = fresh.withColumn("_new", F.lit(1))
    if existing is not None:
        both = existing.withColumn("_new", F.lit(0)).unionByName(both, allowMissingColumns=True)
    return first_per_key(both, keys, [F.col("_new"), *[F.col(c) for c in order]]).drop("_new")


def read_mapping(spark: SparkSession, path: str) -> Mapping[str, object]:
    """A JSON object from a small file in any store."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def workbook_rows(path: str, sheet: int = 1) -> Iterator[list[str | None]]:
    """The rows of a sheet of a small OOXML workbook on the driver's disk, cells by their column."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{space['m']}}}t")))
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{space['m']}}}row"):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", space):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                v = c.find("m:v", space)
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t"))
                elif v is not None:
                    cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            yield [cells.get(i) for i in range(1, max(cells, default=0) + 1)]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text, such as a report, as one file in any store."""
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def report(row: Mapping[str, object], title: str) -> str:
    """A row of figures as a text: a title, and a line for each in the order given."""
    width = max(map(len, row), default=0)
    return "\n".join([title, "=" * len(title), *(f"{k:<{width}}  {v:,}" if isinstance(v, int) else f"{k:<{width}}  {v}" for k, v in row.items())]) + "\n"

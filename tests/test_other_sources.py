"""Sources beyond Parquet and CSV snapshots, on small files."""

from __future__ import annotations

import json
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.operators import inference as inf
from gleaner.sources import others


def test_csv_relations(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,text\n1,x,"one ""two"""\n2,y,three\n3,,four\n')
    schema = StructType.fromDDL("id long, name string, text string")
    got = others.read_csv_where(spark, f"{tmp_path}/a.csv", schema, ["id", "text"], F.col("name") == "x")
    assert [tuple(r) for r in got.collect()] == [(1, 'one "two"')]
    assert "name:string,text:string" not in got.select("id")._jdf.queryExecution().executedPlan().toString()
    others.csv_view(spark, "a_csv", f"{tmp_path}/a.csv", "id long, name string, text string")
    others.register(spark, "names", pd.DataFrame({"name": ["x", "y"], "score": [1.5, 2.5]}))
    assert [tuple(r) for r in spark.sql("SELECT id, score FROM a_csv JOIN names USING (name) ORDER BY id").collect()] == [(1, 1.5), (2, 2.5)]


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/t.db"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "odd name" (id INTEGER, t TEXT, extra TEXT)')
        db.executemany('INSERT INTO "odd name" VALUES (?, ?, ?)', [(i, None if i % 7 == 0 else f"t{i}", "e") for i in range(1000)])
        db.execute('DELETE FROM "odd name" WHERE id % 3 = 0')
        db.execute("CREATE TABLE none (id INTEGER)")
    got = others.read_sqlite(spark, path, "odd name", "id long, t string", parts=5)
    assert {tuple(r) for r in got.collect()} == {(i, None if i % 7 == 0 else f"t{i}") for i in range(1000) if i % 3}
    assert others.read_sqlite(spark, path, "none", "id long").collect() == []


def test_arrays(spark, tmp_path):
    m = np.arange(60, dtype="float32").reshape(20, 3)
    np.save(tmp_path / "m.npy", m)
    got = {r.key: list(r.vector) for r in others.read_array(spark, f"{tmp_path}/m.npy", rows_per_task=7).collect()}
    assert got == {str(i): m[i].tolist() for i in range(20)}
    got = {r.key: list(r.vector) for r in others.read_array(spark, f"{tmp_path}/m.npy", {"a": 3, "b": 19}).collect()}
    assert got == {"a": m[3].tolist(), "b": m[19].tolist()}


def test_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"data": {"rows": [{"id": 1, "v": 2.5}, {"id": 2}]}}))
    rows = spark.createDataFrame([(1, f"file://{tmp_path}/p.json"), (2, f"file://{tmp_path}/missing.json"), (3, None)], "k int, address string")
    got = others.read_pages(rows, "address", attempts=2, pause=0.01)
    found = {r.k: r for r in got.collect()}
    assert found[1].error is None and found[2].body is None and "missing" in found[2].error and found[3].body is found[3].error is None
    assert [tuple(r) for r in others.json_records(got, ["data", "rows"], "id: int, v: double").orderBy("id").collect()] == [(1, 2.5), (2, None)]


def test_backup(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/table")
    done = others.backup(spark, f"{tmp_path}/table", f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 100 and json.loads((tmp_path / "copy/_MANIFEST.json").read_text()) == done
    assert others.backup(spark, f"{tmp_path}/table", f"{tmp_path}/copy") == done


def test_quota():
    quota = inf.Quota({"one": 10.0, "two": 60.0})
    assert quota.wait("one", 100.0) == 0
    quota.hit("one", 100.0)
    assert quota.wait("one", 104.0) == 6 and quota.wait("two", 104.0) == 0 and quota.wait("one", 111.0) == 0
    quota.hit("one", 112.0), quota.hit("one", 105.0)  # a report that comes late shortens nothing
    assert quota.wait("one", 113.0) == 9 and quota.first(["one", "two"], 113.0) == ("two", 0.0)
    quota.hit("two", 113.0)
    assert quota.first(["one", "two"], 114.0) == ("one", 8.0)
    with pytest.raises(KeyError):
        quota.wait("three", 0.0)

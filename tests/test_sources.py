"""Sources, sinks, streams and the runner on small folders."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gleaner.plans import runner
from gleaner.sources import files
from gleaner.streaming import ingest


def test_snapshots(spark, tmp_path):
    (tmp_path / "2026-01-02_swe_jobs.csv").write_text('id,title,text\n1,"a ""b""","x\ny"\n')
    (tmp_path / "2026-01-03_swe_jobs.csv").write_text("id,title,text\n2,c,d\n")
    (tmp_path / "2026-01-04_swe_jobs.csv").write_text("id,title\n3,e\n")
    (tmp_path / "notes.txt").write_text("no")
    found = files.listing(spark, str(tmp_path), r"\d{4}-\d{2}-\d{2}_swe_jobs\.csv")
    assert [f.rsplit("/", 1)[1][:10] for f in found] == ["2026-01-02", "2026-01-03", "2026-01-04"]
    got = files.read_snapshots(spark, found, ["id", "title", "text"])
    assert [(r.id, r.title, r.text, r.scrape_date) for r in got.rows.orderBy("id").collect()] == [("1", 'a "b"', "x\ny", "2026-01-02"), ("2", "c", "d", "2026-01-03")]
    assert list(got.rejected.values()) == [2] and len(got.accepted) == 2
    assert files.read_snapshots(spark, found[2:], ["id", "title", "text"]).rows.count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    path = f"{tmp_path}/table"
    files.replace_table(df, path)
    files.replace_table(df.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    files.append_log(df, f"{tmp_path}/log")
    files.append_log(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    files.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2
    want = StructType([StructField("t", StringType()), StructField("x", LongType())])
    assert files.conform(df, want).columns == ["t", "x"]
    merged = files.merge_daily(df, spark.createDataFrame([(1, "new"), (3, "c")], "id long, t string"), ["id"], ["t"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a"), (2, None), (3, "c")}
    (tmp_path / "map.json").write_text('{"a": 1}')
    assert files.read_mapping(spark, f"{tmp_path}/map.json") == {"a": 1}


def test_workbook(tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>city</t></si><si><t>New </t><t>York</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert list(files.workbook_rows(str(tmp_path / "b.xlsx"))) == [["city", None, "5"], ["New York"]]


def test_streamed_split(spark, tmp_path):
    schema = "uid string, day string, v int"
    for i, rows in enumerate(([("a", "2026-01-02", 1), ("b", "2026-01-02", 2)], [("a", "2026-01-03", 3), ("a", "2026-01-02", 4)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        query = ingest.split_observations(stream, "uid", "day", f"{tmp_path}/canonical", f"{tmp_path}/seen", f"{tmp_path}/checkpoint")
        query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/seen").collect()} == {("a", "2026-01-02"), ("b", "2026-01-02"), ("a", "2026-01-03")}
    got = ingest.canonical_rows(spark, f"{tmp_path}/canonical", "uid", "day")
    assert sorted((r.uid, r.day) for r in got.collect()) == [("a", "2026-01-02"), ("b", "2026-01-02")]


def test_streamed_split_with_an_earlier_day(spark, tmp_path):
    schema = "uid string, day string, v int"
    for rows in ([("a", "2026-01-05", 1), ("b", "2026-01-02", 2)], [("a", "2026-01-03", 7), ("a", "2026-01-03", 4), ("b", "2026-01-09", 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        ingest.split_observations(stream, "uid", "day", f"{tmp_path}/canonical", f"{tmp_path}/seen", f"{tmp_path}/checkpoint", ["v"]).awaitTermination()
    got = ingest.canonical_rows(spark, f"{tmp_path}/canonical", "uid", "day", ["v"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", "2026-01-03", 4), ("b", "2026-01-02", 2)]
    assert spark.read.parquet(f"{tmp_path}/seen").count() == 4


def test_streams_end_in_files(spark, tmp_path):
    spark.range(10).withColumn("k", F.col("id") % 3).write.parquet(f"{tmp_path}/in")
    stream = ingest.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_trigger=2)
    counts = ingest.run_once(stream.groupBy("k").count(), f"{tmp_path}/counts", "complete", f"{tmp_path}/state")
    assert {tuple(r) for r in counts.collect()} == {(0, 4), (1, 3), (2, 3)}
    rows = ingest.run_once(stream, f"{tmp_path}/rows", "append", f"{tmp_path}/state2")
    assert rows.count() == 10 and "rows/batch-" in rows.inputFiles()[0]


def test_replaced_table_survives_a_crash(spark, tmp_path):
    path = f"{tmp_path}/table"
    files.replace_table(spark.range(3), path)
    (tmp_path / "table").rename(tmp_path / "table.old")  # a crash between the two moves
    files.recover_table(spark, path)
    assert spark.read.parquet(path).count() == 3
    files.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "table.old").exists()


def test_runner(spark, tmp_path):
    stages = [
        runner.Stage("one", lambda s, t: s.range(5), ("id",), 1),
        runner.Stage("two", lambda s, t: t["one"].filter("id > 1").withColumn("x", F.col("id") * 2), ("id", "x")),
    ]
    report = runner.run(spark, stages, str(tmp_path))
    assert report.rows == {"one": 5, "two": 3}
    again = runner.run(spark, stages, str(tmp_path), resume_from="two")
    assert again.skipped == ["one"] and again.rows == {"two": 3} and "kept" in again.text()
    assert runner.run(spark, stages, str(tmp_path), dry_run=True).planned == ["one", "two"]
    with pytest.raises(runner.StageError):
        runner.run(spark, stages, str(tmp_path), resume_from="three")
    with pytest.raises(runner.StageError):
        runner.run(spark, [runner.Stage("bad", lambda s, t: s.range(0), ("id",), 1)], str(tmp_path))
    with pytest.raises(runner.StageError):
        runner.run(spark, [runner.Stage("worse", lambda s, t: s.range(1), ("missing",))], str(tmp_path))

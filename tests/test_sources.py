import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plinth.sources import files
from plinth.streaming import reports


def test_csv_json_and_names(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Row ID,Title\n1,"x, ""y"""\n2,\n', encoding="utf-8")
    got = files.clean_names(files.read_csv(spark, str(tmp_path / "a.csv")))
    assert got.columns == ["row_id", "title"] and rows(got) == [(1, 'x, "y"'), (2, None)]
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2}]))
    assert rows(files.read_json(spark, str(tmp_path / "a.json"), "a int, b string")) == [(1, "x"), (2, None)]
    (tmp_path / "r.csv").write_text("pattern,label\nz,1\na,2\n")
    assert rows(files.read_rules(spark, str(tmp_path / "r.csv"), "pattern string, label string")) == [("a", "2", 2), ("z", "1", 1)]


def test_csv_tells_empty_texts_from_nulls(spark, rows, tmp_path):
    kind = "k int, t string, u string, v double"
    df = spark.createDataFrame([(1, "", None, float("nan")), (2, None, "", None), (3, " ", '""', 0.5), (None, "a\nb", "\\", 1.0)], kind)
    files.write_csv(df, str(tmp_path / "c"), ["k"])
    assert rows(files.read_csv(spark, str(tmp_path / "c"), kind)) == rows(df)
    (tmp_path / "a.csv").write_text('k,t,v\n"","",""\n,,\n7,null,2.5\n')
    want = [(None, None, None), (None, "", None), (7, "null", 2.5)]
    assert rows(files.read_csv(spark, str(tmp_path / "a.csv"), "k int, t string, v double")) == want
    assert rows(files.read_csv(spark, str(tmp_path / "a.csv"))) == want


def test_releases(spark, rows, tmp_path):
    aliases = {"id": ["fms_id", "project_id"], "budget": ["total", "amount"], "none": ["absent"]}
    (tmp_path / "a.csv").write_text("Project ID,Amount\nA,5\n")
    (tmp_path / "b.json").write_text(json.dumps([{"fms_id": "A", "total": 5}]))
    (tmp_path / "c.json").write_text(json.dumps({"meta": {"view": {"columns": [{"name": "FMS ID", "fieldName": "fms_id"}, {"name": "Total"}]}}, "data": [["A", "5"]]}))
    for f in ("a.csv", "b.json", "c.json"):
        assert rows(files.read_release(spark, str(tmp_path / f), aliases)) == [("A", "5", None)], f


def test_zip_and_shapes(spark, rows, tmp_path):
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("names.txt", "ID|Name|State\n1|Elm|NY\n2||NJ\n")
    assert rows(files.read_zip_member(spark, str(tmp_path / "n.zip"), r"names\.txt")) == [("1", "Elm", "NY"), ("2", "", "NJ")]
    df = spark.createDataFrame([(1, '{"type":"MultiPoint","coordinates":[[-74,40.7],[0,0]]}'), (2, '{"type":"Point","coordinates":[-74.1,40.8]}'), (3, None)], "id int, g string")
    assert rows(files.multipoints(df, F.col("g"), -75, 40, -73, 42).select("id", "lon", "lat")) == [(1, -74.0, 40.7), (2, -74.1, 40.8)]
    shapes = spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}'), (2, None)], "id int, g string")
    assert rows(files.polygons(shapes, "g").select("id", "lon", "lat")) == [(1, 1.0, 1.0)]
    assert rows(files.coordinates(spark.createDataFrame([("1.5", "2"), ("x", "2"), (None, "1")], "a string, b string"), "a", "b")) == [(1.5, 2.0)]


def test_sinks_and_digest(spark, rows, tmp_path):
    df = spark.createDataFrame([(2, "b", -74.0), (1, None, -73.5)], "k int, t string, lon double")
    files.write_parquet(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert files.write_json(df, str(tmp_path / "j"), str(tmp_path / "m")) == {"fields": ["k", "t", "lon"], "rows": 2}
    files.write_csv(df, str(tmp_path / "c"), ["k"])
    assert [r.k for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == ["1", "2"]
    f = json.loads(files.features(df.withColumn("lat", F.lit(40.7)), "lon", "lat", ["k", "t"]).where("value like '%\"k\":1%'").first().value)
    assert f["properties"] == {"k": 1} and f["geometry"]["coordinates"] == [-73.5, 40.7]
    assert files.digest(df) == files.digest(df.orderBy("k")) != files.digest(df.where("k = 1"))
    assert files.markdown(df.select("k", "t")).splitlines()[0] == "| k | t |"
    with pytest.raises(ValueError, match="more than 1 rows"):
        files.markdown(df, 1)
    assert files.is_current({"version": "1", "bytes": 2, "columns": ["a"]}, {"version": "1", "bytes": 2}, ["a"]) and not files.is_current({}, {})
    assert io is not None


def test_streams(spark, rows, tmp_path):
    kind = "k string, t int, v int"
    for i, part in enumerate([[("a", 1, 5), ("b", 1, None)], [("a", 2, None), ("b", 2, 7)], [("a", 3, 6), ("a", 0, 1)]]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = reports.carried_values(stream, "k", "t", "v").writeStream.format("memory").queryName("carried").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {("a", 1, 5), ("a", 2, 5), ("b", 1, None), ("b", 2, 7)} <= set(rows(spark.table("carried")))
    reports.upsert_latest(stream, str(tmp_path / "out"), str(tmp_path / "c2"), ["k"], ["t"]).awaitTermination()
    last = max((tmp_path / "out").iterdir())
    assert rows(spark.read.parquet(str(last))) == [("a", 3, 6), ("b", 2, 7)]


def test_retries():
    from plinth.sources import paged

    calls = []

    def fetch(fails):
        calls.append(1)
        if len(calls) <= fails:
            raise TimeoutError
        return b"x"

    assert paged.with_retries(lambda: fetch(2), tries=3, wait=0) == b"x" and len(calls) == 3
    calls.clear()
    with pytest.raises(TimeoutError):
        paged.with_retries(lambda: fetch(9), tries=3, wait=0)
    assert len(calls) == 3
    with pytest.raises(KeyError):  # not a failure that passes
        paged.with_retries(lambda: {}["x"], tries=3, wait=0)

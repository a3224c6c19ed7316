from pyspark.sql import functions as F

from plinth.operators import snapshots

SCHEMA = "k string, period int, at int, v string, h string"


def changed(df):
    return snapshots.changes(df, {"k": F.col("k")}, F.col("period"), [F.col("v")], [F.col("at")])


def test_changes(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 1, "x", ""), ("a", 2, 1, "y", ""), ("a", 4, 1, "y", ""), ("b", 2, 1, "x", ""), ("c", 1, 1, None, ""), ("c", 2, 1, "x", ""), ("c", 4, 1, None, ""), ("d", 1, 1, "x", ""), ("d", 1, 2, "q", ""),
         ("d", 2, 9, "q", ""), ("d", 2, 9, "q", ""), ("d", 4, 0, "q", ""), (None, 4, 0, "n", ""), ("e", None, 0, "n", "")], SCHEMA,
    )
    assert set(rows(changed(df))) == {("a", 2, "changed"), ("b", 2, "added"), ("b", 4, "removed"), ("c", 2, "changed"), ("c", 4, "changed"), (None, 4, "added")}


def test_empty_and_single(spark, rows):
    df = spark.createDataFrame([("a", 1, 1, "x", "")], SCHEMA)
    assert rows(changed(df)) == rows(changed(df.limit(0))) == []

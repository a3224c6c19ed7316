"""Text queries and parsers in whole: nothing that a text holds may be lost to a filter, a first match or a length."""

from pyspark.sql import functions as F

from plinth.functions import textparse
from plinth.plans import network, textual


def documents(spark, folder, texts):
    spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_addresses_of_all_texts(spark, tmp_path, rows):
    texts = ["at 606  Bobbin Avenue", "at 850\nGorse Court", "at 12 elm street", "at 7\t2nd St.", "at \u0664\u0662 Elm Road", "Elm Street", None, "at 100 Gold St."]
    got = rows(network.t07_addresses(spark, documents(spark, tmp_path, texts)))
    assert got == [("d0", 0, "606 BOBBIN AVENUE"), ("d1", 0, "850 GORSE COURT"), ("d2", 0, "12 ELM STREET"), ("d3", 0, "7 2ND STREET"), ("d4", 0, "\u0664\u0662 ELM ROAD"), ("d7", 0, "100 GOLD STREET")]


def test_units_of_all_texts(spark, tmp_path, rows):
    texts = ["Item no. 5", "Items.\n6", "PID # 7", "itemes\u00a08", "item\x1c9", "no item", None, "Items 5-80 and 3"]
    got = rows(network.t10_units(spark, documents(spark, tmp_path, texts)))
    want = [("d0", "ITEM", 5), ("d1", "ITEM", 6), ("d2", "PID", 7), ("d3", "ITEM", 8), ("d4", "ITEM", 9), *(("d7", "ITEM", n) for n in [3, *range(5, 81)])]
    assert got == want


def test_names_of_any_length(spark, rows):
    titles = spark.createDataFrame([(1, "roof at The Old Mill by the Long Creek East"), (2, "Old Mill"), (3, "Old Mill Bay, Old Mill"), (4, "Elm Park Playground")], "k int, t string")
    parts = spark.createDataFrame([(1, "The Old Mill by the Long Creek"), (2, "Old Mill"), (3, "Elm Park")], "p int, n string")
    found = lambda *x: rows(textparse.named_parts(titles, "k", F.col("t"), parts, "p", F.col("n"), *x))
    assert found() == [(1, 1), (2, 2), (3, 2), (4, 3)]
    assert found(["Bay", "Playground"]) == [(1, 1), (2, 2), (4, 3)]
    assert rows(textparse.named_parts(titles, "k", F.col("t"), parts.limit(0), "p", F.col("n"))) == []


def test_every_amount(spark, tmp_path, rows):
    sf = documents(spark, tmp_path, ["$5 then $1,200 and $5", "no amount", None, "$7"])
    assert rows(textual.m01_every_amount(spark, sf)) == [("d0", 1, 5.0), ("d0", 2, 1200.0), ("d0", 3, 5.0), ("d3", 1, 7.0)]

"""Packed fields: golden cases, edge cases, and round trips of generated fields."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.operators import packed

LABELS = packed.Segmenter(packed.with_known(packed.LABELS, ["Weir", "Old Basin"]))
BOARDS = packed.Segmenter(packed.with_known(packed.BOARDS, ["Queens 07", "Bronx"]))


def test_labels():
    assert LABELS.items('"Signal Hill, Express"; Weir / Cooper / Granary@M|Old Basin') == ["Signal Hill, Express", "Weir / Cooper / Granary@M", "Old Basin"]
    assert LABELS.items('["Weir", "Cooper \\"Weir\\" Spur"]') == ["Weir", 'Cooper "Weir" Spur']
    assert LABELS.items('"Granary ""Quarry Rd"" Spur"||Weir,,') == ['Granary "Quarry Rd" Spur', "Weir"]
    assert LABELS.items("“Old Basin, Local@Bx” ;Weir;Weir") == ["Old Basin, Local@Bx", "Weir", "Weir"]
    assert LABELS.items('"Weir (ex Cooper; closed)@M"\tA - B') == ["Weir (ex Cooper; closed)@M", "A - B"]


def test_boards():
    assert BOARDS.items('{Queens 07 & "Bronx" and Staten Island 01+Manhattan/Queens 07}') == ["Queens 07", "Bronx", "Staten Island 01", "Manhattan", "Queens 07"]
    assert BOARDS.items("  Bronx\nQueens 07 ") == ["Bronx", "Queens 07"]
    assert BOARDS.items("Highland and") == ["Highland and"]


def test_edges():
    for s in (LABELS, BOARDS):
        assert s.items(None) == s.items("") == s.items("  ") == s.items(" ;,| ") == s.items('""') == s.items("[]") == []
    assert LABELS.items('Weir; "Old') == ["Weir", '"Old']
    assert len(LABELS.items("Weir;" * 50_000)) == 50_000


def test_known_value_with_separator_stays_whole():
    s = packed.Segmenter(packed.with_known(packed.LABELS, ["Smith, Jones & Co"]))
    assert s.items("Weir, Smith, Jones & Co, Cooper") == ["Weir", "Smith, Jones & Co", "Cooper"]
    assert s.items("Smith, Jones & Company") == ["Smith", "Jones & Company"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc ,;|\"-", min_size=1, max_size=8).filter(lambda x: x.strip() == x and x.strip('"')), min_size=1, max_size=6), st.sampled_from([";", ", ", " | ", "\t", "||"]))
def test_round_trip(values, joint):
    field = joint.join('"' + v.replace('"', '""') + '"' for v in values)
    assert LABELS.items(field) == values


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "Weir; Old Basin", 1), (1, "Weir; Old Basin", 2), (2, None, 3), (3, "", 4), (4, " Weir ", 5), (None, "a|b", 6)], "id int, labels string, pos int")
    got = packed.items(df, F.col("id"), F.col("labels"), packed.LABELS)
    assert rows(got) == sorted([("1", 1, "Weir"), ("1", 1, "Weir"), ("1", 2, "Old Basin"), ("1", 2, "Old Basin"), ("4", 1, "Weir"), (None, 1, "a"), (None, 2, "b")], key=lambda r: (r[0] is not None, str(r[0]), r[1]))
    assert packed.items(df, F.col("id"), F.col("labels"), packed.LABELS, 2).count() == 6
    assert packed.items(df.limit(0), F.col("id"), F.col("labels"), packed.LABELS, 2).count() == 0
    assert packed.learned(df.limit(0), F.col("labels"), packed.LABELS).count() == 0


LEARNING = [(1, '"Signal Hill, Express"; Weir'), (2, "Weir, Signal Hill, Express | Cooper"), (3, "Signal Hill, Expressway"), (4, '“Mill; St” ; "Plain"'), (5, "Mill; St;Weir"), (6, '"say \\"Weir, now\\"";A'), (7, None), (8, '","'), (9, '"Mill; St"'), (10, "A;B")]


def learning(spark):
    return spark.createDataFrame(LEARNING, "id int, labels string")


def test_dictionary_learned_from_quoted_values_protects_them(spark, rows):
    df = learning(spark)
    words = packed.learned(df, F.col("labels"), packed.LABELS)
    assert rows(words) == [("Mill; St",), ("Signal Hill, Express",), ('say "Weir, now"',)]
    cut = lambda d: {k: [x[2] for x in rows(packed.items(df.where(f"id = {k}"), F.col("id"), F.col("labels"), packed.LABELS, 1, d))] for k in (2, 3, 5)}
    assert cut(words) == {2: ["Weir", "Signal Hill, Express", "Cooper"], 3: ["Signal Hill", "Expressway"], 5: ["Mill; St", "Weir"]}
    assert cut(None) == cut(words.limit(0)) == {2: ["Weir", "Signal Hill", "Express", "Cooper"], 3: ["Signal Hill", "Expressway"], 5: ["Mill", "St", "Weir"]}


def test_dictionary_in_parts_cuts_alike(spark, rows, monkeypatch):
    df = learning(spark).unionByName(learning(spark))
    whole = rows(packed.items(df, F.col("id"), F.col("labels"), packed.LABELS, 1, packed.learned(df, F.col("labels"), packed.LABELS)))
    monkeypatch.setattr(packed, "DICTIONARY_BYTES", 15)
    assert rows(packed.items(df, F.col("id"), F.col("labels"), packed.LABELS, 1, packed.learned(df, F.col("labels"), packed.LABELS))) == whole

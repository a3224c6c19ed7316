"""Golden cases of the operators that the queries do not show in full."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plinth.functions import periods, text, textparse, values
from plinth.operators import areas, asof, change, facets, graph, latest, quality, rules
from plinth.sources.tables import require_columns


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_dates(spark):
    p = lambda v: one(spark, periods.partial_date(F.col("x")), v)
    assert tuple(p("2027-08")) == (dt.date(2027, 8, 31), "month") and tuple(p("2024")) == (dt.date(2024, 12, 31), "year") and p("soon") is None and p(None) is None
    two = spark.createDataFrame([("2026", "2024-03"), ("2026-03-05", "2026-03-01"), ("2026-03", "2026-02-14")], "a string, b string")
    assert [r.d for r in two.select(periods.partial_difference(periods.partial_date(F.col("a")), periods.partial_date(F.col("b"))).alias("d")).collect()] == [730, 4, 31]
    assert one(spark, periods.month_end(F.col("x")), 202402, "int") == dt.date(2024, 2, 29) and one(spark, periods.month_start(F.col("x")), 202413, "int") is None
    assert tuple(one(spark, periods.month_field(F.col("x"), F.lit("2027")), "8")) == ("2027-08", None)
    assert one(spark, periods.month_field(F.col("x"), F.lit("2027")), "13").issue == "month '13', year '2027'" and one(spark, periods.month_field(F.col("x"), F.lit("1920")), "2").issue == "month '2', year '1920'"
    assert one(spark, periods.utc_day(F.col("x")), 86399, "bigint") == dt.date(1970, 1, 1) and one(spark, periods.quarter_start(F.col("x")), "2024Q3") == dt.date(2024, 7, 1)
    for t, d in {" 2023-08-15": (2023, 8, 15), "20231231": (2023, 12, 31), "1/9/2026": (2026, 1, 9), "01-Dec-2027": (2027, 12, 1), "Apr 2, 2030": (2030, 4, 2), "2023-08-04 00:00:00": (2023, 8, 4), "2023-08-04T01:02:03": (2023, 8, 4)}.items():
        assert one(spark, values.day_of_text(F.col("x")), t) == dt.date(*d), t
    for t in ("", "TBD", "n/a", "Unknown", "2023-13-41", "soon", None):
        assert one(spark, values.day_of_text(F.col("x")), t) is None


def test_money_and_missing(spark):
    for t, v in {"$1,501,000": 1501000.0, "(1,200.50)": -1200.5, "-3": -3.0, "12a": None, "": None, None: None}.items():
        assert one(spark, periods.money(F.col("x")), t) == v
    for t in ("", "  ", "N/A", "TBD", "to be determined", "--", "?", "null", " "):
        assert one(spark, values.present(F.col("x")), t) is None
    assert one(spark, values.present(F.col("x")), " DPKS ") == "DPKS"
    assert one(spark, values.cents(F.col("x")), 1455000.01, "double") == "145500001" and one(spark, values.cents(F.col("x")), float("nan"), "double") == "NaN"
    h = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "a string, b string").select(values.fingerprint(F.col("a"), F.col("b")).alias("h"))
    assert len({r.h for r in h.collect()}) == 3


def test_text(spark):
    assert one(spark, text.street(F.col("x")), "East 41st Street") == "E 41 ST" and one(spark, text.street(F.col("x")), "11st Avenue") == "11 ST AVE" and one(spark, text.street(F.col("x")), "111th Road") == "111 RD"
    assert one(spark, text.tokens(F.col("x")), "P.S. 12-b at Main") == ["12", "AT", "MAIN"]
    assert one(spark, text.sorted_ids(F.col("x")), " b, a,,NULL, b") == ["a", "b"] and one(spark, text.letters_key(F.col("x")), "(Close-Out) 2") == "closeout"


def test_parsers(spark):
    assert textparse.addresses_of("Renovation at 100 Gold St. and 5-12 Elm Avenue") == ["100 GOLD STREET", "5-12 ELM AVENUE"]
    assert textparse.addresses_of("delayed by 48 months on the street") == textparse.addresses_of(None) == textparse.addresses_of("Gold Street") == []
    assert len(textparse.addresses_of(" ".join(f"{i} Elm Street," for i in range(1, 9)))) == 3
    kinds = {"ENGINE": "ENGINE", "EC": "ENGINE", "PCT": "PRECINCT", "PRECINCT": "PRECINCT"}
    assert textparse.units_of("EC276 roof", kinds) == [("ENGINE", 276)]
    assert textparse.units_of("Engines 5, 7 & 9 and Precinct 40-42", kinds) == [("ENGINE", 5), ("ENGINE", 7), ("ENGINE", 9), ("PRECINCT", 40), ("PRECINCT", 41), ("PRECINCT", 42)]
    assert textparse.units_of(None, kinds) == textparse.units_of("no unit", kinds) == []
    assert textparse.extents_of("WM IN BAY ST BETWEEN SLOSSON TER & MINTHORNE ST") == [("BAY ST", "SLOSSON TER", "MINTHORNE ST")]
    assert textparse.extents_of("Paving of Elm Road from 5th to 7th Avenue") == [("ELM ROAD", "5TH AVENUE", "7TH AVENUE")]
    assert textparse.stretch_of("from Weir to Granary", ["Cooper", "Weir", "Mill St", "Granary"]) == ["Weir", "Mill St", "Granary"]
    assert textparse.stretch_of("Weir and Cooper", ["Cooper", "Weir"]) == ["Cooper", "Weir"] and textparse.stretch_of(None, ["Weir"]) == []
    lines = spark.createDataFrame([("d", 1, "intro"), ("d", 2, "Need: roof"), ("d", 3, "a"), ("d", 4, "b"), ("d", 5, "Need: pump"), ("d", 6, "c")], "doc string, n int, t string")
    got = textparse.labelled_records(lines, "doc", "n", "t", r"^Need: (\w+)$").collect()
    assert sorted((r.label, r.lines) for r in got) == [("pump", ["c"]), ("roof", ["a", "b"])]
    titles = spark.createDataFrame([(1, "East New York park"), (2, "New York"), (3, None)], "k int, t string")
    parts = spark.createDataFrame([(1, "New York"), (2, "East New York"), (3, "York")], "p int, n string")
    assert sorted(map(tuple, textparse.named_parts(titles, "k", F.col("t"), parts, "p", F.col("n")).collect())) == [(1, 2), (2, 1)]


def test_search_and_ambiguity(spark, rows):
    df = spark.createDataFrame([(1, "Gantry Roof"), (2, "Gantries Roof"), (3, "Gentry Roofing"), (4, "Roof"), (5, None)], "k int, t string")
    got = {r.k: r.score for r in text.search(df, "k", {"t": (F.col("t"), 2.0)}, "gantry roof").collect()}
    assert got == {1: 4.0, 3: 2.5}
    c = spark.createDataFrame([("a", 2.0, 0.0, 1), ("a", 2.0, 100.0, 2), ("a", 1.0, 9999.0, 3), ("b", 1.0, 0.0, 4), ("b", 1.0, 900.0, 5)], "k string, s double, x double, i int")
    assert [r.k for r in text.unambiguous(c, "k", [F.col("s")], F.abs(F.col("x") - F.col("best.x")), 500.0).collect()] == ["a"]


def test_change_and_runs(spark, rows):
    df = spark.createDataFrame([("a", 1, 150.0), ("a", 2, 140.0), ("b", 1, None), ("b", 2, 5.0)], "k string, p int, v double")
    assert rows(change.signed_change(df, ["k"], ["p"], "v", F.lit(100.0)).select("k", "p", "change")) == [("a", 1, 50.0), ("a", 2, -10.0), ("b", 1, None), ("b", 2, None)]
    runs = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False), ("c", 1, True)], "k string, p int, ok boolean")
    assert rows(change.final_run_start(runs, ["k"], "p", F.col("ok"))) == [("a", 3), ("b", None), ("c", 1)]
    out = {r.k: (r.outcome, r.finished_at, r.reopened) for r in change.outcome(runs, ["k"], "p", F.col("ok"), F.lit(4)).collect()}
    assert out == {"a": ("finished", None, True), "b": ("left_unfinished", None, False), "c": ("finished", 1, False)}


@pytest.mark.parametrize("bucket", [None, F.floor(F.lit(1)) if False else "t"])
def test_as_of(spark, rows, bucket):
    left = spark.createDataFrame([("a", 0), ("a", 5), ("a", 25), ("b", 3), (None, 9), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 12, None), (None, 2, "n")], "k string, t int, v string")
    cut = F.floor(F.col("t") / 10) if bucket else None
    assert rows(asof.as_of(left, right, ["k"], "t", ["v"], bucket=cut)) == rows(spark.createDataFrame([("a", 0, None, None), ("a", 5, "y", 5), ("a", 25, None, 12), ("b", 3, None, None), (None, 9, "n", 2), ("a", None, None, None)], "k string, t int, v string, m int"))
    assert rows(asof.as_of(left, right, ["k"], "t", ["v"], forward=True, bucket=cut)) == rows(spark.createDataFrame([("a", 0, "x", 1), ("a", 5, "y", 5), ("a", 25, None, None), ("b", 3, None, None), (None, 9, None, None), ("a", None, None, None)], "k string, t int, v string, m int"))


def test_facets(spark, rows):
    df = spark.createDataFrame([(1, "x", ["p", "q"], None), (2, "y", ["p"], 1), (3, "x", None, 9), (4, None, ["q"], None)], "id int, a string, b array<string>, part_of int")
    f = {"a": F.array("a"), "b": F.col("b")}
    assert [r.id for r in df.where(facets.matches(f, {"a": ["x"], "b": ["p"]})).collect()] == [1]
    assert {r.id for r in df.where(facets.matches(f, {"a": ["y"], "b": ["q"]}, either=[["a", "b"]])).collect()} == {1, 2, 4}
    assert df.where(facets.matches(f, {})).count() == 4
    assert rows(facets.option_counts(df, f, {"a": ["x"]}, "a")) == [("x", 2), ("y", 1)]
    assert {r.id for r in facets.counted_once(df, "id", "part_of").collect()} == {1, 3, 4}
    start = {"status": ["current"]}
    assert facets.parse_state("a=x,y", start) == {"status": ["current"], "a": ["x", "y"]} and facets.serialize_state({"status": ["current"], "a": ["x"]}, start) == "a=x"
    assert facets.toggled({"a": ["x"]}, "a", "x") == {"a": []} and facets.toggled({}, "a", "y") == {"a": ["y"]}


def test_shares_rules_precedence(spark, rows):
    s = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", None), ("c", 5.0), ("d", 7.0)], "e string, w double")
    got = areas.site_shares(s, "e", "w")
    assert quality.not_whole(got, "e", "share").count() == 0
    assert {(r.e, r.basis) for r in got.collect()} == {("a", "proportional"), ("b", "equal"), ("c", "equal"), ("d", "single")}
    listed = spark.createDataFrame([(2, "(?i)roof", "late"), (1, "(?i)roof|wall", "first")], "rule_no int, pattern string, label string")
    df = spark.createDataFrame([(1, "ROOF"), (2, "pump"), (3, None)], "k int, t string")
    assert rows(rules.first_match(df, ["k"], "t", listed).select("k", "rule_no", "label")) == [(1, 1, "first"), (2, None, None), (3, None, None)]
    a = spark.createDataFrame([(1, 10, "a")], "k int, o int, v string")
    b = spark.createDataFrame([(1, 1, "b"), (2, 9, "c"), (2, 8, "d")], "k int, o int, v string")
    assert rows(rules.precedence([("one", a), ("two", b)], "k", ["v"], "o")) == [(1, "one", "a"), (2, "two", "d")]
    assert rows(latest.mode(spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None)], "k string, v string"), ["k"], "v")) == [("a", "x", 1)]


def test_graph(spark, rows):
    assert graph.shortest([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], ["a"], ["c"]) == (2.0, ["a", "b", "c"])
    assert graph.shortest([("a", "b", 9.0)], ["a"], ["b"], 8.0) is None
    assert graph.chained([[(2, 0), (1, 0)], [(0, 0), (1, 0)]]) == [(0, 0), (1, 0), (2, 0)] and graph.chained([]) == []
    assert graph.snapped([[(0, 0), (1, 0)], [(1.01, 0), (2, 0)]], 0.1)[1][0] == (1, 0)
    arcs = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(20, 5)], "u bigint, v bigint")
    assert rows(graph.followed(arcs, 1)) == [(i, i + 1) for i in range(20)]
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60) if i % 20 != 19] + [("zz", "zz"), (None, "q")], "a string, b string")
    got = {r.node: r.lineage for r in graph.lineages(links).collect()}
    assert got == {f"{i:03d}": f"{i // 20 * 20:03d}" for i in range(60)} | {"zz": "zz"}


def test_quality(spark, rows):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 2, "b"), ("k", 2, "a"), ("k", 3, "a"), ("k", 4, "a"), ("k", 4, "a")], "k string, v int, t string")
    assert sorted((r.first_v, r.versions) for r in quality.content_versions(df, ["k"], "v", [F.col("t")]).collect()) == [(1, 2), (3, 1), (4, 1)]
    assert rows(quality.not_unique(df, "v", "t")) == [(4, "a", 2)]
    with pytest.raises(ValueError, match="missing columns: z"):
        require_columns(df, "k", "z")

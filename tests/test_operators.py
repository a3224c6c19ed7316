"""Operators and column functions against plain Python on small data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import geometry, periods, text
from plinth.operators import asof, latest, ranges
from plinth.session import measured, small


def column(spark, values, expression, kind="string"):
    """What an expression over column x gives for each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_streets(spark):
    cases = {
        "41st Avenue": "41 AVE", "North  8st": "N 8 ST", "West 11th street": "W 11 ST", "113TH RD.": "113 RD", "3RD": "3", "12RD": "12 RD", "22nd": "22", "11ST": "11 ST", "101st": "101", "Beach Channel Drive": "BCH CHANNEL DR",
        "Ocean Parkway": "OCEAN PKWY", "Saint Felix Str": "ST FELIX ST", "": "", None: None,
    }
    assert column(spark, cases, text.street) == list(cases.values())
    assert column(spark, ["GANTRY ST", "ST", "W 4 ST", "ESPLANADE"], text.street_base) == ["GANTRY", "ST", "W 4", "ESPLANADE"]
    assert column(spark, ["E41 Street", "Third Ave.", "tenth-street"], text.spelled_street) == ["E 41 ST", "3 AVE", "10 ST"]


def test_name_tests(spark):
    common = ["STREET", "THE"]
    assert column(spark, ["DPKS - The Weir roof", "Street the", "weirhouse: x", None], lambda c: text.lead_word(c, common)) == ["WEIR", None, "WEIRHOUSE", None]
    assert column(spark, [["AB", "CDE"], ["AB"], ["12345", "67"], []], text.admitted, "array<string>") == [True, False, False, False]
    df = spark.createDataFrame([("at 12 Old Weir Road", ["WEIR"]), ("12 and then along the Weir", ["WEIR"]), ("Weir 12", ["WEIR"]), ("7B Weir", ["X", "WEIR"])], "t string, w array<string>")
    assert [r.y for r in df.select(text.after_house_number(F.col("t"), F.col("w")).alias("y")).collect()] == [True, False, False, True]
    assert [r and (r.prefix, r.number, r.words) for r in column(spark, ["P.S. 012 - Weir Annex", "Weir"], text.named_number)] == [("PS", 12, ["WEIR", "ANNEX"]), (None, None, [])]
    assert [tuple(map(tuple, r)) for r in column(spark, ["p2: a | p31: b c | d ||", ""], text.fragments)] == [((2, "a"), (31, "b c"), (None, "d")), ()]


def test_month_fields(spark):
    cases = [("10", "2029"), ("", "2029"), (None, "2029"), ("3", "2029"), ("13", "2029"), ("10", ""), ("10", "1980"), ("", ""), (None, None), ("x", "2029"), ("1", "20299")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, m string, y string")
    got = [tuple(r.p) for r in df.select("i", periods.month_field(F.col("m"), F.col("y")).alias("p")).orderBy("i").collect()]
    bad = lambda m, y: (None, f"month '{m}', year '{y}'")
    assert got == [("2029-10", None), ("2029", None), ("2029", None), ("2029-03", None), bad("13", "2029"), bad("10", ""), bad("10", "1980"), (None, None), (None, None), bad("x", "2029"), bad("1", "20299")]


def test_mangled_dates(spark):
    days = ["2022-03-27", "1931-05-01", "2019-06-15", "1900-01-01", None]
    both = lambda m: [(str(r.day) if r.day else None, r.rule) for r in column(spark, days, lambda c: periods.demangled(F.to_date(c), F.lit(m)))]
    rest = [("2019-06-15", "as published"), (None, "placeholder"), (None, "empty")]
    assert both(True) == [("2027-03-01", "month and year read as month and day"), ("2031-05-01", "century"), *rest]
    assert both(False) == [("2022-03-27", "as published"), ("1931-05-01", "as published"), *rest]


def test_range_join(spark):
    r = random.Random(2)
    points = [(i, r.choice([r.uniform(-50, 50), float(r.randint(-3, 3)), None])) for i in range(120)]
    spans = [(i, a, a + r.choice([0.5, 3.0, 40.0, 5000.0, 0.0, -1.0])) for i, a in ((i, r.uniform(-60, 50)) for i in range(60))] + [(900, None, 1.0), (901, 0.0, None), (902, -3.0, 3.0)]
    p, s = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(spans, "j int, lo double, hi double")
    got = sorted((x.i, x.j) for x in ranges.range_join(p, "x", s, "lo", "hi", 1.0).collect())
    assert got == sorted((i, j) for i, x in points for j, lo, hi in spans if None not in (x, lo, hi) and lo <= x < hi)
    assert ranges.range_join(p, "x", s.limit(0), "lo", "hi", 1.0).count() == ranges.range_join(p.limit(0), "x", s, "lo", "hi", 1.0).count() == 0


def test_meetings_of_segments(spark):
    r = random.Random(6)
    data = [tuple(r.uniform(0, 1) for _ in range(8)) for _ in range(60)] + [(0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0), (0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0, 3.0, 4.0, 3.0, 4.0)]
    names = ["ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"]
    got = [x.m for x in spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).select(geometry.meeting(*map(F.col, names)).alias("m")).collect()]
    for (ax, ay, bx, by, cx, cy, dx, dy), m in zip(data, got, strict=True):
        steps = [i / 200 for i in range(201)]
        gap = min(math.hypot(ax + s * (bx - ax) - cx - t * (dx - cx), ay + s * (by - ay) - cy - t * (dy - cy)) for s in steps for t in steps)
        assert m.gap <= gap + 1e-12 and gap - m.gap < 0.02
    assert (got[60].lon, got[60].lat, got[60].gap) == (0.5, 0.5, 0.0) and got[61].gap == 1.0 and got[62].gap == 5.0


def test_lookup_by_time(spark, rows):
    left = spark.createDataFrame([(1, 5), (2, 5), (3, 1), (4, 9), (5, None)], "i int, t int")
    right = spark.createDataFrame([(3, "a"), (7, "b"), (None, "x")], "t int, v string")
    got = asof.as_of_by_time(left, right, "t", ["v"]).select("i", "v")
    assert rows(got) == [(1, "a"), (2, "a"), (3, None), (4, "b"), (5, None)]


def test_deduplicated_totals(spark, rows):
    data = [("a", "x", 1, 5.0), ("a", "x", 2, 7.0), ("a", "x", 2, 7.0), ("a", "y", 2, 1.0), ("a", None, 2, None), ("b", "x", None, 3.0), (None, "x", 1, 2.0), ("c", "x", None, 1.0), ("c", "x", 4, None)]
    df = spark.createDataFrame(data, "e string, p string, t int, v double")
    assert rows(latest.deduplicated_totals(df, "e", "p", "t", F.col("v"))) == [(None, 1, 1, 2.0), ("a", 2, 3, 8.0), ("b", None, 1, 3.0), ("c", 4, 1, None)]
    assert latest.deduplicated_totals(df.limit(0), "e", "p", "t", F.col("v")).count() == 0


def test_sides_are_measured(spark):
    df = spark.createDataFrame([(i, "x" * 1000, [i] * 5) for i in range(50)], "i int, s string, a array<int>")
    assert 50_000 < measured(df)[1] < 60_000 and measured(df.limit(0))[1] == 0
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small(df)) and not hinted(small(df, most=1000))


@pytest.mark.parametrize("fraction,want", [(0.0, (0.0, 0.0)), (0.5, (0.0, 1.5)), (1.0, (0.0, 3.0))])
def test_along(spark, fraction, want):
    df = spark.createDataFrame([([[0.0, 0.0], [0.0, 1.0], [0.0, 3.0]],), (None,)], "p array<array<double>>")
    assert [tuple(r.y) if r.y.lon is not None else None for r in df.select(geometry.along(F.col("p"), fraction).alias("y")).collect()] == [want, None]

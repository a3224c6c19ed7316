import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from plinth.llm import survivor

KIND = "k string, row_id bigint, rank int, at timestamp_ntz, agency string, board string, borough string, n int, b int, bundle string"
def bundles(domains=(None, None)):
    return [
        survivor.Bundle("agency", F.col("agency").isNotNull()),
        survivor.Bundle("board", F.col("board").isNotNull(), F.nullif(F.split("board", " ")[0], F.lit("any")), domains[0]),
        survivor.Bundle("borough", F.col("borough").isNotNull(), F.col("borough"), domains[1]),
    ]
OUT = survivor.UNRANKED + 1


def run(spark, data, domains=(None, None)):
    import datetime as dt

    rows = [(k, i, r, dt.datetime(2024, 1, 1) + dt.timedelta(days=t) if t is not None else None, a, b, c, 0, 0, "") for k, i, r, t, a, b, c in data]
    df = spark.createDataFrame(rows, KIND)
    got = survivor.survivors(df, {"k": F.col("k")}, bundles(domains), F.col("rank"), F.col("at"), F.col("row_id"))
    return sorted(((r.k or "", r.bundle, r.row_id) for r in got.collect()))


def by_hand(data):
    out = []
    for k in {d[0] for d in data}:
        rows = [d for d in data if d[0] == k]
        if len(rows) < 2:
            continue
        stand = lambda d: (d[2] if d[2] is not None else survivor.UNRANKED, -d[3] if d[3] is not None else 1e18, d[1])
        if a := [d for d in rows if d[4] is not None]:
            out.append((k or "", "agency", min(a, key=stand)[1]))
        some = lambda i, ctx: [(stand(d), ctx(d)) for d in sorted(rows, key=stand) if d[i] is not None] + [None]
        one, two = some(5, lambda d: None if d[5].startswith("any") else d[5].split()[0]), some(6, lambda d: d[6])
        have = [len(one) > 1, len(two) > 1]
        best = None
        for x, y in itertools.product(one, two):
            if x and y and x[1] is not None and x[1] != y[1]:
                continue
            cost = sum((c[0][0] if c else OUT) for c, h in ((x, have[0]), (y, have[1])) if h)
            key = (cost, [c[0] if c else (OUT, 1e18, 1e18) for c, h in ((x, have[0]), (y, have[1])) if h])
            if best is None or key < best[0]:
                best = (key, x, y)
        out += [(k or "", n, c[0][2]) for n, c in (("board", best[1]), ("borough", best[2])) if c]
    return sorted(out)


def generated(seed, n=150):
    r = random.Random(seed)
    return [(r.choice(["a", "b", "c", "d", None]), i, r.choice([1, 2, 3, None]), r.choice([1, 5, 9, None]), r.choice(["X", None]), r.choice(["Q 1", "Q 2", "B 1", "any 9", None]), r.choice(["Q", "B", "M", None])) for i in range(n)]


def test_against_enumeration(spark):
    for data in (generated(1), generated(2, 12), generated(3, 9)):
        for domains in ((None, None), (("Q", "B"), ("Q", "B", "M")), (None, ("Q", "B", "M"))):
            assert run(spark, data, domains) == by_hand(data)


def test_many_contexts(spark):
    r = random.Random(5)
    data = [(k, i, r.choice([1, 2, 3]), r.choice([1, 5, 9, None]), r.choice(["X", None]), r.choice([f"C{r.randint(1, 90)} 1", "any 9", None]), r.choice([f"C{r.randint(1, 90)}", None])) for i, k in enumerate("ab" * 150)]
    assert run(spark, data) == by_hand(data)


def test_the_search_decides(spark, monkeypatch):
    """The cheapest candidates of each bundle by itself do not agree here; and without the search nothing survives."""
    data = [("a", 1, 1, 1, "X", "Q 1", None), ("a", 2, 2, 1, "X", "B 1", "B"), ("a", 3, 3, 1, None, None, "B")]
    assert run(spark, data) == by_hand(data) == [("a", "agency", 1), ("a", "board", 2), ("a", "borough", 2)]
    from plinth.llm import queries

    monkeypatch.setattr(survivor, "branch_and_bound", lambda g, b, c, r, w, i, groups, n: np.full((groups, n), -1))
    assert run(spark, data) == []
    assert queries.p3_found(spark, "/root/testdata/sf0.001").count() == 0


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", 1, 1, 1, "X", None, None)]) == []
    assert run(spark, [("a", 1, 1, 1, None, None, None), ("a", 2, 1, 1, None, None, None)]) == []
    assert run(spark, [("a", 2, 1, 1, "X", None, None), ("a", 1, 1, 1, "X", None, None)]) == [("a", "agency", 1)]
    none = np.empty(0, np.int64)
    assert survivor.branch_and_bound(none, none, none, none, none, none, 2, 2).tolist() == [[-1, -1], [-1, -1]]

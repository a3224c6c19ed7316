import math
import random
from collections import Counter
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from plinth.operators import profile, ranks
from plinth.plans import training

SCHEMA = "load int, v string, x double, n int"


def counts(df, sign=1):
    return profile.counts_of(df, {"v": (F.col("v"), None), "x": (F.col("x"), F.col("x"))}, F.col("load"), sign)


def test_profile_and_deltas(spark, rows):
    r = random.Random(8)
    data = [(load, r.choice(["a", "b", None]), r.choice([None, float("nan"), float("inf"), 1.0, 2.5, -3.0, -0.0, 1e300]), 0) for load in (1, 2, 3) for _ in range(101)]
    data += [(4, None, None, 0), (None, "a", 1.0, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    m = {(x.column_name, x.load): x for x in profile.metrics(counts(df)).collect()}
    for load in (1, 2, 3):
        vs = [d[1] for d in data if d[0] == load]
        known = [v for v in vs if v is not None]
        p = [known.count(v) / len(known) for v in set(known)]
        got = m["v", load]
        assert (got.n_rows, got.n_null, got.n_distinct, got.least, got.most) == (101, vs.count(None), len(set(known)), min(known), max(known))
        assert math.isclose(got.entropy, -sum(q * math.log2(q) for q in p), abs_tol=1e-9)
        assert m["x", load].high == max(d[2] for d in data if d[0] == load and d[2] is not None and math.isfinite(d[2]))
    assert m["v", 4].null_rate == 1 and m["v", 4].n_distinct == 0
    halves = [df.where("x > 0"), df.where("not coalesce(x > 0, false)")]
    assert rows(profile.apply_deltas(*map(counts, halves))) == rows(counts(df))
    assert rows(profile.apply_deltas(counts(df), counts(halves[0], -1))) == rows(counts(halves[1]))
    assert profile.metrics(counts(df.limit(0))).count() == 0


def test_medians(spark):
    r = random.Random(9)
    data = [(load, None, r.choice([r.gauss(0, 1), r.randint(-3, 3) * 1.0, None, float("nan")]), 0) for load, n in ((1, 301), (2, 302), (3, 1), (4, 2)) for _ in range(n)]
    got = {x.load: x.median for x in profile.medians(counts(spark.createDataFrame(data, SCHEMA)).where("column_name = 'x'")).collect()}
    want = {load: v for load in (1, 2, 3, 4) if (xs := [d[2] for d in data if d[0] == load and d[2] is not None and not math.isnan(d[2])]) for v in [median(xs)]}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_shifts(spark, rows):
    data = [(1, "a", None, 0)] * 50 + [(1, "b", None, 0)] * 50 + [(2, "a", None, 0)] * 60 + [(2, "b", None, 0)] * 40 + [(3, "c", None, 0)] * 20 + [(3, "a", None, 0)] * 60 + [(3, None, None, 0)] * 20
    c = counts(spark.createDataFrame(data, SCHEMA)).where("column_name = 'v'")
    assert rows(profile.share_shifts(c, 0.15)) == [("v", 3)]
    assert rows(profile.share_shifts(c, 0.05)) == [("v", 2), ("v", 3)]


def test_store_load_by_load_equals_recounting(spark, rows, tmp_path):
    sf, load = "/root/testdata/sf0.001", F.col("reporting_period")
    tables = {name: spark.read.parquet(f"{sf}/{name}.parquet") for name in training.PROFILED}
    part = lambda which, sign=1: [training.value_counts(df.where(which), name, sign) for name, df in tables.items()]
    recounted = lambda which: rows(profile.apply_deltas(*part(which)))
    loads = sorted({r.reporting_period for df in tables.values() for r in df.select("reporting_period").distinct().collect() if r.reporting_period})
    store = profile.CountStore(spark, str(tmp_path / "counts"))
    store.apply(*part(load < loads[-2]))
    early = store.manifest()["tables"]["counts"]["buckets"]
    for one in loads[-2:]:
        store.apply(*part(load == one))
    now = store.manifest()["tables"]["counts"]["buckets"]
    assert {b: now[b] for b in early} == early and len(now) > len(early)
    assert rows(store.counts()) == recounted(F.lit(True))
    store.apply(*part(load == loads[-1], -1))
    assert rows(store.counts()) == recounted(load != loads[-1])
    assert not any(b.endswith(f"-{loads[-1]}") for b in store.manifest()["tables"]["counts"]["buckets"])
    again = tables["budget_spend_by_fy"].where(load == loads[0])  # a redelivery: what was counted goes out, what is there comes in
    store.apply(training.value_counts(again, "budget_spend_by_fy", -1), training.value_counts(again.withColumn("spend", F.col("spend") * 2), "budget_spend_by_fy"))
    assert store.counts("spend").where(load_is(loads[0])).agg(F.sum("n")).first()[0] == again.count()


def load_is(one):
    return F.col("load") == one


def test_queries_follow_their_files(spark, rows, tmp_path):
    """The second run reads no table but to look rows up; new files come in as they are; a changed file recounts its table."""
    sf = "/root/testdata/sf0.001"
    for name in [*training.PROFILED, "ref_community_districts"]:
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    here = str(tmp_path)
    assert rows(training.p7_found(spark, here)) == rows(training.p7_found(spark, sf))
    version = training.count_store(spark, here).manifest()["version"]
    assert rows(training.p7_profile(spark, here)) == rows(training.p7_profile(spark, sf))
    assert training.count_store(spark, here).manifest()["version"] == version == 1
    name = "schedule_history"
    more = spark.read.parquet(f"{sf}/{name}.parquet").withColumn("reporting_period", F.col("reporting_period") + 100)
    more.write.mode("append").parquet(f"{here}/{name}.parquet")
    counts = lambda: rows(training.count_store(spark, here).counts("completion_date"))
    both = spark.read.parquet(f"{here}/{name}.parquet")
    assert counts() == rows(training.value_counts(both, name))
    more.write.mode("overwrite").parquet(f"{here}/{name}.parquet")
    assert counts() == rows(training.value_counts(more, name))


def test_ranks(spark):
    r = random.Random(4)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.0**52 - 1, 2.0**52, 1.7976931348623157e308, -1.7976931348623157e308, 1 - 2**-53, 1.0, 1 + 2**-52, float("inf"), float("nan"), None]
    data = [(k, r.choice([r.gauss(0, 1e3), r.choice(odd), float(r.randint(-2, 2))]), r.randint(1, 3)) for k in ("a", "b", None) for _ in range(300)] + [("one", 7.0, 1), ("none", None, 1)]
    df = spark.createDataFrame(data, "k string, x double, n int")
    for weight in (None, F.col("n")):
        got = {(x.k, round(x.x, 9) if abs(x.x) < 1e300 else x.x): x.hits for x in ranks.at(df, ["k"], F.col("x"), lambda t: F.array(F.lit(1), F.floor(t / 3) + 1, F.floor(t / 3) + 1, t), weight).collect()}
        want = Counter()
        for k in ("a", "b", None, "one"):
            xs = sorted(x for q, x, n in data if q == k and x is not None and math.isfinite(x) for _ in range(1 if weight is None else n))
            for i in (1, len(xs) // 3 + 1, len(xs) // 3 + 1, len(xs)):
                want[k, round(xs[i - 1], 9) if abs(xs[i - 1]) < 1e300 else xs[i - 1]] += 1
        assert got == want
    found = {x.k: (x.a, x.b) for x in ranks.quantiles(df, ["k"], F.col("x"), {"a": 0.1, "b": 0.5}).collect()}
    for k, (a, b) in found.items():
        xs = [x for q, x, _ in data if q == k and x is not None and math.isfinite(x)]
        assert math.isclose(a, np.quantile(xs, 0.1), rel_tol=1e-9, abs_tol=1e-9) and math.isclose(b, np.quantile(xs, 0.5), rel_tol=1e-9, abs_tol=1e-9)
    assert found.keys() == {"a", "b", None, "one"}
    assert ranks.at(df.limit(0), ["k"], F.col("x"), ranks.middle).count() == 0

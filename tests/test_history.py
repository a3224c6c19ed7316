import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plinth.operators import history
from plinth.operators import store as store_module
from plinth.plans import training

SCHEMA = "entity string, period int, at int, budget int, phase string"


def build(raw):
    return history.versions(raw, F.col("entity"), F.col("period"), [F.col("at")], {"budget": F.col("budget")}, {"phase": F.col("phase")})


def by_hand(data):
    """Versions in plain Python."""
    last = {}
    for e, p, at, b, ph in data:
        if e is not None and p is not None and (at, b is not None, b or 0, ph or "") >= last.get((e, p), ((-1,),))[0]:
            last[e, p] = ((at, b is not None, b or 0, ph or ""), b, ph)
    out = []
    for e in sorted({e for e, _ in last}):
        before, held, mine = object(), None, []
        for p in sorted(p for x, p in last if x == e):
            _, b, ph = last[e, p]
            held = ph if ph is not None else held
            if (b, held) != before:
                mine.append([e, p, 999999, b, held])
                if len(mine) > 1:
                    mine[-2][2] = p
            before = (b, held)
        out += map(tuple, mine)
    return out


def generated(seed, n=120):
    r = random.Random(seed)
    return [(r.choice("abcdef"), r.randint(1, 6), i, r.choice([1, 2, None]), r.choice(["x", "y", None])) for i in range(n)]


def test_versions(spark, rows):
    data = [*generated(1), (None, 1, 1, 1, "x"), ("g", None, 1, 1, "x"), ("h", 1, 1, None, None), ("h", 2, 1, None, None)]
    assert sorted(map(str, rows(build(spark.createDataFrame(data, SCHEMA))))) == sorted(map(str, by_hand(data)))
    assert build(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rebuild_equals_full_build(spark, rows):
    old, late = generated(2), [("a", 3, 900, 9, "z"), ("q", 1, 901, 1, None)]
    every = spark.createDataFrame(old + late, SCHEMA)
    touched = spark.createDataFrame([("a",), ("q",)], "entity string")
    got = history.rebuild_affected(build(spark.createDataFrame(old, SCHEMA)), every, touched, build)
    assert rows(got) == rows(build(every))


def rows_of(raw):
    return history.last_delivered(raw, F.col("entity"), F.col("period"), [F.col("at")], {"budget": F.col("budget"), "phase": F.col("phase")})


def store_at(spark, folder, buckets=8):
    return history.HistoryStore(spark, str(folder), ["budget"], ["phase"], buckets)


def test_late_deliveries_touch_their_buckets_only(spark, rows, tmp_path):
    store, old = store_at(spark, tmp_path / "chains"), spark.createDataFrame(generated(3), SCHEMA)
    assert store.chains() is None
    store.deliver(rows_of(old))
    assert rows(store.chains()) == rows(build(old))
    before = store.manifest()
    late = [("b", 2, 999, 7, "late"), ("b", 9, 1000, 8, None), ("b", 3, -5, 1, "long superseded")]
    bucket = str(spark.createDataFrame([("b",)], "entity string").select(store_module.bucket_of(F.col("entity"), 8)).first()[0])
    hidden = [p for b, p in before["tables"]["rows"]["buckets"].items() if b != bucket]
    for p in hidden:  # the other buckets cannot even be read meanwhile
        Path(p.removeprefix("file:")).rename(Path(p.removeprefix("file:") + ".away"))
    store.deliver(rows_of(spark.createDataFrame(late, SCHEMA)))
    for p in hidden:
        Path(p.removeprefix("file:") + ".away").rename(Path(p.removeprefix("file:")))
    every = spark.createDataFrame([*generated(3), *late], SCHEMA)
    assert rows(store.chains()) == rows(build(every))
    after = store.manifest()
    was, now = before["tables"]["rows"]["buckets"], after["tables"]["rows"]["buckets"]
    assert [b for b in now if was.get(b) != now[b]] == [bucket] and len(now) > 1
    store.deliver(rows_of(every.limit(0)))
    assert rows(store.chains()) == rows(build(every))
    store.withdraw(spark.createDataFrame([("b",)], "entity string"))
    assert rows(store.chains()) == rows(build(every.where("entity != 'b'")))


def test_failed_and_losing_commits_leave_the_store(spark, rows, tmp_path):
    store, old = store_at(spark, tmp_path / "chains", 2), spark.createDataFrame(generated(4), SCHEMA)
    store.create(rows_of(old))
    boom = F.udf(lambda x: 1 // 0, "int")
    with pytest.raises(Exception, match="division"):
        store.deliver(rows_of(old.withColumn("budget", boom("budget"))))
    assert rows(store.chains()) == rows(build(old))
    before = store.manifest()
    store.commit(before, {}, more={"mark": 1})
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(before, {}, more={"mark": 2})
    assert store.manifest()["more"]["mark"] == 1
    (tmp_path / "chains" / "_commits" / f"{store.manifest()['version'] + 1:012d}").write_text("")  # a writer that died
    assert store.manifest()["more"]["mark"] == 1
    store.deliver(rows_of(spark.createDataFrame([("zz", 1, 1, 1, "x")], SCHEMA)))
    assert store.chains().where("entity = 'zz'").count() == 1


def test_a_refresh_that_is_overtaken_looks_again():
    calls = []

    def refresh(x):
        calls.append(x)
        if len(calls) < 3:
            raise store_module.OvertakenError
        return x

    assert training._once_more(refresh)(7) == 7 and calls == [7, 7, 7]


def test_query_follows_its_files(spark, rows, tmp_path):
    """New files are deliveries; a changed file makes the store anew; nothing new is nothing done."""
    whole = spark.read.parquet("/root/testdata/sf0.001/project_history.parquet")
    at, half = str(tmp_path / "project_history.parquet"), F.pmod(F.xxhash64("row_id"), F.lit(2))
    plain = lambda: rows(training.p5_found(spark, str(tmp_path)))
    want = lambda df: rows(history.chains_of(training.project_rows(df), training.EXACT, training.KEPT).select("entity", "valid_from", "valid_to"))
    whole.where(half == 0).write.parquet(at)
    assert plain() == want(whole.where(half == 0))
    version = training.history_store(spark, str(tmp_path)).manifest()["version"]
    assert version == 2 == training.history_store(spark, str(tmp_path)).manifest()["version"]
    whole.where(half == 1).write.mode("append").parquet(at)
    assert plain() == want(whole)
    assert training.history_store(spark, str(tmp_path)).manifest()["version"] == 3
    whole.where("fms_id > 'M'").write.mode("overwrite").parquet(at)
    assert plain() == want(whole.where("fms_id > 'M'"))
    whole.limit(0).write.mode("overwrite").parquet(at)
    assert plain() == []

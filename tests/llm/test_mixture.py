import random

import pytest

from plinth.llm import mixture
from plinth.llm.mixture import Target

KIND = "doc_id bigint, source string, n_tokens bigint, copies int, power int"


def sized(spark, seed=1, n=4000):
    r = random.Random(seed)
    data = [(i, r.choices(["big", "mid", "tiny", "other", None], [60, 30, 2, 5, 3])[0], int(r.lognormvariate(4, 1.5)), 7, 7) for i in range(n)]
    return spark.createDataFrame(data, KIND), data


TARGETS = [Target("big", 0.5, 1), Target("mid", 0.3, 2), Target("tiny", 0.1, 4), Target("absent", 0.1, 3)]


def test_shares_and_caps(spark):
    df, data = sized(spark)
    got = mixture.mix(df, TARGETS).collect()
    caps, of = {t.source: t.max_repeats for t in TARGETS}, {d[0]: d for d in data}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.copies <= caps[r.source] and of[r.doc_id][1:3] == (r.source, r.n_tokens) for r in got)
    tokens = {s: sum(r.n_tokens * r.copies for r in got if r.source == s) for s in caps}
    whole = sum(tokens.values())
    longest = max(d[2] for d in data)
    for t in TARGETS[:3]:
        assert abs(tokens[t.source] - whole * t.share / 0.9) <= 2 * longest
    held = {s: sum(d[2] for d in data if d[1] == s) for s in caps}
    assert any(tokens[s] >= held[s] * caps[s] - longest for s in ("big", "mid", "tiny"))


def test_repeatable_and_seeded(spark):
    df, _ = sized(spark, n=800)
    pick = lambda d, seed: sorted(map(tuple, mixture.mix(d, TARGETS, seed=seed).collect()))
    assert pick(df, 1) == pick(df.repartition(7), 1) != pick(df, 2)


def test_larger_documents_are_likelier(spark):
    df = spark.createDataFrame([(i, "a", 2 if i % 2 else 1024, 0, 0) for i in range(4000)] + [(9999, "b", 400_000, 0, 0)], KIND)
    got = mixture.mix(df, [Target("a", 0.5, 1), Target("b", 0.5, 1)], tilt=0.25).collect()
    n = [sum(r.n_tokens == s for r in got) for s in (2, 1024)]
    assert n[0] < n[1] * 0.5 and n[0] > 0


def test_total_and_edges(spark):
    df, _ = sized(spark, n=500)
    got = mixture.mix(df, TARGETS, total=3000.0).collect()
    assert 2000 < sum(r.n_tokens * r.copies for r in got) < 4500
    assert mixture.mix(df.limit(0), TARGETS).count() == mixture.mix(df, []).count() == 0
    odd = spark.createDataFrame([(1, "big", 0, 0, 0), (2, "big", None, 0, 0), (None, "big", 5, 0, 0), (3, "big", 5, 0, 0), (3, "big", 5, 0, 0), (3, "mid", 1, 0, 0)], KIND)
    assert [tuple(r) for r in mixture.mix(odd, TARGETS[:1]).collect()] == [(3, "big", 5, 1)]
    with pytest.raises(ValueError, match="two targets"):
        mixture.mix(df, [Target("big", 0.5, 1), Target("big", 0.5, 1)]).count()


def test_report(spark):
    df, _ = sized(spark, n=600)
    targets = spark.createDataFrame([(t.source, t.share, t.max_repeats) for t in TARGETS], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixture.shares(df, targets, mixture.mix(df, TARGETS)).collect()}
    assert got.keys() == {"big", "mid", "tiny", "absent", "other", None}
    assert abs(sum(r.share_reached for r in got.values()) - 1) < 1e-9 and got["absent"].share_reached == got["other"].share_reached == 0

import random

from plinth.llm import components


def by_hand(pairs, least=2):
    """Union-find in plain Python."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for hub, m in pairs:
        if hub is not None and m is not None:
            up[root(("m", m))] = root(("h", hub))
    sets = {}
    for x in list(up):
        if x[0] == "m":
            sets.setdefault(root(x), []).append(x[1])
    return sorted((min(s, key=str.encode), m) for s in sets.values() if len(s) >= least for m in s)


def run(spark, pairs, least=2):
    df = spark.createDataFrame(pairs, "hub string, member string")
    return sorted(map(tuple, components.groups(df, least).collect()))


def test_random_graphs(spark):
    for seed, n, m in ((1, 40, 30), (2, 60, 90)):
        r = random.Random(seed)
        pairs = [(str(r.randint(1, n)), f"M{r.randint(1, m):03d}") for _ in range(n * 2)] + [(None, "M001"), ("1", None), ("1", "M002"), ("1", "M002")]
        assert run(spark, pairs) == run(spark, pairs[::-1]) == by_hand(pairs)


def test_long_chain_and_hot_hub(spark):
    chain = [(str(i), f"c{i + d:05d}") for i in range(700) for d in (0, 1)]
    star = [("hot", f"s{i:05d}") for i in range(2000)] + [("x", "alone")]
    got = run(spark, chain + star)
    assert got == by_hand(chain + star) and len({g for g, _ in got}) == 2


def test_byte_order_singles_and_empty(spark):
    assert run(spark, [("1", "é"), ("1", "z"), ("2", "ü")]) == [("z", "z"), ("z", "é")]
    assert run(spark, [("1", "a")], least=1) == [("a", "a")]
    assert run(spark, []) == run(spark, [("1", "a"), ("1", "a")]) == []

"""Networks and lineages (OP-N01..N06, H18).

A street's or line's own network is small by nature, and routing is done per network in a grouped function; lineages run over
all records, by distributed propagation of the least label with pointer jumping.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import counted, cut


def crossings(edges: DataFrame, network: str, street: str) -> DataFrame:
    """OP-N01: rows (network, node, street_a, street_b): nodes where two streets of a network meet. edges: (network, street, u, v).

    Streets are gathered per node (few meet at one), so no pairs of edges are made.
    """
    ends = edges.select(network, street, F.explode(F.array("u", "v")).alias("node")).distinct()
    met = ends.groupBy(network, "node").agg(F.array_sort(F.collect_set(street)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("street_a"), b.alias("street_b")))))
    return met.select(network, "node", F.explode(pairs).alias("p")).select(network, "node", "p.*")


def shortest(edges: Iterable[tuple], sources: Iterable, targets: Iterable, most: float = float("inf")) -> tuple[float, list] | None:
    """OP-N02: (length, nodes) of the shortest path from any source to any target within `most`; ties by node order."""
    near = defaultdict(list)
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    targets, best, back = set(targets), {}, {}
    queue = [(0.0, s, None) for s in sorted(set(sources))]
    heapq.heapify(queue)
    while queue:
        d, u, came = heapq.heappop(queue)
        if u in best or d > most:
            continue
        best[u], back[u] = d, came
        if u in targets:
            path = [u]
            while back[path[-1]] is not None:
                path.append(back[path[-1]])
            return d, path[::-1]
        for v, w in near[u]:
            if v not in best:
                heapq.heappush(queue, (d + w, v, u))
    return None


def routes(edges: DataFrame, wanted: DataFrame, network: str, most: float) -> DataFrame:
    """OP-N02: rows (network, route, length, nodes) of wanted (network, route, source, target), routed within each network.

    edges: (network, u, v, length). Both sides are grouped by network together; a network is one street's graph.
    """
    kind = wanted.schema["route"].dataType.simpleString()

    def route(key: tuple, e: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        links = list(zip(e["u"], e["v"], e["length"], strict=True))
        out = []
        for name, part in w.groupby("route", sort=True):
            if found := shortest(links, part["source"].dropna(), part["target"].dropna(), most):
                out.append((key[0], name, found[0], [str(x) for x in found[1]]))
        return pd.DataFrame(out, columns=[network, "route", "length", "nodes"])

    return edges.groupBy(network).cogroup(wanted.groupBy(network)).applyInPandas(route, f"{network} string, route {kind}, length double, nodes array<string>")


def snapped(lines: list[list[tuple[float, float]]], within: float) -> list[list[tuple[float, float]]]:
    """OP-N03: polylines whose ends within `within` of an earlier end are put on that end."""
    ends: list[tuple[float, float]] = []
    out = []
    for line in lines:
        line = list(line)
        for i in (0, -1):
            if ends:
                d = np.hypot(*(np.array(ends) - np.array(line[i])).T)
                if d.min() <= within:
                    line[i] = ends[int(d.argmin())]
                    continue
            ends.append(line[i])
        out.append(line)
    return out


def chained(lines: list[list[tuple[float, float]]]) -> list[tuple[float, float]]:
    """OP-N03, H18: one polyline from lines that share ends, beginning at the least end that only one line has."""
    left = [list(x) for x in lines if len(x) > 1]
    if not left:
        return []
    count = defaultdict(int)
    for x in left:
        count[x[0]] += 1
        count[x[-1]] += 1
    at = min((p for p, n in count.items() if n == 1), default=left[0][0])
    chain = [at]
    while True:
        i = next((i for i, x in enumerate(left) if at in (x[0], x[-1])), None)
        if i is None:
            return chain
        x = left.pop(i)
        chain += (x if x[0] == at else x[::-1])[1:]
        at = chain[-1]


def chain_sizes(lines: Column, within: float) -> Column:
    """OP-N03 as a column: of the pieces of one line, an array of polylines, the number of places of the chain that they make once ends
    within `within` of each other are put together."""

    @F.pandas_udf("bigint")
    def run(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda x: len(chained(snapped([[tuple(map(float, p)) for p in line] for line in x], within))))

    return run(lines)


def followed(arcs: DataFrame, start) -> DataFrame:
    """OP-N04: rows (step, node) from start along arcs (u, v), one way out of each node, to the end or the first node met again.

    Path doubling: with the nodes of the first n steps and the map that leads n steps on, one join gives the next n steps and
    another doubles the map, so a way of n steps takes about log2(n) rounds.
    """
    spark = arcs.sparkSession
    leap = cut(arcs.where("u is not null and v is not null").groupBy("u").agg(F.min("v").alias("v")))
    way, n, size = cut(spark.range(1).select(F.lit(0).alias("step"), F.lit(start).cast(arcs.schema["u"].dataType).alias("node"))), 1, 1
    while True:
        further = way.join(leap, F.col("node") == F.col("u")).select((F.col("step") + n).alias("step"), F.col("v").alias("node"))
        longer, now = counted(way.unionByName(further).groupBy("node").agg(F.min("step").alias("step")).select("step", "node"), F.lit(True))
        if now == size:
            return longer
        leap = cut(leap.join(leap.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v")))
        way, n, size = longer, 2 * n, now


def lineages(links: DataFrame) -> DataFrame:
    """OP-N05: rows (node, lineage) of links (a, b), two text columns: the least node that is linked directly or indirectly.

    Every round, each node takes the least label of itself and its neighbours, and labels jump to the label of their label. Rounds
    are written to the shared folder; they end when no label changes.
    """
    pairs = links.where("a is not null and b is not null").select("a", "b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        hooked = labels.join(heard, F.col("node") == F.col("a")).select("node", "label", F.least("label", "heard").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        jumped, moved = counted(hooked.join(up, "low").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")), F.col("moved"))
        labels = jumped.drop("moved")
        if not moved:
            return labels.withColumnRenamed("label", "lineage")


def sole_tag(members: DataFrame, category: str, tag: str, key: str) -> DataFrame:
    """OP-N06: rows (key, tag) of untagged members of a category whose tagged members carry exactly one tag."""
    one = members.where(F.col(tag).isNotNull()).groupBy(category).agg(F.count_distinct(tag).alias("_n"), F.min(tag).alias("_t")).where("_n = 1")
    listed = members.where(F.col(tag).isNotNull()).select(key).distinct()
    return members.where(F.col(tag).isNull()).join(listed, key, "left_anti").join(one, category).select(key, F.col("_t").alias(tag)).distinct()

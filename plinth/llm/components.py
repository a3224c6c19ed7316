"""Consolidating pairwise links into groups: deterministic Boruvka hooking.

Every round, each component selects its smallest outgoing edge (edges are ordered by their smaller and then their larger end, so
that is the edge to its smallest neighbour) and hooks to the component at its other end. With one order for all edges, the
hooks make trees but for pairs that selected each other, of which the smaller becomes the root. Pointer doubling collapses the
trees, the edges are relabelled by their roots, deduplicated, and the next round begins, until no edge is left; the number of
components with edges falls by half at least in every round. The maps of the rounds are then composed from the last to the first.

Every round is written to the shared folder. Joins are on distinct keys of one side, so that adaptive execution can split a hot
key of the other; nothing is gathered per group.

Defined results: links with a null end link nothing; a node linked to itself only is in no group; repeated links count once;
the groups do not depend on row order or partitioning; an empty table has no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plinth.session import cut


#: A round of no more rows than this goes through one task, without shuffles; the steps are the same.
FEW = 50_000


def _counted(df: DataFrame, which: Column) -> tuple[DataFrame, int]:
    """df, written to the shared folder, and how many of its rows `which` is true for: counted by the job that writes."""
    seen = Observation()
    written = cut(df.observe(seen, F.count_if(which).alias("n"), F.count(F.lit(1)).alias("rows")))
    found = seen.get
    return (written.coalesce(1) if found["rows"] <= FEW else written), found["n"]


def _selected(edges: DataFrame) -> DataFrame:
    """(node, parent): the other end of each component's smallest outgoing edge; the smaller of a mutual pair is its own parent."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e"))
    chosen = ends.groupBy("e.node").agg(F.min("e.other").alias("parent"))
    back = chosen.select(F.col("node").alias("parent"), F.col("parent").alias("theirs"))
    mutual = (F.col("theirs") == F.col("node")) & (F.col("node") < F.col("parent"))
    return chosen.join(back, "parent").select("node", F.when(mutual, F.col("node")).otherwise(F.col("parent")).alias("parent"))


def _collapsed(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent a root: the map is laid on itself, so a way to a root becomes a third with every step."""
    moved = 1
    while moved:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        far = parents.select(F.col("node").alias("next"), F.col("parent").alias("last"))
        step = parents.join(up, "parent").join(far, "next").select("node", F.col("last").alias("parent"), (F.col("last") != F.col("next")).alias("moved"))
        parents, moved = _counted(step, F.col("moved"))
        parents = parents.drop("moved")
    return parents


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of every node of links (a, b), two text columns; component is a node of the group."""
    ordered = links.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    edges, left = _counted(ordered.distinct(), F.lit(True))
    rounds: list[DataFrame] = []
    while left:
        roots = _collapsed(_counted(_selected(edges), F.lit(True))[0])
        rounds.append(roots)
        for end in ("u", "v"):
            edges = edges.join(roots.select(F.col("node").alias(end), F.col("parent").alias("root")), end).drop(end).withColumnRenamed("root", end)
        edges, left = _counted(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), F.lit(True))
    if not rounds:
        return ordered.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    found = rounds.pop()
    while rounds:
        further = found.select(F.col("node").alias("parent"), F.col("parent").alias("last"))
        found = rounds.pop().join(further, "parent", "left").select("node", F.coalesce("last", "parent").alias("parent"))
    return found.withColumnRenamed("parent", "component")


def groups(members: DataFrame, least: int = 2) -> DataFrame:
    """Rows (group_id, member) of the groups of at least `least` members. members: (hub, member), both text.

    All members that share a hub belong together, also through other hubs. Each member of a hub is linked to the hub's smallest one, so
    a hub of n members is n - 1 links, however hot it is. group_id is the smallest member in byte order.
    """
    pairs = cut(members.where("hub is not null and member is not null").distinct())
    smallest = pairs.groupBy("hub").agg(F.min("member").alias("a"), F.max("member").alias("z")).where("a != z").select("hub", "a")
    links = pairs.join(smallest, "hub").where("member != a").select("a", F.col("member").alias("b"))
    found = cut(components(links).withColumnRenamed("node", "member"))
    named = found.groupBy("component").agg(F.min("member").alias("group_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    grouped = found.join(named, "component").select("group_id", "member")
    if least > 1:
        return grouped
    alone = pairs.select("member").distinct().join(found, "member", "left_anti")  # members that share no hub with another
    return grouped.unionByName(alone.select(F.col("member").alias("group_id"), "member"))

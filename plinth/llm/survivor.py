"""Best representative of each duplicate group: consistent bundles.

Fields that depend on each other form bundles (the agencies of a record, the parts of an address), and a bundle is taken whole from
one row. Candidates of a bundle are the rows with a usable value of it, the most trusted source first, then the latest, then the
smallest row id. A bundle may determine a context (a functional dependency: the board determines the borough, and so does the borough
field); the bundles chosen for a group have to agree on it. Branch and bound over the candidates finds the choice of the greatest
trust, for all bundles of a group at once. A bundle of an independent field has no context and agrees with any.

Only the best candidate of each bundle and context can be in the best choice, so rows are first brought down to these by a minimum
that is combined before the shuffle. Contexts are values of a closed domain (here the boroughs of a fixed table), so what a group holds
then depends on that domain, not on the number of its rows: where the domain is given, there is a column for each of its values and one
shuffle; otherwise a second aggregation lays the candidates of a group side by side. The search takes all groups of an Arrow batch through the bundles together, in numpy.

Defined results: nulls in a group key are equal; rows that repeat wholly differ by row id only; a bundle without a usable value
has no survivor; a context of null agrees with any; sources without a trust rank come last; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rank of a source that the trust table does not name; a bundle left out costs one more.
UNRANKED = 1_000_000


@dataclass(frozen=True)
class Bundle:
    """Fields that survive together. usable: is the row a candidate? context: the value, of a closed domain, that the bundle determines.
    domain: the values of that domain, where they are known; a row with another context is no candidate then."""

    name: str
    usable: Column
    context: Column | None = None
    domain: tuple[str, ...] | None = None


def _standing(rank: Column, when: Column, row_id: Column) -> Column:
    """Comparable: the smaller, the better."""
    return F.struct(F.coalesce(rank, F.lit(UNRANKED)).cast("int").alias("rank"), F.coalesce(-F.unix_micros(when.cast("timestamp")), F.lit(1 << 62)).alias("late"), row_id.cast("bigint").alias("row_id"))


def survivors(df: DataFrame, keys: dict[str, Column], bundles: Sequence[Bundle], rank: Column, when: Column, row_id: Column, least: int = 2) -> DataFrame:
    """Rows (keys..., bundle, row_id): the surviving row of each bundle in every group of at least `least` rows."""
    ks = [f"k{i}" for i in range(len(keys))]
    grouped = [c.alias(k) for c, k in zip(keys.values(), ks, strict=True)]
    best = _standing(rank, when, row_id)
    cell = lambda i, c, s: F.struct(F.lit(i).alias("b"), c.cast("string").alias("context"), s["rank"].alias("rank"), s["late"].alias("late"), s["row_id"].alias("row_id"))
    free = [i for i, b in enumerate(bundles) if b.context is None]
    wide = [i for i, b in enumerate(bundles) if b.context is not None and b.domain is not None]
    bound = [i for i, b in enumerate(bundles) if b.context is not None and b.domain is None]
    mins = [F.min(F.when(bundles[i].usable, best)).alias(f"s{i}") for i in free]
    cells = [cell(i, F.lit(None), F.col(f"s{i}")) for i in free]
    for i in wide:
        b = bundles[i]
        for j, value in enumerate((None, *b.domain)):
            here = b.context.isNull() if value is None else b.context == value
            mins.append(F.min(F.when(b.usable & here, best)).alias(f"s{i}_{j}"))
            cells.append(cell(i, F.lit(value), F.col(f"s{i}_{j}")))
    count = F.count(F.lit(1)).alias("n")
    parts = [F.array(*cells)] if cells else []
    if bound:
        contexts = [F.when(bundles[i].usable, bundles[i].context.cast("string")).alias(f"c{i}") for i in bound]
        lean = df.groupBy(*grouped, *contexts).agg(count, *mins, *(F.min(F.when(bundles[i].usable, best)).alias(f"s{i}") for i in bound))
        met = F.collect_list(F.struct(*(F.col(f"{x}{i}") for i in bound for x in "cs"))).alias("met")
        names = [c for c in lean.columns if c.startswith("s") and c not in {f"s{i}" for i in bound}]
        folded = lean.groupBy(*ks).agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in names), met)
        of_met = lambda i: lambda m: cell(i, m[f"c{i}"], m[f"s{i}"])
        parts += [F.transform("met", of_met(i)) for i in bound]
    else:
        folded = df.groupBy(*grouped).agg(count, *mins)
    groups = folded.where(F.col("n") >= least).select(*ks, F.filter(F.concat(*parts), lambda x: x["row_id"].isNotNull()).alias("g"))
    names = [b.name for b in bundles]
    schema = T.StructType([T.StructField(n, groups.schema[k].dataType) for n, k in zip(keys, ks, strict=True)] + [T.StructField("bundle", T.StringType()), T.StructField("row_id", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(ks))
            cells = lists.flatten()
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            context = cells.field("context").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            b, rank, late, row = (cells.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("b", "rank", "late", "row_id"))
            taken = branch_and_bound(of, b, context, rank, late, row, len(lists), len(names))
            group, bundle = np.nonzero(taken >= 0)
            kept = [c.take(pa.array(group)) for c in batch.columns[: len(ks)]]
            found = [*kept, pa.array(names, pa.string()).take(pa.array(bundle)), pa.array(row[taken[group, bundle]], pa.int64())]
            yield pa.RecordBatch.from_arrays(found, names=schema.names)

    return groups.mapInArrow(search, schema)


def branch_and_bound(group: np.ndarray, bundle: np.ndarray, context: np.ndarray, rank: np.ndarray, late: np.ndarray, row_id: np.ndarray, groups: int, bundles: int) -> np.ndarray:
    """The best choice of every group: for each of its bundles the place of a candidate among those given, -1 where none is taken.

    At most one candidate of each bundle is taken, and contexts (-1: any) agree. The cost of a choice is the sum of its ranks, with
    UNRANKED + 1 for a bundle that has candidates and is left out; of equal costs the standings (rank, late, row id) decide, bundle
    by bundle. Bound: the cost so far and the least ranks of the bundles to come must not exceed the cost of a choice known to be
    possible. Of branches of a group with the same context only the best can lead to the best choice.
    """
    order = np.lexsort((row_id, late, rank, group, bundle))
    of, code, cost_of = group[order], context[order], rank[order]
    starts = np.searchsorted(bundle[order] * groups + of, np.arange(bundles * groups)).reshape(bundles, groups)
    ends = np.append(starts.ravel()[1:], len(order)).reshape(bundles, groups)
    has = ends > starts
    out = UNRANKED + 1
    lowest = np.where(has, np.append(cost_of, 0)[starts], 0)
    rest = np.vstack([np.cumsum(lowest[::-1], axis=0)[::-1], np.zeros((1, groups), np.int64)])
    # A possible choice: all agree on the context of the first candidate that has one.
    first = np.full(groups, -1)
    strict = np.flatnonzero(code >= 0)[::-1]
    first[of[strict]] = code[strict]
    agreeing = np.where((code < 0) | (code == first[of]), cost_of, out)
    reached = np.full(bundles * groups, out)
    np.minimum.at(reached, bundle[order] * groups + of, agreeing)
    most = np.where(has, reached.reshape(bundles, groups), 0).sum(axis=0)

    at, held, cost = np.arange(groups), np.full(groups, -1), np.zeros(groups, np.int64)
    picks = np.empty((groups, 0), np.int64)
    for i in range(bundles):
        n = (ends[i] - starts[i])[at] + 1  # every candidate, and leaving the bundle out
        branch = np.repeat(np.arange(len(at)), n)
        step = np.arange(len(branch)) - np.repeat(np.cumsum(n) - n, n)
        leaves = step == n[branch] - 1
        pick = np.where(leaves, len(order), starts[i][at[branch]] + step)
        theirs = np.append(code, -1)[pick]
        now = held[branch]
        total = cost[branch] + np.where(leaves, np.where(has[i][at[branch]], out, 0), np.append(cost_of, 0)[pick])
        on = ((theirs < 0) | (now < 0) | (theirs == now)) & (total + rest[i + 1][at[branch]] <= most[at[branch]])
        branch, pick, total = branch[on], pick[on], total[on]
        at, held, cost = at[branch], np.where(theirs[on] >= 0, theirs[on], now[on]), total
        picks = np.column_stack([picks[branch], pick])
        keep = _least(at, held, cost, picks)
        at, held, cost, picks = at[keep], held[keep], cost[keep], picks[keep]
    keep = _least(at, np.zeros_like(held), cost, picks)
    found = np.full((groups, bundles), -1)
    chosen = picks[keep]
    found[at[keep]] = np.where(chosen < len(order), np.append(order, -1)[chosen], -1)
    return found


def _least(at: np.ndarray, held: np.ndarray, cost: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The best branch of each group and context: by cost, then by the standings of its picks, which are in their order."""
    order = np.lexsort((*picks.T[::-1], cost, held, at))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(at[order]) != 0) | (np.diff(held[order]) != 0)
    return order[new]
